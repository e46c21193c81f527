import re
from collections import Counter

from panelwright.llm.licenses import Rule, rules, scan_licenses
from panelwright.llm.quality import QualityRules, quality_report

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i: i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if seen[tuple(words[i: i + 8])] > 1 for k in range(8)}
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dups += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(marked)


def test_quality_equals_brute_force(make_docs, awkward):
    phrase = "the same eight words stand here again and again"
    pairs = [*awkward, (20, f"{phrase}. {' '.join(map(str, range(60)))} {phrase}. a # b | c"), (21, "a b\na b\n\n \na b " * 9), (22, " ".join(map(str, range(200))))]
    got = quality_report(make_docs(pairs)).collect()
    assert len(got) == len(pairs)
    want = Counter((d, *brute_quality(t)) for d, t in pairs)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    verdict = {r.doc_id: r.kept for r in got}
    assert verdict[22] and not verdict[1] and not verdict[8]


def test_longest_repeat_alone_rejects(make_docs):
    part = [f"p{i}" for i in range(13)]
    text = " ".join([*part, *(f"u{i}" for i in range(70)), *part])
    (r,) = quality_report(make_docs([(1, text)])).collect()
    assert (r.n_repeat_words, r.n_longest_repeat, r.kept) == (26, 13, True)
    (r,) = quality_report(make_docs([(1, text)]), QualityRules(max_longest=10)).collect()
    assert not r.base_failed and not r.kept


def test_quality_of_nothing(make_docs):
    assert quality_report(make_docs([])).count() == 0


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_license_report(make_docs):
    got = by_id(scan_licenses(make_docs([
        (1, "Licensed under the Apache License, Version 2.0."), (2, "GNU\tGENERAL--public_license; cc by, MIT License. cc by"),
        (3, "Licensed under CC BY-NC 4.0."), (4, "no terms at all"), (5, None), (6, ""), (7, "dmit license and gnu general public licenses"),
        (8, "SPDX-License-Identifier: GPL-3.0-only"), (9, "äcc by ccé by cc by1")])))
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (1, 3, "apache", "apache,apache-2")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].last_word) == (10, 4, 0, 8)
    assert got[2].base_labels == "cc-by,gpl,mit"
    assert (got[3].base_labels, got[3].labels) == ("cc-by", "cc-by,cc-by-nc")
    assert (got[4].n_base, got[4].first_word, got[4].labels, got[4].score) == (0, None, "", 0.0)
    assert got[5].n_words == 0 and got[6].labels == "" and got[7].n_base == 0 and got[9].n_base == 0
    assert got[8].labels == "gpl-3" and 0 < got[8].score <= 1


def test_containment_and_priority(make_docs):
    rule_set = [Rule("short", 90, 0.9, "a license"), Rule("long", 10, 0.5, "a license of ours"), Rule("same", 5, 0.4, "a license of ours"),
                Rule("after", 1, 0.3, "ours only license")]
    (r,) = scan_licenses(make_docs([(1, "This is a license of ours only license")]), rule_set).collect()
    assert r.labels == "after,long" and r.score == 0.5


def test_every_rule_has_a_keyword_and_is_short_enough():
    made = rules()
    assert len(made) > 200 and all(r.keywords and all(re.fullmatch("[a-z0-9]+", k) for k in r.keywords) for r in made)
    assert all(re.compile(r.pattern) and len(re.sub(r"\([^()]*\)\??", "", r.pattern).split()) <= 16 for r in made)


def test_licenses_of_awkward_rows(make_docs, awkward):
    assert scan_licenses(make_docs(awkward)).count() == len(awkward)
    assert scan_licenses(make_docs([])).count() == 0
