"""License detection by ordered signature rules.

A rule is a label, a priority and a regex over the words of a text joined by single spaces;
its first word is its keyword. A text is only split when it passes the keyword prefilter,
only words that begin a rule open a window, and a window meets only the rules of its keyword.
A detection that lies inside a longer one, or inside an equal one of higher priority, is
suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.registry import query, table

# The phrases of the base report and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH = 16  # words of a window; no rule is longer

_V = r"(?: (?:version |v ?)?(\d+)(?: \d+){0,2})?"  # an optional version

# label, name as it stands in prose, SPDX identifier in words; names and identifiers are regexes
NAMES = [
    ("gpl", rf"gnu general public licen[sc]e{_V}(?: or (?:any )?later)?", r"gpl \d(?: \d)?(?: (?:only|or later))?"),
    ("gpl-2", r"gnu general public licen[sc]e (?:version |v ?)?2(?: 0)?", r"gpl 2 0(?: (?:only|or later))?"),
    ("gpl-3", r"gnu general public licen[sc]e (?:version |v ?)?3(?: 0)?", r"gpl 3 0(?: (?:only|or later))?"),
    ("lgpl", rf"gnu (?:lesser|library) general public licen[sc]e{_V}", r"lgpl \d(?: \d)?(?: (?:only|or later))?"),
    ("agpl", rf"gnu affero general public licen[sc]e{_V}", r"agpl \d(?: \d)?(?: (?:only|or later))?"),
    ("gfdl", rf"gnu free documentation licen[sc]e{_V}", r"gfdl \d(?: \d)?"),
    ("apache", rf"apache (?:software )?licen[sc]e{_V}", r"apache \d(?: \d)?"),
    ("apache-2", r"apache (?:software )?licen[sc]e (?:version |v ?)?2(?: 0)?", r"apache 2 0"),
    ("mit", r"mit(?: expat| x11)? licen[sc]e", r"mit(?: 0)?"),
    ("bsd", r"bsd(?: style)? licen[sc]e", r"0?bsd"),
    ("bsd-2", r"bsd (?:2 clause|simplified|two clause) licen[sc]e", r"bsd 2 clause"),
    ("bsd-3", r"bsd (?:3 clause|new|revised|three clause) licen[sc]e", r"bsd 3 clause"),
    ("bsd-4", r"bsd (?:4 clause|original|old) licen[sc]e", r"bsd 4 clause"),
    ("mpl", rf"mozilla public licen[sc]e{_V}", r"mpl \d(?: \d)?"),
    ("mpl-2", r"mozilla public licen[sc]e (?:version |v ?)?2(?: 0)?", r"mpl 2 0"),
    ("epl", rf"eclipse public licen[sc]e{_V}", r"epl \d(?: \d)?"),
    ("eupl", rf"european union public licen[sc]e{_V}", r"eupl \d(?: \d)?"),
    ("cddl", rf"common development and distribution licen[sc]e{_V}", r"cddl \d(?: \d)?"),
    ("cpl", rf"common public licen[sc]e{_V}", r"cpl \d(?: \d)?"),
    ("isc", r"isc licen[sc]e", r"isc"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    ("boost", rf"boost software licen[sc]e{_V}", r"bsl \d(?: \d)?"),
    ("artistic", rf"artistic licen[sc]e{_V}", r"artistic \d(?: \d)?"),
    ("python", r"python software foundation licen[sc]e", r"psf \d(?: \d)?"),
    ("postgresql", r"postgresql licen[sc]e", r"postgresql"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", r"do what the f\w+ you want to public licen[sc]e", r"wtfpl"),
    ("ofl", rf"sil open font licen[sc]e{_V}", r"ofl \d(?: \d)?"),
    ("ncsa", r"university of illinois ncsa open source licen[sc]e", r"ncsa"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    ("osl", rf"open software licen[sc]e{_V}", r"osl \d(?: \d)?"),
    ("afl", rf"academic free licen[sc]e{_V}", r"afl \d(?: \d)?"),
    ("odbl", rf"open (?:data commons open )?database licen[sc]e{_V}", r"odbl \d(?: \d)?"),
    ("odc-by", rf"open data commons attribution licen[sc]e{_V}", r"odc by \d(?: \d)?"),
    ("ogl", rf"open government licen[sc]e{_V}", r"ogl uk \d(?: \d)?"),
    ("sspl", rf"server side public licen[sc]e{_V}", r"sspl \d(?: \d)?"),
    ("busl", rf"business source licen[sc]e{_V}", r"busl \d(?: \d)?"),
    ("elastic", rf"elastic licen[sc]e{_V}", r"elastic \d(?: \d)?"),
    ("cc0", r"creative commons (?:zero|cc0)", r"cc0 \d(?: \d)?"),
    ("cc-by", rf"creative commons attribution{_V}", r"cc by(?: \d(?: \d)?)?"),
    ("cc-by-sa", rf"creative commons attribution share ?alike{_V}", r"cc by sa(?: \d(?: \d)?)?"),
    ("cc-by-nc", rf"creative commons attribution non ?commercial{_V}", r"cc by nc(?: \d(?: \d)?)?"),
    ("cc-by-nd", rf"creative commons attribution no ?derivatives{_V}", r"cc by nd(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", rf"creative commons attribution non ?commercial share ?alike{_V}", r"cc by nc sa(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", rf"creative commons attribution non ?commercial no ?derivatives{_V}", r"cc by nc nd(?: \d(?: \d)?)?"),
]

# How a license is named: priority, confidence, regex around the name or the identifier. The first word is a keyword.
FORMS = [
    (50, 1.0, "spdx license identifier {spdx}"),
    (40, 0.95, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}"),
    (40, 0.95, "licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{spdx}"),
    (40, 0.9, "released under (?:the )?(?:terms of (?:the )?)?{name}"),
    (40, 0.9, "distributed under (?:the )?(?:terms of (?:the )?)?{name}"),
    (20, 0.7, "{name}"),
]

# Rules that no form makes.
OWN_RULES = [
    ("public-domain", 30, 0.8, "dedicated to the public domain"),
    ("public-domain", 30, 0.8, "released into the public domain"),
    ("cc0", 20, 0.7, r"cc0(?: \d(?: \d)?)?"),
    ("cc-by", 20, 0.7, r"cc by(?: \d(?: \d)?)?"),
    ("cc-by-sa", 20, 0.7, r"cc by sa(?: \d(?: \d)?)?"),
    ("cc-by-nc", 20, 0.7, r"cc by nc(?: \d(?: \d)?)?"),
    ("cc-by-nd", 20, 0.7, r"cc by nd(?: \d(?: \d)?)?"),
    ("cc-by-nc-sa", 20, 0.7, r"cc by nc sa(?: \d(?: \d)?)?"),
    ("cc-by-nc-nd", 20, 0.7, r"cc by nc nd(?: \d(?: \d)?)?"),
    ("mit", 35, 0.9, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", 35, 0.9, "redistribution and use in source and binary forms with or without modification"),
    ("gpl", 35, 0.9, "gnu gpl"),
    ("proprietary", 10, 0.4, "all rights reserved"),
]

# A text without any of these holds neither a rule nor a base phrase: first plain strings, then what they stand in.
HINTS = ["licen", "spdx", "public", "creative", "cc0", "cc", "permission", "redistribution", "gnu", "rights"]
PREFILTER = (
    r"(?i)licen[sc]e|spdx|public[^0-9a-z]+domain|creative[^0-9a-z]+commons|cc0|(?<![0-9a-z])cc[^0-9a-z]+by|permission[^0-9a-z]+is"
    r"|redistribution|gnu[^0-9a-z]+gpl|rights[^0-9a-z]+reserved"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    pattern: str

    @property
    def keywords(self) -> list[str]:
        first = self.pattern.split(" ")[0].split("(")[0]
        return [first.replace("[sc]", c) for c in "sc"] if "[sc]" in first else ["0bsd", "bsd"] if first == "0?bsd" else [first]


def rules() -> list[Rule]:
    """All rules in order: every name in every form, then the single ones."""
    made = [
        Rule(label, priority + label[-1].isdigit(), confidence, form.format(name=name, spdx=spdx))
        for priority, confidence, form in FORMS for label, name, spdx in NAMES]
    return made + [Rule(*r) for r in OWN_RULES]


def _places(words: Column, phrase: str, label: str) -> Column:
    first, n = phrase.split(" ")[0], phrase.count(" ") + 1
    here = F.transform(words, lambda w, i: F.when(
        (w == first) & (F.array_join(F.slice(words, i + 1, n), " ") == phrase),
        F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))))
    return F.filter(here, lambda x: x.isNotNull())


def _needed(pattern: str) -> str:
    """The longest plain word that every match of the pattern holds, or nothing."""
    plain = [w for w in re.sub(r"\((?:[^()]|\([^()]*\))*\)\??", " ~ ", pattern).split() if re.fullmatch("[a-z]+", w)]
    return max(plain, key=len, default="")


def detections(words: Column, rule_set: list[Rule]) -> Column:
    """Where rules hold in an array of words, before suppression: structs in order of start, longest and strongest first."""
    known = F.array(*[
        F.struct(F.lit(k).alias("keyword"), F.lit(n).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"),
                 F.lit(r.confidence).alias("confidence"), F.lit(f"^(?:{r.pattern})(?= |$)").alias("pattern"), F.lit(_needed(r.pattern)).alias("needed"))
        for n, r in enumerate(rule_set) for k in r.keywords])
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rule_set for k in r.keywords})])

    def at(w, i):
        return F.when(F.array_contains(keywords, w), F.struct(
            i.alias("start"), w.alias("keyword"), F.array_join(F.slice(words, i + 1, REACH), " ").alias("window")))

    def hits(p):
        held = F.filter(known, lambda r: (r["keyword"] == p["keyword"]) & F.contains(p["window"], r["needed"]) & F.rlike(p["window"], r["pattern"]))
        return F.transform(held, lambda r: F.struct(
            p["start"].cast("long").alias("start"),
            (-p["start"] - F.size(F.split(F.regexp_substr(p["window"], r["pattern"]), " "))).cast("long").alias("minus_stop"),
            (-r["priority"]).alias("minus_priority"), r["rule"].alias("rule"), r["label"].alias("label"), r["confidence"].alias("confidence")))

    opened = F.filter(F.transform(words, at), lambda p: p.isNotNull())
    return F.array_sort(F.flatten(F.transform(opened, hits)))


def surviving(found: Column) -> Column:
    """Labels and highest confidence of the detections that lie inside no earlier one of the order."""
    start = F.struct(F.lit(-1).cast("long").alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"))
    return F.aggregate(found, start, lambda a, x: F.when(-x["minus_stop"] <= a["reach"], a).otherwise(F.struct(
        (-x["minus_stop"]).alias("reach"), F.array_union(a["labels"], F.array(x["label"])).alias("labels"),
        F.greatest(a["confidence"], x["confidence"]).alias("confidence"))))


def scan_licenses(docs: DataFrame, rule_set: list[Rule] | None = None) -> DataFrame:
    """License report of every document, in one pass without a shuffle.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. The
    base report counts all places of the phrases in ``BASE``; the rules add labels of their
    own. ``score`` is the highest confidence of a rule that holds, 0.5 if only a base phrase
    stands, else 0. Null and empty texts have no words and no labels; repeated rows are
    reported one by one; other columns are ignored.
    """
    lower = F.lower("text")
    hinted = reduce(or_, [F.contains(lower, F.lit(h)) for h in HINTS])
    spread = docs.select(
        "doc_id", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        F.when(hinted & F.col("text").rlike(PREFILTER), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1)))
        .otherwise(F.array().cast("array<string>")).alias("words"))
    places = [_places(F.col("words"), phrase, label) for phrase, label in BASE.items()]
    report = spread.select(
        "doc_id", "n_words", F.concat(*places).alias("base"),
        surviving(detections(F.col("words"), rules() if rule_set is None else rule_set)).alias("own"))
    labels = F.array_distinct("base.label")
    return report.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.at").alias("first_word"),
        F.array_max("base.at").alias("last_word"), F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, "own.labels")), ",").alias("labels"),
        F.greatest("own.confidence", F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"))


@query("op8_licenses")
def op8_licenses(spark, folder):
    return scan_licenses(table(spark, folder, "documents"))
