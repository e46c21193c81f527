import glob
import gzip
import hashlib
import os
import random
import tempfile
from collections import Counter, defaultdict

import pytest

from panelwright.llm import warc
from panelwright.session import fresh_path


def pages_table(spark, rows):
    return spark.createDataFrame([(*r, "x", b"y", 3) for r in rows], "page_id long, url string, html string, payload string, key binary, n int").repartition(2)


def brute(rows):
    largest = {}
    for page_id, _, html in rows:
        if html and len(html.encode()) >= 1000 and page_id is not None:
            largest[html] = max(page_id, largest.get(html, page_id))
    out = Counter()
    for page_id, _, html in rows:
        raw = (html or "").encode()
        to = largest.get(html)
        to = None if to == page_id else to
        out[page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def html(rng, n):
    return "<p>" + "".join(rng.choice("abcdefgh \n\r\té中") for _ in range(n)) + "</p>"


@pytest.mark.parametrize("compressed", [True, False])
def test_pages_there_and_back(spark, compressed):
    rng = random.Random(2)
    same, short = html(rng, 1500), html(rng, 200)
    rows = [(i, f"http://h/{i}?a=b", html(rng, rng.randint(0, 3000))) for i in range(60)]
    rows += [(100 + i, None, same) for i in range(40)] + [(200 + i, "http://x\r\nWARC/1.0 y", short) for i in range(5)]
    rows += [(300, "u", None), (301, "", ""), (None, "é", same), (None, "é", html(rng, 1200)), (139, "again", same), (302, "u", "WARC/1.1\r\n" + html(rng, 1000) + "\r\n\r\nWARC/1.0\r\n\r\n")]
    rows += [(303, "u", "\x00\x1f\x08 \x1f" * 500), (-7, "u", html(rng, 300_000))]
    path = fresh_path(spark, "warc")
    warc.write_archives(pages_table(spark, rows), path, compressed)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # splits smaller than some records
    try:
        found = warc.read_archives(spark, path, compressed)
        assert Counter(map(tuple, warc.pages_of(found).collect())) == brute(rows)
        assert found.filter("kind = 'gap'").count() == 0
        got = {r.headers["warc-record-id"]: bytes(r.payload).decode() for r in found.filter("headers['warc-type'] = 'response'").collect()}
        assert got["<urn:page:-7>"] == rows[-1][2] and got["<urn:page:302>"] == rows[-3][2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    if compressed:  # any reader of gzip takes the files
        whole = b"".join(gzip.open(f).read() for f in glob.glob(path.removeprefix("file:") + "/part-*"))
        assert whole.count(b"WARC-Type: revisit") == sum(n for r, n in brute(rows).items() if r[3] == "revisit")


def test_empty_tables(spark):
    path = fresh_path(spark, "warc")
    warc.write_archives(pages_table(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def damaged(rng, parts):
    """Members or records with damage of several kinds: all bytes, and the numbers of those that are whole."""
    out, whole = b"", set()
    for i, part in enumerate(parts):
        kind = rng.choice(["whole"] * 4 + ["flip", "cut", "lost head", "junk before", "zeros"])
        if kind == "flip":
            at = rng.randrange(3, len(part))
            part = part[:at] + bytes([part[at] ^ 0x55]) + part[at + 1:]
        elif kind == "cut":
            part = part[: rng.randrange(1, len(part))]
        elif kind == "lost head":
            part = part[rng.randrange(1, len(part)):]
        elif kind == "zeros":
            at = rng.randrange(0, len(part) - 8)
            part = part[:at] + b"\0" * 8 + part[at + 8:]
        elif kind == "junk before":
            out += bytes(rng.randrange(256) for _ in range(rng.randint(1, 300))) + rng.choice([b"", b"\x1f\x8b\x08", b"WARC/1."])
        if kind in ("whole", "junk before"):
            whole.add(i)
        out += part
    return out, whole


@pytest.mark.parametrize("compressed, split", [(True, "100m"), (True, "700"), (False, "100m"), (False, "900")])
def test_salvage_of_damaged_archives(spark, compressed, split):
    rng = random.Random(11)
    folder, whole = tempfile.mkdtemp(prefix="warc-"), {}
    for name in ("a", "b", "c", "d"):
        payloads = [html(rng, rng.randint(1, 2500)).encode() for _ in range(40)]
        records = [warc.page_record(i, f"http://{name}/{i}", p, None, "2000-01-01T00:00:00Z") for i, p in enumerate(payloads)]
        raw, good = damaged(rng, [warc.gzip_member(r) for r in records] if compressed else records)
        whole[name] = {i: hashlib.sha1(payloads[i]).hexdigest() for i in good}
        with open(f"{folder}/{name}.dat", "wb") as f:
            f.write(raw)
    with open(f"{folder}/junk.dat", "wb") as f:
        f.write(bytes(rng.randrange(256) for _ in range(5000)) + b"\x1f\x8b\x08" * 20 + b"WARC/1." * 20)
    open(f"{folder}/nothing.dat", "wb").close()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.read_archives(spark, folder, compressed).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spans = defaultdict(list)
    for r in found:
        if r.kind == "record" and not r.inside or r.kind == "gap" and r.inside is None:
            spans[os.path.basename(r.file)].append((r.at, r.at + r.length))
    got = defaultdict(dict)
    for r in found:
        if r.kind == "record" and r.headers.get("warc-record-id", "")[10:-1].isdigit():  # a plain record's own headers have no digest
            got[os.path.basename(r.file)[0]][int(r.headers["warc-record-id"][10:-1])] = r.payload_digest
    for name, expected in whole.items():
        lost = {i for i in expected if got[name].get(i) != expected[i]}
        assert not lost, (name, lost)
        edges = sorted(spans[f"{name}.dat"])
        assert edges[0][0] == 0 and edges[-1][1] == os.path.getsize(f"{folder}/{name}.dat") and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    assert sum(b - a for a, b in spans["junk.dat"]) == 5000 + 60 + 140 and "junk" not in got


def test_later_records_of_a_member():
    """Inside a member that unpacks, the search goes on at the next version line."""
    one, two, three = (warc.page_record(i, "u", b"WARC/1.x" * i, None, "d") for i in (1, 2, 3))
    bad = two.replace(b"Content-Length: 16", b"Content-Length: x6").replace(b"WARC/1.1\r\nWARC-Type", b"WARC/1.1\r\nWARC/Type") + b"noise\n"
    found = list(warc.records_in(one + bad + three + b"tail"))
    assert [(at, x.headers["warc-record-id"]) for at, x in found if isinstance(x, warc.Record)] == [(0, "<urn:page:1>"), (len(one + bad), "<urn:page:3>")]
    gaps = [(at, *x) for at, x in found if not isinstance(x, warc.Record)]
    assert sum(g[1] for g in gaps) == len(bad) + 4 and gaps[-1] == (len(one + bad + three), 4, "version")
    wrong = one.replace(b"WARC/1.x\r\n\r\n", b"WARC/1.y\r\n\r\n")
    assert warc.parse_record(one).payload == b"WARC/1.x" and warc.parse_record(wrong) == "digest"
    assert warc.parse_record(one[:-9]) == "truncated" and warc.parse_record(one[:-1] + b"x") == "end"


def test_large_members_end_with_a_zero_byte():
    made = warc.gzip_member(b"x" * (17 << 20), 1)
    assert made.endswith(b"\0") and len(gzip.decompress(made)) == 17 << 20
    assert warc.digest_hex(warc.labelled(hashlib.sha1(b"a").digest())) == warc.digest_hex("sha1:" + hashlib.sha1(b"a").hexdigest()) == hashlib.sha1(b"a").hexdigest()
    assert warc.digest_hex("md5:00") is warc.digest_hex(None) is warc.digest_hex("sha1:zz") is None
