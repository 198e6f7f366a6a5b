"""WARC round trips over any split, Merkle manifests and spelling groups against plain versions, and their odd rows."""

import collections
import gzip
import hashlib
import io
import random
import re
import zlib

import pytest

from quayside.llm import merkle, spelling, warc
from quayside.session import scratch_path


# ---- WARC ----

PAGES = "url string, page_id long, html string, record_id string, kind string, row int"


def plain_warc(rows):
    """page_id, bytes, sha1, type, refers_to of each (page_id, html); of equal rows any one may be the response."""
    best = collections.defaultdict(list)
    for page, html in rows:
        best[html or ""].append(page)
    out = []
    for html, pages in best.items():
        data = html.encode()
        pages.sort(key=lambda p: -1 if p is None else p, reverse=True)
        for k, page in enumerate(pages):
            revisit = k > 0 and len(data) >= 1000
            out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", pages[0] if revisit else None))
    return sorted(out, key=repr)


def round_trip(spark, rows, **options):
    pages = spark.createDataFrame([(None if k % 3 == 0 else f"http://h/{k}\r\nx ü", p, h, "x", "y", 7) for k, (p, h) in enumerate(rows)], PAGES)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.repartition(3), path)
    return path, warc.read_archives(spark, path, **options)


def test_warc_round_trip_and_odd_rows(spark):
    long_text = "é" * 500
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long_text), (9, long_text), (7, long_text), (9, long_text), (None, long_text), (None, "z" * 1000),
            (11, "a" * 999), (12, "a" * 999), (13, "b" * 1000), (14, "b" * 1000), (15, "x" * (17 << 20)), (16, "\x1f\x8b\x08 WARC/1.1")]
    path, back = round_trip(spark, rows)
    found = back.withColumn("page", warc.id_of("record_id")).withColumn("refers", warc.id_of("refers_to_id")).collect()
    assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers) for r in found), key=repr) == plain_warc(rows)
    texts = {p: h or "" for p, h in rows if p is not None}
    assert all(r.payload.decode() == texts[r.page] and r.intact for r in found if r.record_type == "response" and r.page is not None)
    names = {r.record_id for r in found}
    assert len(names) == len(rows) and all(r.refers_to_id in names for r in found if r.record_type == "revisit")
    # any split gives the same records once
    for size in (1000, 50_000):
        again = warc.read_archives(spark, path, range_bytes=size, with_payload=False).select("record_id").collect()
        assert sorted(r.record_id for r in again) == sorted(names)


def test_warc_files_are_gzip(spark):
    path, _ = round_trip(spark, [(k, "text %d " % k * 50) for k in range(20)])
    kinds = collections.Counter()
    for row in spark.read.format("binaryFile").load(path).collect():
        kinds.update(re.findall(rb"WARC-Type: (\w+)", gzip.decompress(row.content)))
    assert kinds == {b"response": 20}


def test_warc_empty_table(spark):
    path, back = round_trip(spark, [])
    assert back.count() == 0


def test_ranges_own_each_record_once():
    draw = random.Random(4)
    payloads = [bytes(draw.choices(range(256), k=draw.randint(0, 3000))) for _ in range(30)]
    payloads += [b"\x1f\x8b\x08" * 40, gzip.compress(b"no record"), gzip.compress(b"WARC/1.1\r\nno colon\r\n\r\n"), b"\x1f\x8b\x08\x00" + bytes(2000)]
    whole, places = b"", []
    for k, data in enumerate(payloads):
        places.append(len(whole))
        kind = "revisit" if k % 7 == 3 else "response"
        # stored without compression, so that what looks like a member inside a payload stands there as it is
        whole += warc.member(warc.record(kind, f"urn:page:{k}:0", "http://x", hashlib.sha1(data).hexdigest(), len(data), data, "urn:page:0:0"), level=0 if k % 2 else 6) + b"\x00"
        whole += warc.member(b"") + b"\x00" if k % 5 == 0 else b""
    for size in (1, 7, 500, 4096, len(whole)):
        got = [(p, warc.parsed("f", p, f, b, True)) for s in range(0, len(whole), size) for p, f, b in warc.read_range(io.BytesIO(whole), s, min(s + size, len(whole)))]
        assert [p for p, _ in got] == places
        for k, (_, r) in enumerate(got):
            assert r[2] == f"urn:page:{k}:0" and r[7] == len(payloads[k]) and r[8] == hashlib.sha1(payloads[k]).hexdigest()
            assert r[10] == (None if k % 7 == 3 else payloads[k])


def test_broken_archives():
    good = warc.member(warc.record("response", "urn:page:1:0", None, hashlib.sha1(b"x").hexdigest(), 1, b"x", None)) + b"\x00"
    cut = good[: len(good) // 2]
    assert [f["warc-record-id"] for _, f, _ in warc.read_range(io.BytesIO(b"junk" + cut + good + cut), 0, 10_000)] == ["<urn:page:1:0>"]
    assert list(warc.read_range(io.BytesIO(b""), 0, 10)) == [] and list(warc.read_range(io.BytesIO(cut), 0, len(cut))) == []
    assert zlib.decompress(good, 31).startswith(b"WARC/1.1")


# ---- Merkle ----

DOCS = "tree string, doc_id long, text string, source string, lang string, n_chars long, node string, steps int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row[1], row[3], row[4], row[5], text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_proof(levels, i):
    out = []
    for level in levels[:-1]:
        first = i // 3 * 3
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    sources = collections.defaultdict(list)
    for row in rows:
        sources[row[3]].append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[1] is not None, r[1] or 0, leaf_of(r, r[2])))
        trees[s] = plain_tree([leaf_of(r, r[2]) for r in sources[s]])
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            steps = plain_proof(trees[s], i) + plain_proof(top, k)
            hit = r[1] is not None and zlib.crc32(str(r[1]).encode()) % 2 == 0
            node = leaf_of(r, r[2].replace("\n", "") if hit and r[2] is not None else r[2])
            for left, right in steps:
                node = h(left, node, right)
            out.append((r[1], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*[x for step in steps for x in step]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def run_manifest(spark, rows, depth):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0
    return merkle.manifest(docs, hit, F.replace(F.col("text"), F.lit("\n"), F.lit("")), depth)


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_against_plain_tree(spark, depth):
    draw = random.Random(depth)
    rows = [("t", k, f"line {k}\nnext ü" * draw.randint(0, 3), draw.choice(["a", "a", "a", "b", "é", "ab", None, f"s{k % 11}"]), "en", k, "n", 1) for k in range(70)]
    rows += [rows[3], rows[3], (None, None, None, "a", None, None, None, None), ("t", None, "x\n", "a", "en", 1, "n", 1), ("t", 4, "other\n", "a", "en", 1, "n", 1), ("t", 1 << 62, "big\n" * 100_000, None, None, -3, "n", 1)]
    got = run_manifest(spark, rows, depth)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got.select(*names, "copied").collect()
    assert sorted((tuple(r[:7]) for r in found), key=repr) == plain_manifest(rows)
    assert any(not r.verified for r in found)
    assert all(r.verified or r.copied[-1] == r.folded_root for r in found)


def test_manifest_of_one_and_of_none(spark):
    one = [("t", 5, "a\nb", "s", "en", 3, "n", 1)]
    assert [tuple(r[:7]) for r in run_manifest(spark, one, 7).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()] == plain_manifest(one)
    assert run_manifest(spark, [], 7).count() == 0


def test_a_hot_source_spreads_over_blocks(spark):
    rows = [("t", k, "x", "hot", "en", 1, "n", 1) for k in range(3000)]
    got = run_manifest(spark, rows, 3)
    assert sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr) == plain_manifest(rows)


# ---- spelling ----


def plain_words(docs):
    counts = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if code % 31 == 0:
                run = run[: code % len(run)] + run[code % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def plain_groups(words):
    forms, near = {}, {}
    for w, n in words.items():
        near[w] = [v for v in words if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None))
    return sorted(out, key=repr)


def test_words_against_plain_count(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choices("abÉéßÀÿ×÷ZQ", k=draw.randint(1, 14))) for _ in range(150)]
    docs = [(draw.choice([None, k]), draw.choice([" ", "1", "\n", "-Ā"]).join(draw.choices(vocabulary, k=200))) for k in range(40)] + [(1, None), (2, ""), (3, "12 .."), (4, "x" * 200_000 + " " + "x" * 200_000)]
    df = spark.createDataFrame([(d, t, "w", 3) for d, t in docs], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.count_words(df).collect()}
    assert got == plain_words(docs) and len(got) > 50


def test_groups_against_all_pairs(spark):
    draw = random.Random(7)
    words = {}
    for _ in range(60):
        stem = "".join(draw.choices("abé", k=draw.randint(7, 13)))
        words[stem] = draw.choice([2, 5, 20, 30, 400, 6000])
        for _ in range(draw.randint(0, 6)):  # chains of edits of one and two steps, repeated letters, equal counts
            i = draw.randrange(len(stem))
            other = draw.choice([stem[:i] + stem[i + 1 :], stem[:i] + draw.choice("abéx") + stem[i:], stem[:i] + draw.choice("abéx") + stem[i + 1 :]])
            if len(other) >= 7:
                words.setdefault(other, draw.choice([2, 2, 3, 20, 200]))
    words |= {"aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaaaaa": 2000, "aaaaaaaaaaa": 20_000, "baaaaaa": 20}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_groups(words)
    assert any(r.root != r.form and r.form for r in got)


def test_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.count_words(empty)).count() == 0


def test_every_edit_of_a_word_is_near(spark):
    word = "abcdefgh"
    near = {word[:i] + word[i + 1 :] for i in range(8)} | {word[:i] + "z" + word[i:] for i in range(9)} | {word[:i] + "z" + word[i + 1 :] for i in range(8)}
    rows = spark.createDataFrame([(word, 100)] + [(w, 2) for w in near], "word string, n long")
    got = {r.word: r for r in spelling.group_variants(rows).collect()}
    assert got[word].n_near == len(near) and all(got[w].form == word for w in near)
