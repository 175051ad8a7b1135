"""Near-duplicates, exact search, mixing and archives, against plain versions."""

import gzip
import hashlib
import io
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shapeguard.llm import mixing, simhash, topk, warc
from shapeguard.llm.components import components

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n"), (10**6 + 3, "ÄB c"), (10**6 + 4, "Äb C"), (10**6 + 9, docs[0][1]), (10**6 + 9, docs[0][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    got = simhash.near_duplicates(frame).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    assert sorted((r.doc_id, r.fp % 2**64) for r in got) == sorted(prints)
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2) if bin(x ^ y).count("1") <= 4]
    want = plain_components({i for i, _ in docs}, links)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(docs)
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("block", [8192, 40])
def test_links_span_dense_blocks(spark, block):
    rng = random.Random(block)
    centre = [rng.getrandbits(64) for _ in range(3)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(150)}
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block)
    links = [(r.a, r.b) for r in found.collect()]
    assert all(bin((a ^ b) % 2**64).count("1") <= 4 for a, b in links)
    every = [(a, b) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) % 2**64).count("1") <= 4]
    assert plain_components(signed, links) == plain_components(signed, every)
    assert {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == {
        n: m for n, m in plain_components(signed, every).items() if n in {x for ab in links for x in ab}
    }


def test_bit_sliced_distances():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 1000, np.uint64)
    flips = rng.integers(0, 12, 1000)
    b = np.array([x ^ sum(1 << int(p) for p in rng.choice(64, f, replace=False)) for x, f in zip(a.tolist(), flips)], np.uint64)
    assert (simhash.pairs_within(a, b) == (flips <= 4)).all()


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000)]
    random.Random(1).shuffle(path)
    found = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string, n long")
    assert simhash.near_duplicates(none).count() == mixing.mix(none).count() == 0
    vectors = topk.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.search(vectors, F.lit(True)).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.25, 0.7, 0.0]) for _ in range(20)]) for i in range(500)]
    rows += [(600, rows[3][1]), (601, rows[3][1]), (601, rows[3][1]), (602, rows[100][1][:7]), (700, None), (701, [None] * 20), (702, [float("nan")] * 20), (703, [float("-inf")] * 20), (None, rows[4][1]), (704, []), (800, [1.0] * 20)]
    rows += [(100, rows[5][1]), (100, rows[5][1]), (200, [2.0] * 25)]  # query ids that repeat
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2)).withColumn("row", F.lit(3)).repartition(3)
    vectors = topk.usable(frame)
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and i not in (700, 701, 702, 703)]
    want = Counter()
    for own, (q, v) in enumerate(ints):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for at, (i, w) in enumerate(ints) if at != own)[:10]
            want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    for sizes in ({}, {"row_block": 64, "query_chunk": 2, "pilot": 30, "held": 1 << 14}, {"pilot": 3}):
        got = topk.search(vectors, F.col("vec_id") % 100 == 0, 10, **sizes).collect()
        assert Counter(map(tuple, got)) == want and len(got) == 10 * 10


def test_top_k_of_large_components_saturates(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])]
    vectors = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r.vec_id: r.score for r in topk.search(vectors, F.col("vec_id") == 0).collect()}
    assert got[1] == 2**63 - 1 and got[2] == -(2**63) + 1


def test_mixing_rates_and_draws(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small" if i % 6 else None) for i in range(6000)] + [(1, "again", "big"), (None, None, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rate", F.lit(1)).withColumn("parts", F.lit(1))
    out = mixing.mix(docs, {"big": 0.2, "small": 0.6, "other": 0.2}).cache()
    n = Counter(r.source for r in out.collect())
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 4500) < 300 and n[None] == 0
    again = mixing.mix(docs.repartition(7), {"big": 0.2, "small": 0.6, "other": 0.2})
    assert sorted(out.select("doc_id", "mix.shuffle_key").collect(), key=str) == sorted(again.select("doc_id", "mix.shuffle_key").collect(), key=str)
    assert set(mixing.mix(docs).columns) == {*docs.columns, "mix"}
    copies = Counter(r.doc_id for r in out.where("source = 'small'").collect())
    share = [sum(copies[i] == k for i in range(3, 6000, 6)) / 1000 for k in range(4)]
    assert all(abs(s - p) < 0.05 for s, p in zip(share, [0.0111, 0.05, 0.1125, 0.1687]))
    even = Counter(r.source for r in mixing.mix(docs).collect())
    assert all(abs(even[s] - 2000) < 200 for s in ("big", "small", None))


def test_helpers_make_way_for_columns_of_the_same_name(spark):
    names = ["mix", "MIX_", "rate_of", "n_drawn", "copy_drawn", "kept_id", "kept_hash", "k", "fp", "label", "times", "n", "row"]
    rows = [(i, "the same few words in every text here", "s", *range(13)) for i in range(40)] + [(None, None, None, *range(13))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix__"]
    assert {tuple(r)[3:-1] for r in mixed.collect()} == {tuple(range(13))} and mixed.select("mix__.n_copies").count() > 20
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[-1]], key=str)


def test_rows_without_ids_are_dealt_by_their_texts(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        sizes = [r["n"] for r in mixing.mix(docs).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 1500


def test_hot_keys_are_looked_up_whole(spark):
    from shapeguard.llm.common import cut, looked_up

    rows = cut(spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS key"), "rows")
    table = cut(spark.range(6000).selectExpr("id AS key", "id * 2 AS twice"), "table")
    got = looked_up(rows, table, "key", 6000)
    assert sorted((r.id, r.twice) for r in got.collect()) == [(i, 14 if i % 3 == 0 else 2 * i) for i in range(6000)]


def test_mixing_with_a_huge_rate(spark):
    docs = spark.createDataFrame([(1, "rare", "r")] + [(i, "x", "c") for i in range(2, 3000)], "doc_id long, text string, source string")
    n = mixing.mix(docs, {"r": 1.0, "c": 1.0}).where("source = 'r'").count()
    assert abs(n - 1500) < 200


def test_archives(spark):
    same = "<p>" + "x" * 200
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, "http://a/3", same), (4, None, same), (4, "http://a/4", same), (5, "u", "short"), (6, "u", "short"), (None, "u", same), (7, "line\nbreak", "é" * 70 + "\r\n\r\n" + "y" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    folder = warc.fresh_path(spark, "test")
    manifest = warc.write(pages, folder)
    back = warc.read_archives(manifest, folder).collect()
    want = sorted((str(i), h or "") for i, _, h in rows)
    assert sorted((str(r.page_id), dict(want)[str(r.page_id)]) for r in back) == want
    for r in back:
        data = dict(want)[str(r.page_id)].encode()
        assert r.payload_digest == hashlib.sha256(data).hexdigest() and r.payload_bytes == len(data)
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) == data)
    assert sorted((str(r.page_id), r.refers_to) for r in back if r.record_type == "revisit") == [("4", "3"), ("4", "3"), ("None", "3")]


@pytest.mark.parametrize("most", [200_000, 2])
def test_repeated_payloads_by_either_join(spark, most):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, "u", f"payload {rng.choice([0, 0, 0, 1, 2, 3, 4, i])} " * 30) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter((r.page_id, r.html, r.refers_to) for r in warc.with_originals(pages, most).collect())
    least = {h: min((i for i, _, g in rows if g == h and i is not None), default=None) for _, _, h in rows}
    want = Counter((i, h, least[h] if (i is None or i > least[h]) and sum(g == h for _, _, g in rows) > 1 and least[h] is not None else None) for i, _, h in rows)
    assert got == want


def test_archives_are_read_in_parallel_and_counted(spark):
    folder = warc.fresh_path(spark, "test")
    pages = spark.createDataFrame([(i, "u", f"page {i}" * 40) for i in range(300)], "page_id long, url string, html string").repartition(6)
    manifest = warc.write(pages, folder)
    assert manifest.count() == 6
    back = warc.read_archives(manifest, folder)
    assert back.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).where("n > 0").count() == 6
    store, root = warc.filesystem(folder)
    name = manifest.first()["archive"]
    with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
        data = stream.read()
    last = [m.start() for m in re.finditer(rb"\x1f\x8b\x08", data)][-1]
    with store.open_output_stream(f"{root}/{name}", compression=None) as stream:
        stream.write(data[:last])  # the archive now ends before its last member
    with pytest.raises(Exception, match="ManifestError"):
        back.collect()


def test_reader_verifies():
    good = warc.member(1, "http://a", b"payload" * 50)
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n")
    assert [r["payload"] for r in warc.read(io.BytesIO(good + warc.member(2, "", b"")))] == [b"payload" * 50, b""]
    with pytest.raises(EOFError):
        list(warc.read(io.BytesIO(good[:-5])))
    broken = gzip.compress(gzip.decompress(good).replace(b"payload", b"PAYLOAD"))
    with pytest.raises(warc.DigestError):
        list(warc.read(io.BytesIO(broken)))
    cut = gzip.compress(gzip.decompress(good)[:-9])
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(cut)))
