"""The pipeline, stage by stage, against a brute-force version."""

import hashlib
import itertools
import math
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from test_rows import plain_rule
from shapeguard.llm import quality, queries, secrets, simhash

SF = "/root/testdata/sf0.001"


def plain_poisson(u, mean):
    k, p = 0, math.exp(-mean)
    total = p
    while total < u:
        k += 1
        p *= mean / k
        total += p
    return k


def plain_pipeline(rows):
    """Token counts by document of the mixed corpus."""
    from tokenizers import Tokenizer

    kept = {}
    for r in rows:
        figures, left = quality.judge((r.text or "").encode(), quality.LineRules())
        if figures["kept"]:
            kept[r.doc_id] = (left.decode(), r.source)
    prints = {i: simhash.fingerprint(t.encode()) % 2**64 for i, (t, _) in kept.items()}
    root = {i: i for i in kept}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(kept), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 4:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    alone = {i: kept[i] for i in kept if find(i) == i}
    rule = plain_rule([t for t, _ in alone.values()])
    clean = {i: (secrets.redacted(t, secrets.all_spans(t, rule)[1]), s) for i, (t, s) in alone.items()}
    n = Counter(s for _, s in clean.values())
    tokenizer = Tokenizer.from_file(queries.word_tokenizer())
    out = Counter()
    for i, (t, s) in clean.items():
        mean = len(clean) / len(n) / n[s]
        u = (int(hashlib.md5(f"mix-1|{i}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if copies := plain_poisson(u, mean):
            out[i] = copies * (len(tokenizer.encode(t, add_special_tokens=False).ids) + 1)
    return out


def test_pipeline_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p.doc_id] += p.length
    assert tokens == plain_pipeline(rows)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    assert all(sum(n for _, n in v) <= 4096 for v in by.values())


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "word " * 12 + "\nother words here", "en", "a", 1), (3, "the same twelve words stand here again and again for a test", "en", None, 5), (3, "the same twelve words stand here again and again for a test", "en", None, 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).withColumn("label", F.lit("x")).withColumn("n", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, SF)
            assert out.columns == docs.columns
            out.collect()
    assert Counter(r.doc_id for r in simhash.keep_one(docs).collect()) == {1: 1, 3: 1, None: 1}
    assert corpus_pipeline.packed(spark, docs, SF).count() == 5
