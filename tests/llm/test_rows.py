"""Operators that judge one document at a time, against plain versions."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shapeguard.llm import packing, queries, quality, secrets

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "a b c d e " * 4, "x " * 30000, "é ñ 😀 \x1c y", "same line\nsame line\n\nsame line"]


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    odd = [(10**6 + i, t) for i, t in enumerate(ODD)] + [(9000, "twice"), (9000, "twice"), (None, "no id here")]
    return real + odd


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("a clashing name"))


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    marked = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(words) < 3000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), None if marked is None else len(marked)


def test_quality_base_figures(frame, docs):
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(frame).collect())
    want = sorted(x for _, t in docs if (x := plain_quality(t))[4] is not None)
    assert [g for g in got if g[0] < 3000] == [w for w in want if w[0] < 3000]
    assert len(got) == len(docs)


def test_quality_verdict_drops_junk_and_keeps_prose(spark):
    prose = "The first sentence is plain enough. Another one follows it closely here.\nA second line of prose stands below."
    junk = "Home | About | Help | Contact | News | Shop | Jobs\nA*** b$$$ c%%% d&&& e### f*** g$$$ h%%% i&&& j###"
    rows = spark.createDataFrame([(1, prose), (2, junk), (3, prose + "\nAccept cookies")], "doc_id long, text string")
    kept = {r.doc_id: r for r in quality.clean(rows).collect()}
    assert set(kept) == {1, 3} and kept[3].text == prose
    assert [r.kept for r in quality.assess(rows).orderBy("doc_id").collect()] == [True, False, True]


def test_a_long_line_is_not_navigation_for_two_bars(spark):
    words, others = (" ".join(f"{w}{i}" for i in range(100)) for w in ("word", "other"))
    rows = spark.createDataFrame([(1, f"{words} | cell | {others}"), (2, f"{words}\nHome | About | Help")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in quality.clean(rows).collect()}
    assert kept == {1: f"{words} | cell | {others}", 2: words}
    assert [r.kept for r in quality.assess(rows).collect()] == [True, True]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert quality.assess(none).count() == quality.clean(none).count() == 0
    assert secrets.scan(none).count() == secrets.redact(none).count() == 0
    assert packing.pack(none, queries.word_tokenizer()).count() == 0


def plain_spans(text):
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0),
        ("hex", r"[0-9a-f]+", 24, 0),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(out, key=lambda x: (x[0], ("assign", "access", "hex").index(x[1]))))


def test_secret_base_spans(frame, docs, spark):
    more = ["PassWord = 'abc123'", "token: short", "secret: token: abcdefgh", "api_key=" + "f" * 40, "AKIA" + "Z" * 16, "AKIAAKIA12", "é token=é token=abcdef", "toKen=abcdefgh"]
    rows = docs + [(500 + i, t) for i, t in enumerate(more)]
    got = sorted((r.base_spans, r.n_assign, r.n_access, r.n_hex) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = sorted((s := plain_spans(t), s.count("assign"), s.count("access"), s.count("hex")) for _, t in rows)
    assert got == want


def plain_rule(texts, rate=secrets.FALSE_DISCOVERIES):
    """The rule from a plain list of all tokens."""
    tokens = [(e - s, secrets.scores(t[s:e])) for t in texts for s, e in secrets.tested(t)]
    tenths = lambda values: sorted(max(-400, min(400, math.floor(z * 10))) / 10 + 0.05 for z in values)
    level = lambda zs, share: zs[math.ceil(share * len(zs)) - 1]

    def fit(zs, prior):
        trust, middle = len(zs) / (len(zs) + secrets.PRIOR), level(zs, 0.5)
        spread = min(middle - level(zs, 0.25), level(zs, 0.75) - middle) / 0.6745
        return trust * middle, prior + trust * max(0.0, spread - prior)

    null = {test: fit(tenths(z[test] for _, z in tokens), 1) for test in range(3)} if tokens else {}
    if tokens:
        sums = tenths(sum((x - null[t][0]) / null[t][1] for t, x in enumerate(z)) for _, z in tokens)
        middle, spread = fit(sums, math.sqrt(3))
        rest = [x for x in sums if x - 0.05 >= middle - secrets.FAR * spread - 1e-9]
        null[3] = middle, max([spread, *((level(rest, p) - middle) / z for p, z in secrets.LEVELS.items() if p * len(rest) >= 5)])
    raw = [next(w for most, w in secrets.LENGTHS if n <= most) for n, _ in tokens]
    mean = sum(raw) / len(raw) if raw else 1.0
    rule = secrets.Rule(null, tuple(w / mean for _, w in secrets.LENGTHS))
    bins = sorted((rule.bin(*t) for t in tokens), reverse=True)
    least = secrets.BINS
    for b in sorted(set(bins), reverse=True):
        if 10 ** (-b / 10) <= rate * sum(x >= b for x in bins) / len(bins):
            least = b
    rule.least = least
    return rule


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def ordinary(rng, i):
    word = lambda: rng.choice("section paragraph manual chapter release notes internal customer report archive annual service update".split())
    return rng.choice([
        lambda: f"{word()}_{i}_of_the_long_{word()}_{word()}", lambda: f"{word()}{i % 100}-{word()}{i % 7}-{word()}", lambda: f"20{i % 30:02d}-0{1 + i % 9}-1{i % 9}-{word()}-{word()}-part{i}",
        lambda: "".join(word().title() for _ in range(4)), lambda: word() + word() + word(), lambda: f"/usr/{word()}/{word()}/{word()}{i}/{word()}", lambda: f"{word()}-" * 12 + word(),
        lambda: "0" * rng.randint(20, 40), lambda: "-" * 30, lambda: word().upper() + "_" + word().upper() + "_" + word().upper(),
    ])()


def test_random_tokens_stand_out(spark):
    rng = random.Random(4)
    texts = [f"we saw {''.join(rng.choices(BASE64, k=44))} there" for _ in range(40)]
    plain = [f"see {ordinary(rng, i)} and {ordinary(rng, i + 1)} or {ordinary(rng, i + 2)}" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string").withColumn("z0", F.lit("clash")).withColumn("bin", F.lit(1))
    spans = {r.doc_id: r.spans for r in secrets.scan(frame).collect()}
    assert sum("random:7:51" in spans[i] for i in range(40)) >= 34
    assert not any("random" in spans[i] for i in range(40, 340))  # zeros are hex spans
    rule = plain_rule(texts + plain)
    assert spans == {i: secrets.joined(secrets.all_spans(t, rule)[1]) for i, t in enumerate(texts + plain)}
    kept = {r.doc_id: r.text for r in secrets.redact(frame).collect()}
    assert len(kept) == 340 and "random" not in kept[50] and "[random removed]" in "".join(kept[i] for i in range(40))


@pytest.mark.parametrize("rate, least_power", [(0.001, 0.3), (0.01, 0.45), (0.05, 0.6)])
def test_false_discoveries_stay_under_the_rate(rate, least_power):
    """Planted corpora: the mean share of ordinary tokens among all that are found."""
    shares, power = [], []
    for seed in range(30):
        rng = random.Random(seed)
        n = rng.choice([0, 3, 30, 100])
        planted = {"".join(rng.choices(rng.choice([BASE64, BASE64[:62], "0123456789ABCDEF"]), k=rng.choice([28, 40, 64]))) for _ in range(n)}
        texts = [*planted, *(ordinary(rng, i) for i in range(600))]
        rule = plain_rule(texts, rate)
        found = [t for t in texts if any(k == "random" for _, _, k in secrets.all_spans(t, rule)[1])]
        shares.append(sum(t not in planted for t in found) / max(1, len(found)))
        power += [sum(t in planted for t in found) / n] if n >= 30 else []
    assert sum(shares) / len(shares) <= rate and sum(power) / len(power) > least_power


def test_weights_have_mean_one_and_base_spans_are_not_tested():
    weights = secrets.rescaled({0: 10, 1: 3, 3: 7})
    assert abs(sum(n * weights[c] for c, n in {0: 10, 1: 3, 3: 7}.items()) / 20 - 1) < 1e-12
    assert list(secrets.tested("key " + "ab12" * 8 + " token=" + "Zx9" * 10 + " " + "plainwords" * 3)) == [(74, 104)]


def test_least_bin_is_weighted_benjamini_hochberg():
    assert secrets.least_bin({}) == secrets.BINS
    assert secrets.least_bin({0: 1000}) == secrets.BINS
    assert secrets.least_bin({0: 990, 60: 10}, 0.01) == 60


def test_packing_round_trip(frame, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.word_tokenizer())
    ids = {}
    for i, t in docs:
        ids.setdefault(i, b"".join(x.to_bytes(4, "little") for x in plain.encode(t or "", add_special_tokens=False).ids) + (2).to_bytes(4, "little"))
    pieces = packing.pack(frame, queries.word_tokenizer()).collect()
    assert sum(p.length for p in pieces) == sum(len(ids[i]) // 4 for i, _ in docs)
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) // 4 and zlib.crc32(own[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= 1.1 * sum(p.length for p in pieces) / 4096 + 4 * 3


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [c for c in free if c >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(100 - n)
    assert len({w for w, _ in packing.Windows(100).place(lengths)}) == len(free)
    windows = packing.Windows(100)
    placed = [p for i in range(0, 500, 50) for p in windows.place(lengths[i : i + 50])]  # ten rounds
    room: dict[int, int] = {}
    for (w, offset), n in sorted(zip(placed, lengths)):
        assert offset == room.get(w, 0)
        room[w] = offset + n
    assert max(room.values()) <= 100 and len(room) <= len(free) + 3


def test_word_ids_equal_whole_text_ids():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(queries.word_tokenizer()), random.Random(3)
    own = packing.WordIds(queries.word_tokenizer())
    chars = "ab'sdΣ é́̈  \n\t\r1٣<|endoftext|>😀ſ K\x1c.!"
    for _ in range(400):
        text = "".join(rng.choices(chars, k=rng.randint(0, 40))) + rng.choice(["", "<|endoftext|> x", "don't"])
        want = b"".join(i.to_bytes(4, "little") for i in plain.encode(text, add_special_tokens=False).ids)
        assert own(text) == want
    # Every letter of the Basic Multilingual Plane before marks, alone and after another letter.
    letters = [c for c in map(chr, range(1, 0x10000)) if c.isalpha()]
    texts = [t for c in letters for t in (c + ";", "a" + c + ". x", c.upper() + ", " + c)]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        ids, ends = own.many(part)
        starts = [0, *ends[:-1].tolist()]
        wrong = [t for t, e, a, b in zip(part, plain.encode_batch(part, add_special_tokens=False), starts, ends.tolist()) if e.ids != ids[a:b].tolist()]
        assert not wrong


def test_digest(spark):
    got = queries.op2_secret_scans(spark, SF).orderBy("doc_id").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.base_sha256 == hashlib.sha256(plain_spans(texts[r.doc_id]).encode()).hexdigest() for r in got)
