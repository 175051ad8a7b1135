"""Secret scan: three base patterns and a battery of randomness tests.

Base spans come from fixed patterns. The method adds ``random`` spans: of every token
of 20 characters or more that no base span touches, an encoding is inferred (digits,
letters of one case, hex, base32, alphanumeric, base64), and three tests ask whether ordinary
text of that length could look as random: chi-squared uniformity over the encoding's
alphabet, runs of character classes, and serial correlation of neighbouring characters.

What is ordinary is fitted to the corpus's own tokens. Each test gives a standard
score by ``ENCODINGS`` and the two numbers below it, which are a prior worth ``PRIOR``
tokens; the middle and the quartiles of all tokens' scores put the tests on one scale. The
tests depend on each other, so no rule for independent p-values is used: the scores are
summed, and the null distribution of the sum, dependence included, is fitted to the
same tokens' sums. Its tail towards random is the widest that any of the ``LEVELS`` of
those sums shows that are not beyond doubt random (``FAR`` spreads off), so a kind of
ordinary token that looks somewhat random widens it, and never narrower than the prior.
Across the corpus a weighted Benjamini-Hochberg rule decides which tokens count: weights
by length class, rescaled so that their mean over all tested tokens is 1, keep the share of
false finds at ``FALSE_DISCOVERIES`` and ask more of short tokens.

The tokens' scores are a narrow written table; only histograms of fixed size (of
``SCORES`` for each test, and ``BINS`` p-values) are ever collected.

Defined cases: a null or empty text has no spans; texts of any length are scanned whole;
the base spans of one kind never overlap, and tokens that touch a base span are neither
tested nor found again; tokens of one p-value bin count all or none; repeated rows are
scanned alike and their tokens count each time; an empty table gives an empty result;
further columns are ignored, or kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import cut, small, strings

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
SEPARATORS = {ord(c): None for c in "+/_-"}
#: Keyword starts that make ASSIGN worth running; a text without them has no match.
MAYBE_ASSIGN = re.compile(r"[:=]")

# Fixed values, the prior: (name, alphabet pattern, alphabet size, extra chi-squared per character that ordinary text shows over it)
ENCODINGS = (
    ("digits", re.compile(r"[0-9]+"), 10, 0.8),
    ("lower", re.compile(r"[a-z]+"), 26, 1.0),
    ("upper", re.compile(r"[A-Z]+"), 26, 1.0),
    ("hex", re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)"), 16, 0.9),
    ("base32", re.compile(r"[A-Z2-7]+=*"), 32, 1.6),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 62, 3.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+=*"), 64, 3.2),
)
#: Share of class changes in ordinary identifiers, and the size of their standardised lag-1 correlation.
PLAIN_CHANGES, PLAIN_CORRELATION = 0.12, 1.5
#: How many tokens the prior counts for.
PRIOR = 50
#: Scores are counted in tenths, up to this many of them on either side of 0.
SCORES = 400
#: Upper ends of the length classes and the weight of each in the false-discovery rule, before rescaling.
LENGTHS = ((24, 0.5), (32, 0.8), (48, 1.1), (1 << 60, 1.6))
#: p-values are counted in tenths of a decade, down to LEAST_P.
BINS, PER_DECADE, LEAST_P = 400, 10, 1e-39
FALSE_DISCOVERIES = 0.01
TESTS = 3
#: Levels of the normal distribution at which the tail is looked at.
LEVELS = {0.25: -0.6745, 0.16: -0.9945, 0.1: -1.2816, 0.05: -1.6449, 0.02: -2.0537, 0.01: -2.3263}
#: Spreads from the middle beyond which a token says nothing of ordinary ones.
FAR = 4.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, end, kind), in order of start and kind."""
    found = []
    if MAYBE_ASSIGN.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def normal_below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def classes(solid: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.islower() else 2 for c in solid]


def scores(token: str) -> tuple[float, float, float]:
    """The three tests' scores by the inferred encoding; random tokens have low ones."""
    body = token.rstrip("=")
    n = len(body)
    k, extra = next((size, extra) for _, pattern, size, extra in ENCODINGS if pattern.fullmatch(token))
    chi2 = sum(c * c for c in Counter(body).values()) * k / n - n
    uniform = (chi2 - (k - 1) - n * extra) / math.sqrt(2 * (k - 1) + 4 * n * extra)
    solid = body.translate(SEPARATORS) or "0"  # dates and slugs alternate at these, which says nothing
    kinds, n = classes(solid), len(solid)
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    mean = max(n - 1, 1) * PLAIN_CHANGES
    runs = (mean - changes) / math.sqrt(mean * (1 - PLAIN_CHANGES))
    codes = [ord(c) for c in solid]
    mu = sum(codes) / n
    spread = sum((c - mu) ** 2 for c in codes)
    r = sum((a - mu) * (b - mu) for a, b in zip(codes, codes[1:])) / spread if spread else 1.0
    r = max(-0.999, min(0.999, r))
    serial = abs(math.atanh(r)) * math.sqrt(max(1, n - 3)) - PLAIN_CORRELATION
    return uniform, runs, serial


def tested(text: str, base: list[tuple[int, int, str]] | None = None) -> Iterator[tuple[int, int]]:
    """Tokens that no base span touches."""
    found = [m.span() for m in TOKEN.finditer(text)]
    if found:
        base = base_spans(text) if base is None else base
        yield from (f for f in found if not any(s < f[1] and f[0] < e for s, e, _ in base))


def tenth(score: float) -> int:
    return max(-SCORES, min(SCORES, math.floor(score * 10)))


def length_class(length: int) -> int:
    return next(i for i, (most, _) in enumerate(LENGTHS) if length <= most)


@dataclass
class Rule:
    """The fitted null distributions (middle and spread of each test and, last, of their sum), the rescaled weights
    of the length classes, and the lowest bin of p-values that counts."""

    null: dict[int, tuple[float, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = tuple(w for _, w in LENGTHS)
    least: int = BINS

    def score(self, found: Iterable[float]) -> float:
        """The sum of the tests' scores, each by its null distribution."""
        return sum((z - self.null.get(test, (0.0, 1.0))[0]) / self.null.get(test, (0.0, 1.0))[1] for test, z in enumerate(found))

    def p_value(self, found: Iterable[float]) -> float:
        middle, spread = self.null.get(TESTS, (0.0, math.sqrt(TESTS)))
        return max(LEAST_P, normal_below((self.score(found) - middle) / spread))

    def bin(self, length: int, found: Iterable[float]) -> int:
        """Tenths of a decade of the weighted p-value, rounded down."""
        weighted = self.p_value(found) / self.weights[length_class(length)]
        return max(0, min(BINS - 1, math.floor(-math.log10(weighted) * PER_DECADE)))


def quantile(counts: dict[int, int], share: float) -> float:
    """From counts of tenths, the middle of the tenth where the share is reached."""
    total, reached = sum(counts.values()), 0
    for t in sorted(counts):
        reached += counts[t]
        if reached >= share * total:
            return (t + 0.5) / 10
    return 0.0


def fitted(counts: dict[int, int], prior: float = 1.0) -> tuple[float, float]:
    """Middle and spread of most tokens from counts of tenths (the nearer quartile, as either side
    may hold other kinds); the prior's middle is 0."""
    n, middle = sum(counts.values()), quantile(counts, 0.5)
    spread = min(middle - quantile(counts, 0.25), quantile(counts, 0.75) - middle) / -LEVELS[0.25]
    share = n / (n + PRIOR)
    return share * middle, prior + share * max(0.0, spread - prior)


def tail(counts: dict[int, int], prior: float) -> tuple[float, float]:
    """Middle and spread of the null distribution towards random."""
    middle, spread = fitted(counts, prior)
    rest = {t: n for t, n in counts.items() if t / 10 >= middle - FAR * spread}
    n = sum(rest.values())
    return middle, max([spread] + [(quantile(rest, level) - middle) / z for level, z in LEVELS.items() if level * n >= 5])


def rescaled(lengths: dict[int, int]) -> tuple[float, ...]:
    """The length classes' weights with mean 1 over the tokens."""
    total = sum(lengths.values())
    mean = sum(n * LENGTHS[c][1] for c, n in lengths.items()) / total if total else 1.0
    return tuple(w / mean for _, w in LENGTHS)


def least_bin(histogram: dict[int, int], rate: float = FALSE_DISCOVERIES) -> int:
    """The lowest bin that still counts: the largest rejection set whose bound on
    the weighted p-value is at most rate * found / all. ``BINS`` if none does."""
    total, found, least = sum(histogram.values()), 0, BINS
    for b in sorted(histogram, reverse=True):
        found += histogram[b]
        if 10 ** (-b / PER_DECADE) <= rate * found / total:
            least = b
    return least


MEASURED = pa.schema([("length", pa.int32()), *((f"z{i}", pa.float64()) for i in range(TESTS))])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for text in strings(batch.column(0)):
            for start, end in tested(text):
                rows.append({"length": end - start} | {f"z{i}": z for i, z in enumerate(scores(text[start:end]))})
        yield pa.RecordBatch.from_pylist(rows, MEASURED)


def _counts(batches: Iterator[pa.RecordBatch], rule: Rule, sums: bool) -> Iterator[pa.RecordBatch]:
    """How many tokens have each tenth of the summed score, or each bin of p-values."""
    for batch in batches:
        length, *z = (c.to_pylist() for c in batch.columns)
        rows = zip(length, *z, strict=True)
        counts = Counter(tenth(rule.score(found)) if sums else rule.bin(n, found) for n, *found in rows)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64())], names=["value", "n"])


def learn(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> Rule:
    """The corpus-wide rule, from all tokens of all texts."""
    fields = "length int, " + ", ".join(f"z{i} double" for i in range(TESTS))
    tokens = cut(docs.select(F.col("text").cast("string")).mapInArrow(_measure, fields), "tokens")

    def counted(rows: DataFrame) -> dict[int, int]:
        return {r["value"]: r["n"] for r in rows.collect()}

    def by_rule(sums: bool) -> dict[int, int]:
        return counted(tokens.mapInArrow(partial(_counts, rule=rule, sums=sums), "value int, n long").groupBy("value").agg(F.sum("n").alias("n")))

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("test"), tenths(F.col(f"z{i}")).alias("t")) for i in range(TESTS)])).alias("s")
    by_test: dict[int, dict[int, int]] = {}
    for r in tokens.select(each).groupBy("s.test", "s.t").agg(F.count(F.lit(1)).alias("n")).collect():
        by_test.setdefault(r["test"], {})[r["t"]] = r["n"]
    at = F.when(F.lit(False), 0)
    for i, (most, _) in enumerate(LENGTHS):
        at = at.when(F.col("length") <= most, i)
    lengths = counted(tokens.groupBy(at.alias("value")).agg(F.count(F.lit(1)).alias("n")))
    rule = Rule({test: fitted(counts) for test, counts in by_test.items()}, rescaled(lengths))
    if lengths:
        rule.null[TESTS] = tail(by_rule(True), math.sqrt(TESTS))
        rule.least = least_bin(by_rule(False), rate)
    return rule


def tenths(z: Column) -> Column:
    return F.greatest(F.lit(-SCORES), F.least(F.lit(SCORES), F.floor(z * 10))).cast("int")


def all_spans(text: str, rule: Rule) -> tuple[list, list]:
    """Base spans, and base and random spans together."""
    base = base_spans(text)
    more = [(s, e, "random") for s, e in tested(text, base) if rule.bin(e - s, scores(text[s:e])) >= rule.least]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FIELDS = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_spans", pa.string()), ("spans", pa.string())]
SCHEMA = T.StructType([T.StructField(c, T.LongType() if t == pa.int64() else T.StringType()) for c, t in FIELDS])


def _scan(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for text in strings(batch.column(1)):
            base, every = all_spans(text, rule)
            kinds = Counter(kind for _, _, kind in base)
            rows.append({f"n_{k}": kinds[k] for k in KINDS[:3]} | {"base_spans": joined(base), "spans": joined(every)})
        found = pa.array(rows, pa.struct(FIELDS)).flatten()
        yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *SCHEMA.names])


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Spans of every text: doc_id and the columns of ``SCHEMA``."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], *SCHEMA])
    return own.mapInArrow(partial(_scan, rule=learn(docs, rate)), schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of spans replaced by the name of its first kind."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind} removed]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pa.RecordBatch], rule: Rule, at: int, count: int | None) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        columns = list(batch.columns)
        texts = [None if t is None else redacted(t, all_spans(t, rule)[1]) for t in columns[at].to_pylist()]
        columns[at] = pa.array(texts, columns[at].type)
        if count is not None:
            columns[count] = pa.array([len(t or "") for t in texts], columns[count].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """All documents, with secrets replaced; same columns."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at, names = docs.columns.index("text"), docs.columns
    count = names.index("n_chars") if "n_chars" in names else None
    return docs.mapInArrow(partial(_redact, rule=learn(docs, rate), at=at, count=count), docs.schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
