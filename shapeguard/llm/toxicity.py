"""Toxicity: a convolutional text classifier, trained in numpy.

A word is the sum of three hashed embeddings: of the word and of its first five
and four letters, so inflected forms share what their stems have learnt. Filters
of widths 1, 2 and 3 run over the whole text (zero padding at its end), each is
max-pooled, and a logistic layer gives a logit. The first embedding dimension
starts from the smoothed log-odds of its bucket, the rest from small noise;
everything is then trained by Adagrad.

It learns from a sample of labelled rows bounded by ``Training`` (the only bound
here; every text is scored whole). A part of the sample calibrates: a weighted
logistic fit makes 0.5 the even odds at the labels' own class balance, and a
threshold for each language, an extra column that no score depends on, is where
that language's weighted F1 is best.

Defined cases: a null or empty text gets the score of a text without any feature;
texts of any length are scored whole, long ones piece by piece with every window that
the whole text has; repeated rows score alike; a row without doc_id is scored, not held
out and never learnt from; a doc_id with several labels counts as toxic if one of them
is; of rows that share a labelled doc_id the least is learnt from; without labels of both
classes every score is 0; a language too rare to calibrate, unknown or null has the
threshold 0.5; an empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import small, strings

WORD = re.compile(r"\w+")
STEMS = (5, 4)


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample, and the network's size."""

    positives: int = 3000
    negatives: int = 5000
    longest: int = 2000  # words of a text in the sample
    buckets: int = 1 << 15
    dimensions: int = 12
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    batch: int = 64
    rate: float = 0.08
    decay: float = 1e-5
    seed: int = 11
    calibration: int = 5  # one in so many sampled rows calibrates
    rarest: int = 40  # rows of a language that a threshold needs


@dataclass
class Model:
    table: np.ndarray | None = None  # buckets x dimensions
    kernels: list[np.ndarray] = field(default_factory=list)  # width x dimensions x filters
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def buckets(word: str, n: int) -> tuple[int, int, int]:
    whole, *stems = (zlib.crc32(part.encode("utf-8", "surrogatepass")) % n for part in (word, *(f"{k}:{word[:k]}" for k in STEMS)))
    return (whole, *stems)


def keys_of(ids: np.ndarray) -> np.ndarray:
    """Bucket triples (under 2**16 each) as one number a word."""
    ids = ids.astype(np.int64)
    return ids[:, 0] << 32 | ids[:, 1] << 16 | ids[:, 2]


def triples(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys >> 32 & 0xFFFF, keys >> 16 & 0xFFFF, keys & 0xFFFF], axis=-1)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Net:
    """Forward and backward passes over texts given as arrays of word keys."""

    def __init__(self, cfg: Training, odds: np.ndarray):
        rng = np.random.default_rng(cfg.seed)
        self.cfg, d = cfg, cfg.dimensions
        self.table = rng.normal(0, 0.05, (cfg.buckets, d)).astype(np.float32)
        self.table[:, 0] = odds
        self.kernels = [rng.normal(0, 0.3 / w, (w, d, cfg.filters)).astype(np.float32) for w in cfg.widths]
        for kernel in self.kernels:  # a filter of each width starts as a detector of single telling words
            kernel[:, :, 0] = 0
            kernel[0, 0, 0] = 1
        self.bias = [np.zeros(cfg.filters, np.float32) for _ in cfg.widths]
        self.out = rng.normal(0, 0.2, cfg.filters * len(cfg.widths)).astype(np.float32)
        self.out[:: cfg.filters] = 1
        self.out_bias = np.zeros(1, np.float32)
        self.seen = {id(p): np.zeros_like(p) for p in self.parameters()}

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.kernels, *self.bias, self.out, self.out_bias]

    def pooled(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features of each text, the place at which each was found, and the word keys of all
        texts one after the other, each with padding (-1). What a word adds to the filters is
        worked out once for each different word."""
        room, filters = max(self.cfg.widths) - 1, self.cfg.filters
        padding = np.full(room, -1, np.int64)
        keys = np.concatenate([x for t in texts for x in (t, padding)] + [padding])
        sizes = np.array([len(t) for t in texts])
        starts = np.r_[0, np.cumsum(sizes + room)]
        unique, word = np.unique(keys, return_inverse=True)
        own = self.embedded(np.maximum(unique, 0))
        own[unique < 0] = 0
        full = np.flatnonzero(sizes)
        shape = (len(texts), filters * len(self.cfg.widths))
        features, at = np.zeros(shape, np.float32), np.zeros(shape, np.int64)
        if len(full):
            cuts = np.stack([starts[full], starts[full] + sizes[full]], axis=1).ravel()
            lengths = np.diff(np.r_[starts[full], len(keys) - room])
            n = int(starts[-1])
            place = np.arange(n, dtype=np.int32)[:, None]
            for b, (width, kernel, bias) in enumerate(zip(self.cfg.widths, self.kernels, self.bias, strict=True)):
                columns = slice(b * filters, (b + 1) * filters)
                parts = [own @ kernel[j] for j in range(width)]
                c = parts[0][word[:n]]
                for j in range(1, width):
                    c += parts[j][word[j : n + j]]
                top = np.maximum.reduceat(c, cuts, axis=0)[::2]
                lead = np.zeros((int(starts[full[0]]), filters), np.float32)
                first = np.where(c == np.concatenate([lead, np.repeat(top, lengths, axis=0)]), place, n)
                at[full, columns] = np.minimum.reduceat(first, cuts, axis=0)[::2]
                features[full, columns] = np.maximum(top + bias, 0)
        return features, at, keys

    def embedded(self, keys: np.ndarray) -> np.ndarray:
        return self.table[triples(keys)].sum(axis=-2)

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        features, at, keys = self.pooled(texts)
        z = features @ self.out + self.out_bias[0]
        d = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(texts)).astype(np.float32)
        back = d[:, None] * self.out * (features > 0)
        grads = [np.zeros_like(k) for k in self.kernels] + [np.zeros_like(b) for b in self.bias] + [d @ features, d.sum(keepdims=True)]
        n, rows, row_grads = len(self.cfg.widths), [], []
        for b, width in enumerate(self.cfg.widths):
            own = slice(b * self.cfg.filters, (b + 1) * self.cfg.filters)
            g = back[:, own]
            grads[n + b] += g.sum(axis=0)
            for j in range(width):
                found = keys[at[:, own] + j]
                used = (g != 0) & (found >= 0)
                filter_ = np.nonzero(used)[1]
                own_g = g[used][:, None]
                np.add.at(grads[b][j].T, filter_, self.embedded(found[used]) * own_g)
                rows.append(triples(found[used]))
                row_grads.append(self.kernels[b][j].T[filter_] * own_g)
        for p, g in zip(self.parameters()[1:], grads, strict=True):
            self.move(p, slice(None), g + self.cfg.decay * p)
        each = np.concatenate(rows)
        if len(each):
            g = np.repeat(np.concatenate(row_grads), each.shape[1], axis=0)
            unique, inverse = np.unique(each.ravel(), return_inverse=True)
            order = np.argsort(inverse, kind="stable")
            total = np.add.reduceat(g[order], np.searchsorted(inverse[order], np.arange(len(unique))), axis=0)
            self.move(self.table, unique, total + self.cfg.decay * self.table[unique])

    def move(self, p: np.ndarray, where, g: np.ndarray) -> None:
        seen = self.seen[id(p)]
        seen[where] += g * g
        p[where] -= self.cfg.rate * g / (np.sqrt(seen[where]) + 1e-6)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        found = [self.pooled(texts[i : i + self.cfg.batch])[0] for i in range(0, len(texts), self.cfg.batch)]
        return (np.concatenate(found) @ self.out + self.out_bias[0]).astype(float)


def log_odds(texts: list[np.ndarray], y: np.ndarray, cfg: Training) -> np.ndarray:
    """A third of each bucket's smoothed log-odds by texts (a word sums three buckets)."""
    count = np.zeros((2, cfg.buckets))
    for ids, label in zip(texts, y, strict=True):
        count[int(label), np.unique(triples(np.unique(ids)))] += 1
    n = np.maximum(1, np.bincount(y.astype(int), minlength=2))
    rate = (count + 0.5) / (n[:, None] + 1)
    trust = count.sum(axis=0) / (count.sum(axis=0) + 2)
    return (np.log(rate[1] / rate[0]) * trust / 3).astype(np.float32)


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a weighted logistic fit, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(r * z).sum() + 1e-2 * (a - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -2, 2))
    return max(a, 1e-3), b


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which the weighted F1 is best; the nearest to 0.5 of equals."""
    edges = np.unique(score)
    cuts = np.append((edges[1:] + edges[:-1]) / 2, 0.5)
    right = np.array([(weight * y * (score >= c)).sum() for c in cuts])
    wrong = np.array([(weight * (y != (score >= c))).sum() for c in cuts])
    f1 = 2 * right / np.maximum(2 * right + wrong, 1e-9)
    good = cuts[f1 >= f1.max() - 1e-9]
    return float(good[np.abs(good - 0.5).argmin()])


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], ranks: np.ndarray, balance: tuple[int, int], cfg: Training = Training()) -> Model:
    """``ranks`` deals the rows to calibration; ``balance``: labels 0 and 1 in the whole table."""
    if not len(y) or y.min() == y.max():
        return Model()
    weight = np.array([balance[0] / (y == 0).sum(), balance[1] / (y == 1).sum()])[y.astype(int)]
    weight = weight / weight.mean()
    aside = ranks % cfg.calibration == 0
    if len({*y[aside]}) < 2:
        aside = np.ones(len(y), bool)
    used = np.flatnonzero(~aside) if len({*y[~aside]}) == 2 else np.arange(len(y))
    net = Net(cfg, log_odds([texts[i] for i in used], y[used], cfg))
    rng = np.random.default_rng(cfg.seed)
    for _ in range(cfg.epochs):
        order = rng.permutation(used)
        for at in range(0, len(order), cfg.batch):
            own = order[at : at + cfg.batch]
            net.step([texts[i] for i in own], y[own], np.ones(len(own)))
    kept = np.flatnonzero(aside)
    z = net.logits([texts[i] for i in kept])
    scale, shift = platt(z, y[kept], weight[kept])
    score = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
    # Even odds where F1 is best, so 0.5 is the one threshold without a language.
    even = best_threshold(score, y[kept], weight[kept])
    shift -= float(np.log(np.clip(even, 1e-6, 1 - 1e-6) / (1 - np.clip(even, 1e-6, 1 - 1e-6))))
    score = 1 / (1 + np.exp(-np.clip(scale * z + shift, -30, 30)))
    thresholds = {}
    for lang in {x for x in langs if x is not None}:
        own = np.array([langs[i] == lang for i in kept])
        if own.sum() >= cfg.rarest and 0 < y[kept][own].sum() < own.sum():
            thresholds[lang] = best_threshold(score[own], y[kept][own], weight[kept][own])
    return Model(net.table, net.kernels, net.bias, net.out, float(net.out_bias[0]), scale, shift, thresholds)


def _features(batches: Iterator[pa.RecordBatch], cfg: Training) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        out = []
        for text in strings(batch.column(0)):
            own = words(text)
            ids = np.array([buckets(w, cfg.buckets) for w in own], "<u2").tobytes() if len(own) <= cfg.longest else None
            out.append(ids)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["ids", "toxic", "lang", "rank"])


def learn(docs: DataFrame, labels: DataFrame, cfg: Training = Training()) -> Model:
    """Train on a sample of labelled rows that aren't held out."""
    told = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ranked = told.where("doc_id IS NOT NULL").withColumn("rank", F.xxhash64("doc_id"))
    counted = {r["toxic"]: r["n"] for r in ranked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [ranked.where(F.col("toxic") == y).orderBy("rank", "doc_id").limit(n) for y, n in ((1, cfg.positives), (0, cfg.negatives))]
    bounded = F.broadcast(sample[0].union(sample[1]))  # positives + negatives rows at most
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    texts = own.join(bounded, "doc_id").select("text", "toxic", "lang", "rank")
    rows = texts.mapInArrow(partial(_features, cfg=cfg), "ids binary, toxic int, lang string, rank long").where("ids IS NOT NULL")
    # A row for each sampled doc_id, however often it occurs: positives + negatives rows at most.
    single = rows.groupBy("rank", "toxic").agg(F.min(F.struct("ids", "lang")).alias("r")).select("rank", "toxic", "r.ids", "r.lang")
    found = sorted(single.collect(), key=lambda r: (r["rank"], r["toxic"]))
    ids = [keys_of(np.frombuffer(bytes(r["ids"]), "<u2").reshape(-1, 1 + len(STEMS))) for r in found]
    y = np.array([r["toxic"] for r in found], np.float32)
    ranks = np.array([r["rank"] % 1000003 for r in found], np.int64)
    return train(ids, y, [r["lang"] for r in found], ranks, (counted.get(0, 0), counted.get(1, 0)), cfg)


class Scorer:
    """Scores many texts at once. What a word adds to each filter at each place is
    kept for the words met so far, so a text is a few gathers and a segmented maximum."""

    KEPT, CHUNK = 150_000, 200_000

    def __init__(self, model: Model):
        self.model = model
        self.columns = np.concatenate([k.transpose(1, 0, 2).reshape(k.shape[1], -1) for k in model.kernels], axis=1)
        self.known: dict[str, int] = {}
        self.parts = np.zeros((self.KEPT + 1, self.columns.shape[1]), np.float32)  # row 0: padding

    def ids(self, own: list[str]) -> list[int]:
        try:
            return [self.known[w] for w in own]
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(own) if w not in self.known]
        n = len(self.known)
        triples = np.array([buckets(w, len(self.model.table)) for w in new])
        self.parts[n + 1 : n + 1 + len(new)] = self.model.table[triples].sum(axis=1) @ self.columns
        self.known.update(zip(new, range(n + 1, n + 1 + len(new)), strict=True))
        return [self.known[w] for w in own]

    def pooled(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Features of the texts at [start, end) of ``ids``, each followed by padding."""
        full, at, out = ends > starts, 0, []
        cuts = np.stack([starts[full], ends[full]], axis=1).ravel()
        for kernel, bias in zip(self.model.kernels, self.model.bias, strict=True):
            width, _, n = kernel.shape
            features = np.zeros((len(starts), n), np.float32)
            if full.any():
                c = self.parts[ids, at : at + n]
                for j in range(1, width):
                    c[: len(ids) - j] += self.parts[ids[j:], at + j * n : at + (j + 1) * n]
                features[full] = np.maximum(np.maximum.reduceat(c, cuts, axis=0)[::2] + bias, 0)
            out.append(features)
            at += width * n
        return np.concatenate(out, axis=1)

    def long_text(self, own: list[str]) -> np.ndarray:
        """Features of one text of any length: the maximum over its pieces, each followed by
        the words that follow it in the text, so that every window is seen whole and once."""
        step, more = self.CHUNK // 2, max(k.shape[0] for k in self.model.kernels) - 1
        found = [self.features([own[s : s + step]], [own[s + step : s + step + more]])[0] for s in range(0, len(own), step)]
        return np.maximum.reduce(found)

    def features(self, texts: list[list[str]], after: list[list[str]] | None = None) -> np.ndarray:
        """Features of texts; ``after`` are words that windows may reach into but not begin at."""
        room = max(k.shape[0] for k in self.model.kernels) - 1
        after = after or [[]] * len(texts)
        if len(self.known) + sum(map(len, texts)) + room > self.KEPT and len(self.known) + len(set().union(*texts, *after)) > self.KEPT:
            self.known.clear()
        ids, starts, ends = [], [], []
        for own, tail in zip(texts, after, strict=True):
            starts.append(len(ids))
            ids += self.ids(own)
            ends.append(len(ids))
            ids += self.ids(tail) + [0] * (room - len(tail))
        ids.append(0)
        return self.pooled(np.array(ids), np.array(starts, np.int64), np.array(ends, np.int64))

    def scores(self, texts: list[str]) -> np.ndarray:
        m, rows, held, n = self.model, [], [], 0
        for text in texts:
            own = words(text)
            if held and n + len(own) > self.CHUNK // 2:
                rows.append(self.features(held))
                held, n = [], 0
            if len(own) > self.CHUNK // 2:
                rows.append(self.long_text(own)[None])
            else:
                held.append(own)
                n += len(own)
        if held:
            rows.append(self.features(held))
        z = np.concatenate(rows) @ m.out + m.out_bias if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(m.scale * z + m.shift, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(model) if model.table is not None else None
    for batch in small(batches):
        texts = strings(batch.column(2))
        found = scorer.scores(texts).astype(np.float64) if scorer else np.zeros(len(texts))
        limits = np.array([model.thresholds.get(x, 0.5) for x in batch.column(3).to_pylist()], np.float64)
        predicted = pa.array((found >= 0.5).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found), predicted, pa.array(limits), pa.array(found >= limits)],
            names=["doc_id", "held_out", "score", "predicted", "lang_threshold", "flagged"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, flagged, for every row."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    own = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang"))
    schema = T.StructType(
        [own.schema["doc_id"], own.schema["held_out"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
        + [T.StructField("lang_threshold", T.DoubleType()), T.StructField("flagged", T.BooleanType())]
    )
    return own.mapInArrow(partial(_score, model=model), schema)
