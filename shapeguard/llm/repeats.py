"""Removal of repeated 200-byte strings by prefix-free parsing.

Triggers are places in a text chosen by a rolling hash: of the 153 48-byte
strings inside a 200-byte window, the one with the least hash (the leftmost of
equals). Taking minima instead of a modulus bounds the gap between triggers, so
every window has one and equal windows have it at the same place. The windows of
one trigger are neighbours; their bytes are cut at the trigger into two phrases,
which overlap in it: one that ends with the trigger and one that begins with it.
Windows can only be equal where their triggers are, so the parse falls into parts,
one a trigger, that are ordered apart from each other:

1. Triggers that occur once in the corpus are dropped: their windows are unique.
2. Pairs of phrases that occur twice or more are repeated whole, and one stands for all.
3. Of the rest, the dictionary of a trigger holds its different phrases. The suffix
   array of those that end with the trigger (all their suffixes end alike, so it is the
   order of the phrases read backwards) has the longest common suffix of each with the
   one before it; the suffix array of the parse, in which every suffix is one phrase from
   the trigger on, has longest common prefixes. Both combine into the order of the
   corpus: the suffixes that start l bytes ahead of the trigger are sorted by the class
   of these l bytes in the dictionary's array and then by their rank in the parse's.
   Neighbours there are equal windows if they are of one class and the prefixes of
   the parse agree for the other 200 - l bytes.

A trigger with more than ``HOT`` different pairs gets longer triggers by the same rule:
windows that start far ahead of it share the bytes before it, the others share
those behind it, so each half is dealt by the bytes that all its equal windows share;
and again, until few share them or the window is shared whole. So no task holds
a hot trigger, and every part is ordered as any other.

Texts are parsed once, into a written table of occurrences; they travel once to cut
out the phrases of step 3 and once to be cleaned. Counts combine before they are
shuffled, and triggers and phrases with very many occurrences meet them in
broadcast tables of bounded size (``common.MOST_HOT`` rows).

Defined cases: null and empty texts stay empty; texts under 200 bytes keep
everything; texts of any length are parsed whole; matches never cross documents; rows
that repeat are copies of each other (and removed, if long enough), though equal rows
are cut and found once for all of them; a row without doc_id is treated like any
other; an empty table gives an empty result; further columns are ignored, whatever
their names. Phrases are told apart by 128 bits of two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import LEAST_HOT, MOST_HOT, cut, small, utf8

LENGTH, TRIGGER = 200, 48
#: Different pairs of phrases of one trigger that a task takes; with more of them it gets longer triggers.
HOT = 4096
#: Bytes of texts that are parsed together, and phrases that are ordered together.
BUFFER, ORDERED = 2 << 20, 20_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Rolling hashes of all strings of one width in a buffer."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if len(self.up) < n + 1:
            self.up, self.down = powers(BASE, n + 1), powers(INVERSE, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * self.down[:n], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * self.up[: n - width + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def phrases(data: np.ndarray, ends: np.ndarray, rolling: Rolling, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Trigger hash, trigger place, first and last window of each phrase; ``ends``: where the texts in ``data`` end."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    hashes = rolling(data, trigger)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_min(ranked, length - trigger + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.r_[0, ends[:-1]]
    inside = np.zeros(len(data) + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(valid):
        return none.astype(np.uint64), none, none, none
    at = place[valid]
    new = np.r_[True, (at[1:] != at[:-1]) | (valid[1:] != valid[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(valid)] - 1
    return hashes[at[first]], at[first], valid[first], valid[last]


OCCURRENCE = pa.schema(
    [("trigger", pa.int64()), ("phrase", pa.int64()), ("d", pa.int64()), ("k", pa.int64()), ("at", pa.int32()), ("before", pa.int16()), ("back", pa.int16())]
)
OCCURRENCE_SQL = "trigger long, phrase long, d long, k long, at int, before short, back short"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases: before and back are how far ahead of the trigger its first and last window start."""
    rolling = Rolling()

    def parsed(texts: list[bytes], d: list[int], k: list[int]) -> pa.RecordBatch:
        joined = b"".join(texts)
        data, ends = np.frombuffer(joined, np.uint8), np.cumsum([len(t) for t in texts])
        trigger, at, first, last = phrases(data, ends, rolling)
        view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
        names = np.array([digest(view[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
        doc = np.searchsorted(ends, first, side="right")
        starts = np.r_[0, ends[:-1]]
        columns = [trigger.view(np.int64), names.view(np.int64), np.array(d, np.int64)[doc], np.array(k, np.int64)[doc], (at - starts[doc]).astype(np.int32)]
        columns += [(at - first).astype(np.int16), (at - last).astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=OCCURRENCE)

    for batch in small(batches):
        texts, d, k, size = [], [], [], 0
        for text, x, y in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if len(text) < LENGTH:
                continue
            texts.append(text)
            d.append(x)
            k.append(y)
            size += len(text)
            if size >= BUFFER:
                yield parsed(texts, d, k)
                texts, d, k, size = [], [], [], 0
        if texts:
            yield parsed(texts, d, k)


def sorted_phrases(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary of equal-width phrases in order: the rank of each row's phrase, and for each
    rank the longest common prefix with the one before it (-1 where a group begins)."""
    keyed = np.concatenate([groups.astype(">u8").view(np.uint8).reshape(-1, 8), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    own = keyed[order]
    differ = own[1:] != own[:-1]
    new = differ.any(axis=1)
    common = differ.argmax(axis=1)[new] - 8
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(np.r_[0, new])
    return rank, np.r_[-1, np.maximum(common, -1)]


def shared_windows(
    groups: np.ndarray, texts: list[bytes], before: np.ndarray, back: np.ndarray, low: np.ndarray, high: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER
) -> np.ndarray:
    """For each text around a trigger and each distance l (low to high) ahead of it, whether the
    window there also stands in another text of the same group."""
    n, reach = len(texts), length - trigger + 1
    ends_with, begins_with = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
    for i, (text, b) in enumerate(zip(texts, before.tolist(), strict=True)):
        row = np.frombuffer(text, np.uint8)
        ends_with[i, :b] = row[:b][::-1]
        begins_with[i, : len(row) - b] = row[b:]
    word, common_suffix = sorted_phrases(ends_with, groups)  # the dictionary's suffix array
    suffix, common_prefix = sorted_phrases(begins_with, groups)  # the parse's
    first, last = np.maximum(back, low), np.minimum(before, high)
    out = np.zeros((n, reach), bool)
    for at in range(int(first.min(initial=reach)), int(last.max(initial=-1)) + 1):
        has = np.flatnonzero((first <= at) & (at <= last))
        if len(has) < 2:
            continue
        same_head = np.cumsum(common_suffix < at)[word[has]]
        same_rest = np.cumsum(common_prefix < length - at)[suffix[has]]
        order = np.lexsort((suffix[has], same_head))  # the corpus, from l bytes ahead of its triggers on
        equal = (same_head[order][1:] == same_head[order][:-1]) & (same_rest[order][1:] == same_rest[order][:-1])
        out[has[order], at] = np.r_[equal, False] | np.r_[False, equal]
    return out


def byte_ranges(flags: np.ndarray, length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Byte ranges, relative to the trigger, that the flagged windows cover."""
    found = np.flatnonzero(flags)
    if not len(found):
        return [], []
    new = np.flatnonzero(np.r_[True, np.diff(found) > 1])
    nearest, furthest = found[new], found[np.r_[new[1:], len(found)] - 1]
    return (-furthest).tolist(), (length - nearest).tolist()


RANGE = pa.schema([("trigger", pa.int64()), ("phrase", pa.int64()), ("begin", pa.list_(pa.int32())), ("end", pa.list_(pa.int32()))])
RANGE_SQL = "trigger long, phrase long, begin array<int>, end array<int>"
PART = ("key", "low", "high", "trigger", "phrase", "n", "before", "back", "text")


def ranges(columns: dict[str, list]) -> pa.RecordBatch:
    """Ranges of the phrases that occur once (the others are repeated whole)."""
    groups = np.array(columns["key"], np.int64).view(np.uint64)
    bounds = [np.array(columns[c], np.int64) for c in ("before", "back", "low", "high")]
    flags = shared_windows(groups, columns["text"], *bounds)
    rows = []
    for i in np.flatnonzero(flags.any(axis=1)):
        if columns["n"][i] == 1:
            begin, end = byte_ranges(flags[i])
            rows.append({"trigger": columns["trigger"][i], "phrase": columns["phrase"][i], "begin": begin, "end": end})
    return pa.RecordBatch.from_pylist(rows, RANGE)


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come key by key; whole keys are ordered together."""
    held: dict[str, list] = {c: [] for c in PART}
    for batch in batches:
        for name, values in held.items():
            values += batch.column(batch.schema.get_field_index(name)).to_pylist()
        own = held["key"]
        if len(own) >= ORDERED and own[0] != own[-1]:
            whole = own.index(own[-1])
            yield ranges({c: v[:whole] for c, v in held.items()})
            held = {c: v[whole:] for c, v in held.items()}
    if held["key"]:
        yield ranges(held)


def counted(parts: DataFrame) -> DataFrame:
    """Keys of which some window may be found: how many rows each has."""
    sizes = parts.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    return sizes.where("m > 1 AND least = 1").drop("least")


def lengthened(parts: DataFrame) -> DataFrame:
    """Each part as two with longer triggers: the bytes that all equal windows of a half share."""
    middle = F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("l"), F.col("high").alias("h")), F.struct(F.col("low").alias("l"), (middle - 1).alias("h")))
    half = parts.withColumn("half", F.explode(halves)).withColumns({"low": F.col("half.l"), "high": F.col("half.h")}).drop("half")
    own = half.where((F.col("before") >= F.col("low")) & (F.col("back") <= F.col("high")))
    shared = F.substring(F.col("text"), F.col("before") - F.col("low") + 1, F.col("low") + F.lit(LENGTH) - F.col("high"))
    return own.withColumn("key", F.xxhash64("trigger", "low", "high", shared))


def found_ranges(parts: DataFrame, hot: int) -> DataFrame:
    """Ranges of all parts; keys with over ``hot`` rows are dealt by longer triggers, until a key is one window."""
    out = None
    while True:
        sizes = counted(parts).where(F.col("m") > hot)
        many = cut(sizes.select("key", F.col("m").alias("n")), "many")
        if many.isEmpty():
            some, large = parts, None
        else:
            total = parts.count()
            often, others = among(parts, many, ["key"], total)
            large = cut(often.unionByName(others), "large")
            limit = max(LEAST_HOT, total // MOST_HOT)
            some = parts.join(F.broadcast(many.where(F.col("n") > limit)), "key", "left_anti").join(many.where(F.col("n") <= limit), "key", "left_anti")
        found = some.select(*PART).repartition("key").sortWithinPartitions("key").mapInArrow(_order, RANGE_SQL)
        out = found if out is None else out.unionByName(found)
        if large is None:
            return out
        single = large.where("low = high AND n = 1")  # the key is the window, and it occurs again
        each = [F.array((F.lit(x) - F.col("low")).cast("int")).alias(name) for x, name in ((0, "begin"), (LENGTH, "end"))]
        out = out.unionByName(single.select("trigger", "phrase", *each))
        parts = cut(lengthened(large.where("low < high")), "parts")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (d, k); rows that share both are equal in every way that counts."""
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)) if whole else F.xxhash64("doc_id")
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.withColumns({"d": d, "k": F.xxhash64("text")})


def phrase_bytes(text: Column) -> Column:
    before, back = F.col("before").cast("int"), F.col("back").cast("int")
    return F.substring(text.cast("binary"), F.col("at") - before + 1, before - back + F.lit(LENGTH))


def among(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``keys`` (on, n: rows of it): those of frequent keys, at most
    ``MOST_HOT`` of them and broadcast, and the others, joined by shuffle."""
    limit = max(LEAST_HOT, total // MOST_HOT)
    often = F.broadcast(keys.where(F.col("n") > limit).select(*on))
    return rows.join(often, on, "left_semi"), rows.join(often, on, "left_anti").join(keys.where(F.col("n") <= limit).select(*on), on, "left_semi")


def repeated_ranges(own: DataFrame, copies: DataFrame, several: bool, hot: int = HOT) -> DataFrame:
    """(d, k, spans): for every text with repeats, byte ranges (a list of begin and end)."""
    parsed = cut(own.select("text", "d", "k").mapInArrow(_parse, OCCURRENCE_SQL), "parse")
    often = cut(parsed.groupBy("trigger").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    frequent, others = among(parsed, often, ["trigger"], parsed.count())
    occurrences = cut(frequent.unionByName(others), "occurrences")
    once = [F.first(c).alias(c) for c in ("d", "k", "at")]  # one row's, as all come from the same update
    by = ["trigger", "phrase", "before", "back"]
    dictionary = cut(occurrences.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *once), "dictionary")
    compared = cut(counted(dictionary.withColumn("key", F.col("trigger"))).select(F.col("key").alias("trigger"), F.col("m").alias("n")), "compared")
    frequent, others = among(dictionary, compared, ["trigger"], dictionary.count())
    near = frequent.unionByName(others)
    texts = own.select(F.col("d").alias("td"), F.col("k").alias("tk"), "text")
    if several:  # equal rows are cut once; their texts combine before the shuffle
        same = copies.select(F.col("d").alias("td"), F.col("k").alias("tk"))
        single = texts.join(same, ["td", "tk"], "left_semi").groupBy("td", "tk").agg(F.first("text").alias("text"))
        texts = texts.join(same, ["td", "tk"], "left_anti").unionByName(single)
    at_text = near.join(texts, (F.col("d") == F.col("td")) & (F.col("k") == F.col("tk")))
    whole_reach = {"key": F.col("trigger"), "low": F.lit(0), "high": F.lit(LENGTH - TRIGGER)}
    cast = [F.col(c).cast("int").alias(c) for c in ("before", "back")]
    parts = cut(at_text.select("trigger", "phrase", "n", *cast, phrase_bytes(F.col("text")).alias("text")).withColumns(whole_reach), "phrases")
    some = found_ranges(parts, hot)
    # What occurs again is repeated whole: its range is the occurrence's own.
    span = ["d", "k", "at", "begin", "end"]
    begin, end = F.array(-F.col("before").cast("int")), F.array(F.lit(LENGTH) - F.col("back").cast("int"))
    frequent, others = among(occurrences, dictionary.where("n > 1").select(*by, "n"), by, occurrences.count())
    whole = frequent.unionByName(others).withColumns({"begin": begin, "end": end}).select(*span)
    found = whole.unionByName(occurrences.join(some, ["trigger", "phrase"]).select(*span))
    found = found.distinct() if several else found
    return found.groupBy("d", "k").agg(F.collect_list(F.struct("at", "begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((begin, end))
    return out


def _remove(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] if texts else []
    for batch in small(batches):
        rows = []
        for data, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            spans = merged([(s["at"] + b, s["at"] + e) for s in found or () for b, e in zip(s["begin"], s["end"], strict=True)])
            ends = [0, *(e for _, e in spans)]
            kept = b"".join(data[a:b] for a, b in zip(ends, [*(b for b, _ in spans), len(data)], strict=True))
            row = {"n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            rows.append(row | ({"kept": kept} if texts else {}))
        yield pa.RecordBatch.from_arrays([batch.column(0), *pa.array(rows, pa.struct(fields)).flatten()], names=["doc_id", *(f for f, _ in fields)])


def remove_repeats(docs: DataFrame, texts: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes."""
    own = keyed(docs)
    copies = cut(own.groupBy("d", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    several = not copies.isEmpty()
    spans = repeated_ranges(own, copies, several, hot).select(F.col("d").alias("sd"), F.col("k").alias("sk"), "spans")
    salted, on = own, (F.col("d") == F.col("sd")) & (F.col("k") == F.col("sk"))
    if several:  # equal rows in great number are dealt over as many copies of their spans, which are all the same
        total = copies.agg(F.sum("n")).first()[0]
        limit = max(LEAST_HOT, total // MOST_HOT)
        parts = F.broadcast(copies.where(F.col("n") > limit).select("d", "k", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
        part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)).cast("int")
        salted = own.join(parts, ["d", "k"], "left").withColumn("salt", part)
        each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("of")
        spans = spans.join(parts, (F.col("d") == F.col("sd")) & (F.col("k") == F.col("sk")), "left").select("sd", "sk", "spans", each)
        on = on & (F.col("salt") == F.col("of"))
    joined = salted.join(spans, on, "left").select("doc_id", "text", "spans")
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return joined.mapInArrow(partial(_remove, texts=texts), schema.add("kept", T.BinaryType()) if texts else schema)
