"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has one bit for each of 64 hash bits: whether over half of
its shingles' XXH64 values have it. Equal fingerprints are one class from the
start. Classes within the radius of 4 bits share at least two of six bands
whole, so every pair of bands is a block key: 15 narrow rows per class, and each
link's two ends meet in some block. A block larger than ``BLOCK`` is split into
sub-blocks that meet two by two, so no task holds more than two of them and no
pair is missed.

Within a block, fingerprints lie as vertical bit planes. Distances to many
queries are counted at once by carry-save adders over the planes, eight at a
time; words whose every lane has passed the radius are abandoned. A link is kept
only if it joins two parts, so a block gives a spanning forest: fewer links than
members, however dense a group is.

Defined cases: null, empty and blank texts have fingerprint zero and are linked
like any other; texts shorter than a shingle hash their whole word sequence;
repeated rows are each returned; a row without doc_id takes the least id of its
component, null if there is none; an empty table gives an empty result; texts of
any length are taken whole (their shingles' hashes a bounded number at a time); further
columns are ignored, or kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import cut, free, looked_up, small, utf8
from shapeguard.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Six bands of the 64 bits (start, width): RADIUS flips spoil at most four of them.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
BLOCK = 8192
LANES = 64
#: Shingles of a text that are hashed and counted together.
AT_ONCE = 1 << 16


def fingerprint(data: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as a signed long."""
    words = data.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    ends = np.cumsum([len(w) + 1 for w in words])
    text, n = b" ".join(words), max(1, len(words) - size + 1)
    starts = np.r_[0, ends[:-1]][:n]
    stops = ends[size - 1 :] - 1 if len(words) >= size else np.array([len(text)])
    digest, bits = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        own = zip(starts[at : at + AT_ONCE].tolist(), stops[at : at + AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(text[a:b], seed) for a, b in own], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [fingerprint(data) for data in utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_fingerprints, T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType())]))


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of bits, packed into words of 64 lanes."""
    padded = np.zeros(-(-len(prints) // LANES) * LANES, "<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(differing, words: tuple, radius: int = RADIUS) -> np.ndarray:
    """Lanes whose 64 planes differ at most ``radius`` (4 at most 7) times.

    ``differing(b, live)`` gives plane b's differing lanes over the live words. Three
    counter planes and an overflow plane add up; after every eight planes the words
    without a lane left are abandoned.
    """
    full = ~np.uint64(0)
    live = np.arange(int(np.prod(words)))
    ones, twos, fours, over = (np.zeros(len(live), "<u8") for _ in range(4))
    wanted = [full if radius >> i & 1 else np.uint64(0) for i in range(3)]

    def exceeded() -> np.ndarray:
        more, same = np.zeros_like(ones), np.full_like(ones, full)
        for counter, want in ((fours, wanted[2]), (twos, wanted[1]), (ones, wanted[0])):
            more |= same & counter & ~want
            same &= ~(counter ^ want)
        return over | more

    for b in range(0, 64, 2):
        x, y = differing(b, live), differing(b + 1, live)
        carry = (ones & (x | y)) | (x & y)  # carry-save: three planes in, sum and carry out
        ones = ones ^ x ^ y
        carry2 = twos & carry
        twos ^= carry
        over |= fours & carry2
        fours ^= carry2
        if b % 8 == 6 and b < 62:
            alive = exceeded() != full
            if alive.sum() < 0.7 * len(live):
                live, ones, twos, fours, over = (v[alive] for v in (live, ones, twos, fours, over))
                if not len(live):
                    break
    out = np.zeros(int(np.prod(words)), "<u8")
    out[live] = ~exceeded()
    return out.reshape(words)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")[:n].astype(bool)


def pairs_within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a[i] and b[i] are within the radius, for many pairs at once."""
    if not len(a):
        return np.zeros(0, bool)
    own = planes(a ^ b)
    return lanes(within(lambda bit, live: own[bit][live], (own.shape[1],)), len(a))


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one block of different fingerprints."""
    links: list[tuple[int, int]] = []
    slices, n = planes(prints), len(prints)
    label = np.arange(n)
    for c in range(0, n, LANES):  # LANES queries at once against themselves and all later lanes
        query, own = prints[c : c + LANES], slices[:, c // LANES :]
        masks = np.array([np.where(query >> np.uint64(b) & np.uint64(1), ~np.uint64(0), np.uint64(0)) for b in range(64)])
        width = own.shape[1]
        hits = within(lambda b, live: own[b][live % width] ^ masks[b][live // width], (len(query), width))  # noqa: B023
        for i in np.flatnonzero(hits.any(axis=1)):
            near = c + np.flatnonzero(lanes(hits[i], n - c))
            mine = label[c + i]
            others, first = np.unique(label[near], return_index=True)
            if len(others) > 1 or others[0] != mine:
                links += [(c + int(i), int(near[f])) for o, f in zip(others, first, strict=True) if o != mine]
                label[np.isin(label, others)] = mine
    return links


#: Runs up to this length are compared by shifts, all runs of a batch at once.
SHORT = 24


def block_links(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Links within runs of equal keys, as rows of two fingerprints."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    found = []
    for shift in range(1, SHORT):
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (size_of[:-shift] <= SHORT)) if len(keys) > shift else []
        if not len(i):
            break
        i = i[pairs_within(prints[i], prints[i + shift])]
        found.append(np.stack([prints[i], prints[i + shift]], axis=1))
    for at, n in zip(starts[sizes > SHORT], sizes[sizes > SHORT], strict=True):
        own = np.unique(prints[at : at + n])
        linked = forest(own)
        if linked:
            found.append(own[np.array(linked)])
    return np.concatenate(found) if found else np.zeros((0, 2), "<u8")


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive key after key; the last of a batch waits for the next batch."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, "<u8")

    def out(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        found = block_links(keys, prints).astype("<u8").view("<i8")
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False).view("<u8")])
        if len(keys):
            done = int(np.searchsorted(keys == keys[-1], True)) if (keys == keys[-1]).any() else len(keys)
            yield out(keys[:done], prints[:done])
            held_keys, held = keys[done:], prints[done:]
    if len(held_keys):
        yield out(held_keys, held)


def block_rows(classes: DataFrame) -> DataFrame:
    """(key, fp): each class once for every two bands."""
    fp = F.col("fp")
    band = [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in BANDS]
    keys = [
        F.lit(t << 40).bitwiseOR(F.shiftleft(band[i], 20)).bitwiseOR(band[j])
        for t, (i, j) in enumerate(combinations(range(len(BANDS)), 2))
    ]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints that span all components at the radius."""
    rows = block_rows(classes)
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    split = rows.join(large.withColumn("parts", parts), "key", "left")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != own)
    met = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    )
    dealt = split.select("key", "fp", F.explode(met).alias("m")).select(F.xxhash64("key", "m.i", "m.j").alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")


def classes_of(classes: DataFrame) -> DataFrame:
    """(fp, label): each fingerprint's component, named by one of its fingerprints."""
    labels = components(links(classes.select("fp")))
    return classes.join(labels, classes["fp"] == labels["node"], "left").select(*classes.columns, F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id reachable over links."""
    prints = cut(fingerprints(docs), "prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    labelled = cut(classes_of(classes), "labelled")
    roots = cut(labelled.groupBy("label").agg(F.min("least").alias("component_id")), "roots")
    named = cut(looked_up(labelled.select("fp", "label"), roots, "label", labelled.count()).select("fp", "component_id"), "named")
    return looked_up(prints, named, "fp", prints.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the
    least doc_id (nulls last, then the least hash of its text); same columns."""
    text_hash = F.xxhash64(F.col("text").cast("string"))
    # The two columns travel beside the fingerprint as one value, so that it passes through.
    keyed = docs.select(F.struct("doc_id", text_hash.alias("k")).alias("doc_id"), "text")
    prints = cut(fingerprints(keyed).select("doc_id.doc_id", "doc_id.k", "fp"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    # Of each class the least row and how often it stands there, both combined before the shuffle.
    rows = prints.groupBy("fp", "doc_id", "k").agg(F.count(F.lit(1)).alias("times"))
    least = rows.groupBy("fp").agg(F.min(F.struct(order.alias("row"), "times")).alias("r"))
    classes = cut(least, "classes")
    first = classes_of(classes).groupBy("label").agg(F.min("r").alias("r"))
    own_id, own_hash = free(docs.columns, "kept_id", "kept_hash")
    kept = cut(first.select(F.col("r.row.doc_id").alias(own_id), F.col("r.row.k").alias(own_hash), "r.times"), "kept")
    found = docs.join(kept.drop("times"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (text_hash == F.col(own_hash)), "left_semi")
    if kept.where("times > 1").isEmpty():
        return found
    return found.withColumn(own_hash, text_hash).dropDuplicates(["doc_id", own_hash]).drop(own_hash)
