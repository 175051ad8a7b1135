"""Best-fit decreasing packing of tokenised documents into fixed windows.

Every document is tokenised, followed by an end id, and cut into full windows
plus one remainder. Remainders of one task are packed longest first: a segment
tree over remaining capacities (0 to the window's length) finds the tightest
window still open. Tasks pack on their own, so nothing is shuffled; each leaves
a few part-filled windows at most, whatever the number of documents. A task
places its pieces in rounds, to hold few at once; windows stay open over rounds.

Defined cases: a null or empty text is its end id alone; texts of any length are
cut into full windows; pieces of equal length are placed in the order of their
rows; repeated rows are packed once each; a null doc_id stays null; an empty table
gives no pieces; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import small, strings

WINDOW, END_ID = 4096, 2
#: Pieces that a task holds until they are placed, longest first.
ROUND = 500_000
#: Words of a generation (see ``WordIds``).
KEPT_WORDS = 250_000


def byte_symbols() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes without a printable one."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_SYMBOLS = byte_symbols()
#: A comma or full stop before a blank that follows neither a letter nor a digit.
AFTER_MARK = re.compile(r"[,.](?<=[\W_][,.]) ")


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of a text, by a tokenizer file.

    The tokenizer drops white space and never joins ids across it, so the ids of
    a text are those of its blank-separated parts; each distinct part is encoded
    once and kept. It also lower-cases letter by letter and starts anew between a
    letter or digit and a mark, so capitals and closing marks take their ids from
    the bare word. Letters from U+0130 on may end in a combining mark once they are
    composed and lowered, which joins what follows, so they are left to the tokenizer. Two generations are kept: when the younger is full, it becomes
    the older, and words still in use come back from there.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[str, bytes] = {}
        self.merges = self.tokenizer.model
        probe = "einfachstes garçon"
        plain = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe.split()]
        if plain != [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in map(self.encoded, probe.split())]:
            self.merges = None  # another kind of tokenizer file

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            low = part.lower() if (part.isascii() or max(part) < "\u0130") and "<|" not in part else part
            if low != part:
                ids = self[low]
            elif len(part) > 1 and part[-1] in self.MARKS and part[-2].isalpha() and part[-2] < "\u0130":
                ids = self[part[:-1]] + self[part[-1]]
            else:
                ids = self.encoded(part)
        self[part] = ids
        return ids

    def encoded(self, part: str) -> bytes:
        """One part's ids. Lower-case letters below U+0130 are composed already and
        make one piece, so they go straight to the tokenizer's merges."""
        ascii_only = part.isascii()
        if self.merges and part.isalpha() and part.islower() and (ascii_only or max(part) < "\u0130"):
            symbols = part if ascii_only else part.encode().decode("latin-1").translate(BYTE_SYMBOLS)
            found = [t.id for t in self.merges.tokenize(symbols)]
        else:
            found = self.tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    @staticmethod
    def spaced(text: str) -> str:
        """The text with blanks for its white space. Where it can't change the ids,
        capitals are lowered and closing marks set apart for the whole text at once,
        which leaves fewer different parts: all letters are of Latin-1, and each mark
        before a blank follows a letter or digit."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        if "<|" not in text:
            text = text.lower() + " "
            if text[0] not in ",." and not AFTER_MARK.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    def many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's ids end. Each different
        part of the batch is looked up once; ids are then gathered for all parts."""
        if len(self) > KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        lists = pc.split_pattern(pa.array(map(self.spaced, texts), pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        found = [self[p] for p in coded.dictionary.to_pylist()]
        vocabulary = np.frombuffer(b"".join(found), "<u4")
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        first = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        own = sizes[index]
        ends = np.r_[0, np.cumsum(own)]
        ids = vocabulary[np.repeat(first[index] - ends[:-1], own) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0].tobytes()


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Capacities:
    """A segment tree over remaining capacities: a node is the number of open
    windows below it, and ``take`` finds the smallest capacity that fits."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = self.size + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the tightest open window."""
        count, at = self.count, self.size + least
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


class Windows:
    """Windows by best fit; those with room left stay open."""

    def __init__(self, window: int):
        self.window, self.tree, self.opened = window, Capacities(window), 0

    def place(self, lengths: list[int]) -> list[tuple[int, int]]:
        """(window number, offset) for each length, longest first."""
        placed = [(0, 0)] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            found = self.tree.take(lengths[i])
            if found is None:
                found, self.opened = (self.window, self.opened), self.opened + 1
            capacity, at = found
            placed[i] = at, self.window - capacity
            if capacity > lengths[i]:
                self.tree.add(capacity - lengths[i], at)
        return placed


PIECE = pa.schema([(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, end_id: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    end = end_id.to_bytes(4, "little")
    first_id, windows = TaskContext.get().partitionId() << 40, Windows(window)
    pieces: list[list] = []

    def placed() -> pa.RecordBatch:
        where = windows.place([p[2] for p in pieces])
        columns = [list(c) for c in zip(*pieces, strict=True)] + [[first_id + w for w, _ in where], [o for _, o in where]]
        arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
        pieces.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *PIECE.names])

    for batch in small(batches):
        every, ends = word_ids(path).many(strings(batch.column(1)))
        for doc_id, a, b in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            ids = every[a:b].tobytes() + end
            n = len(ids) // 4
            for start in range(0, n, window):
                own = ids[4 * start : 4 * (start + window)]
                pieces.append([doc_id, start, len(own) // 4, zlib.crc32(own), n])
        if len(pieces) >= ROUND:
            yield placed()
    if pieces:
        yield placed()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in PIECE.names)])
    kind = {"bigint": pa.int64(), "int": pa.int32()}.get(own.schema["doc_id"].dataType.simpleString(), pa.string())
    return own.mapInArrow(partial(_pack, path=tokenizer, window=window, end_id=end_id, id_type=kind), schema)
