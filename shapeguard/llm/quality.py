"""Line-first cleaning of documents.

Each line is judged alone by punctuation, navigation and boilerplate rules;
failing lines are removed, and a document that loses too much of its text is
rejected. One narrow pass, no shuffle: the state of a document never leaves its
task.

Defined cases: a null or empty text has no words and fails the base rules;
blank lines have no words and are never counted as lost; a line equal to an
earlier line of its document is removed once more for each repeat; rows that
repeat are judged alike; an empty table gives an empty result; further columns
pass through (``clean``) or are ignored (``assess``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.llm.common import small, utf8

SYMBOLS = b"#*$%&|<>"
#: Phrases of page furniture; a short line with one of them is boilerplate.
FURNITURE = re.compile(
    rb"(?i)\b(?:cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|click here|read more|share this|"
    rb"javascript|privacy policy|terms of (?:use|service)|all rights reserved|back to top|skip to)\b"
)
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    max_symbols_per_word: float = 0.25
    max_shouted: float = 0.3
    min_separators: int = 2
    min_separator_share: float = 0.2
    max_boilerplate_words: int = 15
    max_stutter: float = 0.5
    max_lost: float = 0.5


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule that the line fails, or None."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols and line.count(b" | ") >= max(rules.min_separators, rules.min_separator_share * n):
        return "navigation"
    if symbols > max(1, rules.max_symbols_per_word * n):
        return "punctuation"
    if line.count(b"!!") > rules.max_shouted * n:
        return "punctuation"
    if n <= rules.max_boilerplate_words and FURNITURE.search(line):
        return "boilerplate"
    if not LETTER.search(line):
        return "boilerplate"
    if n > 3 and sum(a == b for a, b in zip(words, words[1:])) > rules.max_stutter * n:
        return "stutter"
    return None


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : i + n] for i in range(width)), strict=True))
    if len(set(windows)) == n:
        return 0
    seen: dict[tuple, int] = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = end = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def word_code_points(data: bytes) -> int:
    return len(b"".join(data.split()).decode("utf-8", "surrogatepass"))


def judge(data: bytes, rules: LineRules) -> tuple[dict, bytes]:
    """The figures and verdict of one text, and what is left of it."""
    words = data.split()
    n_dup, lost, total, left, seen = 0, 0, 0, [], set()
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        size = sum(map(len, own))
        total += size
        repeat = line in seen
        n_dup += repeat
        seen.add(line)
        if repeat or line_fault(line, own, rules):
            lost += size
        else:
            left.append(line)
    n_words, n_repeat = len(words), repeated_window_words(words)
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    return {
        "n_words": n_words,
        "word_chars": word_code_points(data),
        "n_symbols": len(data) - len(data.translate(None, SYMBOLS)),
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": not failed and lost <= rules.max_lost * total,
        "lost_share": lost / total if total else 0.0,
    }, b"\n".join(left)


FIGURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("lost_share", T.DoubleType())]
)
ARROW = pa.struct([(f.name, {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString().replace("bigint", "long")]) for f in FIGURES])


def _assess(batches: Iterator[pa.RecordBatch], rules: LineRules) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = [judge(data, rules)[0] for data in utf8(batch.column(1))]
        figures = pa.array(rows, ARROW)
        yield pa.RecordBatch.from_arrays([batch.column(0), *figures.flatten()], names=["doc_id", *FIGURES.names])


def assess(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Figures and verdict for each row: doc_id, the columns of ``FIGURES``."""
    own = docs.select("doc_id", "text")
    schema = T.StructType([own.schema["doc_id"], *FIGURES])
    return own.mapInArrow(partial(_assess, rules=rules), schema)


def _clean(batches: Iterator[pa.RecordBatch], rules: LineRules, at: int, count: int | None) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [judge(data, rules) for data in utf8(batch.column(at))]
        keep = pa.array([figures["kept"] for figures, _ in found], pa.bool_())
        texts = [left.decode("utf-8", "surrogatepass") for _, left in found]
        columns = list(batch.columns)
        columns[at] = pa.array(texts, pa.string())
        if count is not None:
            columns[count] = pa.array([len(t) for t in texts], columns[count].type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their failing lines; same columns."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at, names = docs.columns.index("text"), docs.columns
    count = names.index("n_chars") if "n_chars" in names else None
    return docs.mapInArrow(partial(_clean, rules=rules, at=at, count=count), docs.schema)

#: The default rules in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
i AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 6)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM i) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, range(0, 5) AS g(o) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
m AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS s,
        row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS again FROM l),
f AS (SELECT doc_id, again, list_sum(list_transform(w, lambda x: strlen(x))) AS size,
        (s > 0 AND (length(line) - length(replace(line, ' | ', ''))) / 3 >= greatest(2, 0.2 * len(w))) OR s > greatest(1, 0.25 * len(w))
        OR (length(line) - length(replace(line, '!!', ''))) / 2 > 0.3 * len(w)
        OR (len(w) <= 15 AND regexp_matches(line, '(?i)\b(?:cookies?|subscribe|newsletter|sign (?:in|up)|log ?in|click here|read more|share this|javascript|privacy policy|terms of (?:use|service)|all rights reserved|back to top|skip to)\b'))
        OR NOT regexp_matches(line, '[A-Za-z]|[^\x00-\x7F]')
        OR (len(w) > 3 AND coalesce(list_sum(list_transform(range(1, len(w)), lambda j: CAST(w[j] = w[j + 1] AS INTEGER))), 0) > 0.5 * len(w)) AS fault
      FROM m WHERE len(w) > 0),
q AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(size) FILTER (again OR fault), 0) AS lost, sum(size) AS total FROM f GROUP BY 1),
a AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
      FROM b LEFT JOIN q USING (doc_id) LEFT JOIN p USING (doc_id)),
e AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 * total AS kept,
       CASE WHEN total > 0 THEN CAST(lost AS DOUBLE) / total ELSE 0.0::DOUBLE END AS lost_share FROM e
"""
