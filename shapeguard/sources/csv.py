"""String-faithful CSV ingest.

Records are tokenised by Python's csv reader in Arrow batches, because Spark's own CSV
source reads a short row and an empty cell alike and so can't report ragged rows.
Spark's reader cuts files into lines, in parallel; whether a line begins a record
depends on the quotes before it. So each piece of a file is gone through once for either
state it may begin in (outside or inside a quoted cell); a row for each piece then
tells which of them it was and how many records came before. Lines that are a record
of their own go straight on; only the lines of records with quoted line ends are put
together, by file and record number. The files of a folder are read in the order of
their names, and a header that repeats the first file's is left out.
"""

from __future__ import annotations

import csv
import io
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapeguard.sources.shared import settled
from shapeguard.sources.table import numbered
from shapeguard.types import ROW_ID, ColumnInfo, Dataset

DELIMITERS = (",", ";", "\t", "|")
SNIFFED = 20
WARNING_KINDS = 5
BLANKS = "\t\n\v\f\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
BOM = "﻿"


@dataclass(frozen=True)
class Parsed:
    dataset: Dataset | None
    warnings: tuple[str, ...] = ()
    error: str | None = None

    @property
    def ok(self) -> bool:
        return self.error is None


def sniff(lines: list[str]) -> str:
    """The delimiter that splits the first lines into the steadiest number (over one) of cells."""

    def score(d: str) -> tuple[float, int]:
        widths = [len(next(csv.reader([line], delimiter=d), [])) for line in lines if line.strip()]
        if not widths or max(widths) < 2:
            return (0.0, 0)
        width, hits = Counter(widths).most_common(1)[0]
        return (hits / len(widths) if width > 1 else 0.0, width)

    return max(DELIMITERS, key=score)


def column_names(header: list[str]) -> tuple[list[str], list[str]]:
    """Unique names from a header row, with a warning for each repair."""
    names: list[str] = []
    warnings: list[str] = []
    for i, raw in enumerate(header):
        own = (raw.removeprefix(BOM) if i == 0 else raw).strip(BLANKS)
        if not own:
            own = f"column {i + 1}"
            warnings.append(f'column {i + 1} has an empty header and was named "{own}"')
        name, n = own, 1
        while name in names:
            n += 1
            name = f"{own} ({n})"
        if name != own:
            warnings.append(f'the header "{own}" occurs again and was renamed "{name}"')
        names.append(name)
    return names, warnings


def ends_quoted(text: str, quoted: bool, delimiter: str) -> bool:
    """Whether a quoted cell is open after the text, if one was or wasn't before it."""
    fresh, at, mark = not quoted, 0, re.compile(f"[{re.escape(delimiter)}\r\n]")
    while at < len(text):
        if quoted:
            found = text.find('"', at)
            if found < 0:
                return True
            quoted, at = text.startswith('"', found + 1), found + 1 + text.startswith('"', found + 1)
        elif fresh and text[at] == '"':
            quoted, fresh, at = True, False, at + 1
        else:
            found = mark.search(text, at)
            if not found:
                return False
            fresh, at = True, found.end()
    return quoted


LINES = "file string, block long, n long, begins0 long, begins1 long, inside0 boolean, inside1 boolean, ends0 boolean, ends1 boolean, value string"


def _lines(frames: Iterator[pd.DataFrame], delimiter: str) -> Iterator[pd.DataFrame]:
    """For either state (0: outside, 1: inside a quoted cell) that a piece of a file may begin in:
    how many records have begun in it up to each line, and the state after the line."""
    piece, n, begun, inside = None, 0, [0, 0], [False, True]
    for frame in frames:
        out = []
        for file, block, value in zip(frame["file"], frame["block"], frame["value"], strict=True):
            if piece != (file, block):
                piece, n, begun, inside = (file, block), 0, [0, 0], [False, True]
            begun = [b + (not i) for b, i in zip(begun, inside, strict=True)]
            after = [ends_quoted(value, i, delimiter) for i in inside] if '"' in value else inside
            out.append((file, block, n, *begun, *inside, *after, value))
            inside = after
            n += 1
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LINES.split(", ")])


ROWS = "__file long, __record long, __seq long, __cells array<string>, __fault string"


def _tokenise(frames: Iterator[pd.DataFrame], delimiter: str) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(1 << 30)
    for frame in frames:
        out = []
        for file, record, text in zip(frame["file"], frame["record"], frame["text"], strict=True):
            fault = "unclosedQuote" if '"' in text and ends_quoted(text, False, delimiter) else None
            reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
            try:
                for i, cells in enumerate(reader):
                    if any(c.strip(BLANKS) for c in cells):
                        out.append((file, record, i, cells, fault))
                        fault = None
            except csv.Error as e:
                out.append((file, record, len(out), [text], f"unreadable: {e}"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")])


def pieces(lines: DataFrame) -> DataFrame:
    """file, block, number (of the file), quoted (whether the piece begins inside a cell), before (records
    begun before it): a row for each piece, from one for each that the driver goes through in order."""
    last = F.max_by(F.struct("begins0", "begins1", "ends0", "ends1"), "n").alias("last")
    rows, numbers, state = lines.groupBy("file", "block").agg(last).collect(), {}, (False, 0)
    out = []
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] not in numbers:
            numbers[r["file"]], state = len(numbers), (False, 0)
        quoted, before = state
        out.append((r["file"], r["block"], numbers[r["file"]], quoted, before))
        state = (r["last"]["ends1"], before + r["last"]["begins1"]) if quoted else (r["last"]["ends0"], before + r["last"]["begins0"])
    return lines.sparkSession.createDataFrame(out, "file string, block long, number long, quoted boolean, before long")


def tokenised(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """Records with cells, in file order by (__file, __record, __seq)."""
    read = spark.read.option("lineSep", "\n").text(path)
    placed = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = settled(placed.mapInPandas(partial(_lines, delimiter=delimiter), LINES))
    own = lines.join(pieces(lines), ["file", "block"])
    of = lambda name: F.when(F.col("quoted"), F.col(f"{name}1")).otherwise(F.col(f"{name}0")).alias(name)
    own = own.select(F.col("number").alias("file"), "block", "n", "value", "before", of("begins"), of("inside"), of("ends"))
    own = own.withColumn("record", F.col("before") + F.col("begins") - 1)
    # Where no cell is open before or after a line, it is a record of its own; other lines meet by their record.
    single = own.where(~F.col("inside") & ~F.col("ends")).select("file", "record", F.col("value").alias("text"))
    parts = own.where(F.col("inside") | F.col("ends")).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "n", "value"))).alias("lines"))
    joined = parts.select("file", "record", F.array_join("lines.value", "\n").alias("text"))
    return single.unionByName(joined).mapInPandas(partial(_tokenise, delimiter=delimiter), ROWS)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, row_limit: int | None = None, source_name: str | None = None) -> Parsed:
    """A CSV file as a dataset; problems that leave rows are warnings."""
    from shapeguard.operators.profile import infer_types

    csv.field_size_limit(1 << 30)
    try:
        head = [r["value"] for r in spark.read.text(path).limit(SNIFFED).collect()]
    except Exception as e:  # noqa: BLE001  any reader's failure is the caller's answer
        return Parsed(None, error=f"the file could not be read: {type(e).__name__}")
    delimiter = delimiter or sniff([line.removeprefix(BOM) for line in head])
    order = ["__file", "__record", "__seq"]
    rows = settled(tokenised(spark, path, delimiter))
    first = rows.orderBy(*order).first()
    if first is None or not any(c.strip(BLANKS) for c in first["__cells"]):
        return Parsed(None, error="the file has no header row; its first row has to name the columns")
    names, warnings = column_names(first["__cells"])
    heads = rows.groupBy("__file").agg(F.min(F.struct("__record", "__seq", "__cells")).alias("h")).where("__file > 0")  # a row a further file
    same = F.col("h.__cells") == F.array(*map(F.lit, first["__cells"]))
    heads = settled(heads.select("__file", "h.__record", "h.__seq", same.alias("same")))
    if others := heads.where(~F.col("same")).count():
        warnings.append(f"{others} file(s) begin with another row than the first file's header; that row is taken for data")
    data = rows.join(heads.where("same").drop("same"), order, "left_anti")
    ordered = numbered(data, [F.col(c) for c in order], "__n").where("__n > 0").withColumn("__n", F.col("__n") - 1)
    if row_limit is not None:
        ordered = ordered.where(F.col("__n") < row_limit)
    width, size = len(names), F.size("__cells")
    told = ordered.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(size < width).alias("short"), F.count_if(size > width).alias("long"),
    ).first()
    faults = ordered.where("__fault IS NOT NULL").groupBy("__fault").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__fault").collect()
    warnings += [f"{r['__fault']} ({r['n']} row(s))" for r in faults[:WARNING_KINDS]]
    if len(faults) > WARNING_KINDS:
        warnings.append(f"and {len(faults) - WARNING_KINDS} other kinds of problem")
    if told["short"]:
        warnings.append(f"{told['short']} row(s) had fewer cells than the header; the missing cells are empty")
    if told["long"]:
        warnings.append(f"{told['long']} row(s) had more cells than the header; the extra cells were left out")
    if row_limit is not None and told["rows"] >= row_limit:
        warnings.append(f"only the first {told['rows']} rows were read, as asked")
    cells = [F.coalesce(F.try_element_at("__cells", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    df = ordered.select(F.col("__n").alias(ROW_ID), *cells)
    types = {r["column"]: r["value_type"] for r in infer_types(df, names).collect()}
    infos = tuple(ColumnInfo(n, i, types.get(n, "empty")) for i, n in enumerate(names))
    return Parsed(Dataset(df, infos, source_name or path.rstrip("/").rsplit("/", 1)[-1], told["rows"]), tuple(warnings))


def csv_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), False) for n in names])


__all__ = ["Parsed", "column_names", "csv_schema", "read_csv", "sniff", "tokenised"]
