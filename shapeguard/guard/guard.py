"""The guard: the only way to ask about a dataset.

It holds the DataFrame in a closure and answers with plain values, never with rows
or DataFrames. Each question is validated, charged, computed and suppressed in that
order; a refusal costs nothing unless it had to be computed to be known. Python can
be inspected from inside its own process, so this is policy, not isolation.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapeguard.functions.formats import UNRECOGNISED
from shapeguard.functions.mask import script_note
from shapeguard.guard.policy import DEFAULT_K, QUERIES_PER_COLUMN, Budget, check_k, withheld
from shapeguard.operators import aggregate as agg
from shapeguard.operators import dedupe, issues, profile, transforms
from shapeguard.plans.predicate import compile_query
from shapeguard.sources.shared import settled
from shapeguard.sources.table import quoted
from shapeguard.types import COMPARABLE, ROW_ID, Answered, Applied, ColumnInfo, Dataset, Query, Refused, TransformReport, TransformSpec


@dataclass(frozen=True)
class GuardConfig:
    k: int = DEFAULT_K
    queries_per_column: int = QUERIES_PER_COLUMN
    as_of: date | None = None  # today's date where None
    exact_duplicates: bool = False  # compare within blocks of any size, where those over 500 rows are only told


class Host:
    """What a guard asks of its surroundings. By default nobody is there, so nothing
    is approved or revealed."""

    def record(self, kind: str, subject: str, detail: str, irreversible: bool = False) -> None: ...

    def approve(self, spec: TransformSpec, report: TransformReport, reason: str, rows: int | None) -> tuple[bool, str]:
        return False, "nobody is there to approve it"

    def reveal(self, row: int, column: str, reason: str, read: Callable[[], str]) -> tuple[bool, str]:
        """(granted, value or reason); ``read`` is for a host that grants."""
        return False, "nobody is there to grant it"

    def dataset_changed(self, dataset: Dataset) -> None: ...


class Guard:
    """Nine questions, and the writes that a host approves."""

    #: Commits after which the live table is cut off from its lineage.
    CUT_EVERY = 10

    def __init__(self, dataset: Dataset, config: GuardConfig = GuardConfig(), host: Host | None = None):
        live, k = dataset, config.k if check_k(config.k) is None else DEFAULT_K
        budget, host = Budget(config.queries_per_column), host or Host()
        stack: list[Applied] = []
        refused_reveals: set[tuple[int, str]] = set()
        granted = commits = 0

        def left(columns: Sequence[str] = ()) -> int:
            return budget.left(columns or live.names)

        def answered(value: Any, columns: Sequence[str] = ()) -> Answered:
            return Answered(value, left(columns))

        def refuse(code: str, reason: str, columns: Sequence[str] = ()) -> Refused:
            if code == "belowK":
                host.record("answerSuppressed", ", ".join(columns), reason)
            return Refused(code, reason, left(columns))

        def missing(*columns: str | None) -> Refused | None:
            for c in columns:
                if c is not None and live.column(c) is None:
                    return refuse("unknownColumn", f"there is no column {c!r}; the columns are {', '.join(live.names)}")
            return None

        def charge(columns: Sequence[str]) -> Refused | None:
            if spent := budget.charge(columns):
                reason = f"no questions are left on {', '.join(spent)} (each column allows {budget.limit}); nothing was charged"
                host.record("budgetExhausted", ", ".join(spent), reason)
                return Refused("budgetExhausted", reason, 0)
            return None

        def describe() -> Answered:
            rows = profile.describe(live.df, live.names).orderBy("column_index").collect()
            columns = [
                {"id": r["column"], "type": live.column(r["column"]).type, "empty": r["empty_count"], "distinct": "unique" if r["is_unique_marker"] else r["distinct_count"]}
                for r in rows
            ]
            return answered({"row_count": live.row_count, "columns": columns, "min_group_size": k})

        def buckets(column: str) -> list[dict]:
            found = profile.format_buckets(live.df, column, k).orderBy(F.desc("count"), "format").collect()
            return [{"format": r["format"], "count": r["count"], "share": r["share"], "truncated": r["truncated"]} for r in found]

        def shapes(column: str, limit: int, only_unrecognised: bool) -> list[tuple[str, str]]:
            named = profile.format_buckets(live.df, column, k)
            samples = profile.format_samples(live.df, column, k)
            if only_unrecognised:
                named, samples = (x.where(F.col("format") == UNRECOGNISED) for x in (named, samples))
            limit = max(1, min(int(limit), profile.EXEMPLARS))
            return [(r["format"], r["masked"]) for r in profile.exemplars(samples, named, limit).orderBy("rank").collect()]

        def profile_column(column: str, exemplars: int = 10) -> Answered | Refused:
            if bad := missing(column) or charge([column]):
                return bad
            r, found = profile.profile(live.df, column).first(), buckets(column)
            shown = shapes(column, exemplars, False) if found else []
            value = {
                "id": column, "type": live.column(column).type, "empty": r["empty_count"],
                "distinct": "unique" if r["is_unique_marker"] else r["distinct_count"],
                "min_length": r["min_length"], "max_length": r["max_length"],
                "formats": [{x: b[x] for x in ("format", "count", "share")} for b in found],
                "truncated": any(b["truncated"] for b in found), "shapes": shown,
                "note": script_note([m for _, m in shown]), "exemplars_suppressed": not found,
            }
            return answered(value, [column])

        def sample_shapes(column: str, limit: int = 10, only_unrecognised: bool = False) -> Answered | Refused:
            if bad := missing(column) or charge([column]):
                return bad
            every = buckets(column)
            found = [b for b in every if not only_unrecognised or b["format"] == UNRECOGNISED]
            if not found:
                return refuse("belowK", f"no bucket of {column} reaches the minimum group of {k}, so no shape is shown", [column])
            shown = shapes(column, limit, only_unrecognised)
            value = {"shapes": shown, "buckets": found, "note": script_note([m for _, m in shown]), "truncated": any(b["truncated"] for b in every) or len(found) < len(every)}
            return answered(value, [column])

        def count(query: Query) -> Answered | Refused:
            if bad := missing(*query.columns) or charge(query.columns):
                return bad
            n = live.df.where(compile_query(query)).count()
            return refuse("belowK", withheld(k), query.columns) if 0 < n < k else answered(n, query.columns)

        def aggregate(group_by: str, fn: str = "count", over: str | None = None, where: Query | None = None) -> Answered | Refused:
            if fn not in agg.METRICS:
                return refuse("unknownColumn", f"a metric is one of {', '.join(agg.METRICS)}")
            if bad := missing(group_by):
                return bad
            if fn != "count" and over is None:
                return refuse("unknownColumn", f"{fn} needs a column to work over")
            if bad := missing(over):
                return bad
            if fn != "count" and live.column(over).type not in COMPARABLE:
                return refuse("unknownColumn", f"{over} holds {live.column(over).type} values, which have no {fn}")
            filters = where.columns if where else []
            if bad := missing(*filters):
                return bad
            named = list(dict.fromkeys([group_by, *([over] if over else []), *filters]))
            if bad := charge(named):
                return bad
            rows = agg.aggregate(live.df, group_by, fn, over, k, compile_query(where) if where else None).collect()
            rest = next((r for r in rows if r["is_other"]), None)
            if where and rest and 0 < rest["row_count"] < k:
                return refuse("belowK", withheld(k), named)
            groups = sorted((r for r in rows if not r["is_other"]), key=lambda r: (-r["row_count"], r["group_key"]))
            shown = [{"key": r["group_key"], "count": r["row_count"], "value": "suppressed" if r["suppressed"] else r["value"]} for r in groups]
            other = {"group_count": rest["group_count"], "row_count": rest["row_count"]} if rest else None
            return answered({"groups": shown, "other": other, "truncated": rest is not None}, named)

        def crosstab(rows: str, columns: str) -> Answered | Refused:
            if bad := missing(rows, columns):
                return bad
            if rows == columns:
                return refuse("unknownColumn", "a cross table needs two different columns")
            named = [rows, columns]
            if bad := charge(named):
                return bad
            widths = [profile.distinct_at_most(live.df, c, agg.MAX_AXIS).first() for c in named]
            if wide := [c for c, w in zip(named, widths, strict=True) if w["more"]]:
                return refuse("belowK", f"{wide[0]} has more than {agg.MAX_AXIS} different values", named)
            if widths[0]["distinct_count"] * widths[1]["distinct_count"] > agg.MAX_CELLS:
                return refuse("belowK", f"the table would have more than {agg.MAX_CELLS} cells", named)
            cells = {(r["row_key"], r["column_key"]): "suppressed" if r["suppressed"] else r["count"] for r in agg.crosstab(live.df, rows, columns, k).collect()}
            # Axis keys in the order of their own totals.
            keys = []
            for c in named:
                totals = live.df.groupBy(quoted(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
                keys.append([r["key"] for r in totals.orderBy(F.desc("n"), "key").limit(agg.MAX_AXIS).collect()])
            different = [live.df.select(quoted(c)).distinct().count() for c in named]
            table = [[cells.get((a, b), 0) for b in keys[1]] for a in keys[0]]
            value = {
                "row_keys": keys[0], "column_keys": keys[1], "cells": table, "suppressed_cells": sum(x == "suppressed" for row in table for x in row),
                "truncated": different[0] > len(keys[0]) or different[1] > len(keys[1]),
            }
            return answered(value, named)

        def find_issues(columns: Sequence[str] = ()) -> Answered | Refused:
            named = list(dict.fromkeys(columns)) or live.names
            if bad := missing(*named) or charge(named):
                return bad
            found = issues.findings(live.df, named, k, config.as_of)
            ids: dict[tuple[str, str], list[int]] = {}
            for r in issues.row_ids(found).orderBy("code", "column", "rank").collect():
                ids.setdefault((r["code"], r["column"]), []).append(r[ROW_ID])
            out = [
                {"code": r["code"], "column": r["column"], "row_ids": ids.get((r["code"], r["column"]), []), "affected": r["affected_count"], "truncated": r["truncated"]}
                for r in issues.summary(found).collect()
            ]
            return answered(sorted(out, key=lambda i: (-i["affected"], i["column"], i["code"])), named)

        def duplicates(columns: Sequence[str], threshold: float | None = None) -> Answered | Refused:
            if not columns:
                return refuse("unknownColumn", "name at least one column to compare rows on")
            if len(columns) > dedupe.MAX_COLUMNS:
                return refuse("tooManyConditions", f"rows are compared on {dedupe.MAX_COLUMNS} columns at most")
            if bad := missing(*columns):
                return bad
            named = list(dict.fromkeys(columns))
            if bad := charge(named):
                return bad
            limit = dedupe.clamp(threshold)
            rows, exact = settled(dedupe.folded(live.df, named)), config.exact_duplicates
            best = settled(dedupe.pairs(rows, limit, exact=exact).orderBy(F.desc("score"), "a", "b").limit(dedupe.MAX_PAIRS + 1))
            found = dedupe.matched(best, rows, named, limit).orderBy(F.desc("score"), "a", "b").collect()
            shown = [{"a": r["a"], "b": r["b"], "score": r["score"], "matched_columns": list(r["matched_columns"])} for r in found[: dedupe.MAX_PAIRS]]
            skipped = [] if exact else [r["n"] for r in dedupe.skipped_blocks(rows).select("n").orderBy(F.desc("n")).limit(dedupe.MAX_PAIRS).collect()]
            return answered({"pairs": shown, "truncated": len(found) > dedupe.MAX_PAIRS, "skipped_blocks": skipped, "cap": dedupe.MAX_PAIRS}, named)

        def bad_rows(spec: TransformSpec, rows: Sequence[int] | None) -> str | None:
            if rows is None:
                return None
            if not rows:
                return "the list of rows is empty; leave it out for every row"
            if spec.kind == "dropColumn":
                return "a column can't be dropped for some rows only"
            outside = [r for r in rows if not 0 <= r < live.row_count]
            return f"row {outside[0]} isn't in this table of {live.row_count} rows" if outside else None

        def dry_run(spec: TransformSpec, rows: Sequence[int] | None) -> TransformReport:
            done = transforms.targeted(live.df, spec, rows)
            n = transforms.report(done).first()
            failed = tuple(r[ROW_ID] for r in transforms.failed_rows(done).collect())
            shown = tuple((r["from"], r["to"]) for r in transforms.examples(done).collect())
            return TransformReport(spec, n["unchanged"], n["changed"], n["failed"], failed, shown, spec.destructive)

        def preview(spec: TransformSpec, rows: Sequence[int] | None = None) -> Answered | Refused:
            if bad := missing(spec.column):
                return bad
            if reason := bad_rows(spec, rows):
                return refuse("unknownColumn", reason)
            return answered(dry_run(spec, rows), [spec.column])

        def commit(spec: TransformSpec, rows: Sequence[int] | None = None, reason: str = "") -> dict:
            nonlocal live, commits
            if live.column(spec.column) is None:
                return {"status": "refused", "code": "invalidSpec", "reason": f"there is no column {spec.column!r}"}
            if bad := bad_rows(spec, rows):
                return {"status": "refused", "code": "invalidSpec", "reason": bad}
            before, report = live, dry_run(spec, rows)
            approved, why = host.approve(spec, report, reason, None if rows is None else len(set(rows)))
            if not approved:
                host.record("transformProposed", spec.column, f"{spec.kind} was not approved: {why}")
                return {"status": "refused", "code": "notApproved", "reason": why}
            if live is not before:
                return {"status": "refused", "code": "datasetChanged", "reason": "the table changed during approval; propose it again"}
            # Only what was changed is kept for an undo, and nothing of destructive transforms.
            previous = None if spec.destructive else settled(transforms.previous_values(live.df, spec, rows))
            after = transforms.commit(live.df, spec, rows)
            commits += 1
            after = settled(after) if commits % self.CUT_EVERY == 0 or spec.destructive else after
            columns = tuple(c for c in live.columns if c.id != spec.column) if spec.kind == "dropColumn" else live.columns
            live = replace(live, df=after, columns=columns)
            done = Applied(f"transform_{uuid.uuid4().hex[:8]}", spec, time.time(), report.changed, previous)
            stack.append(done)
            host.dataset_changed(live)
            host.record("transformApplied", spec.column, f"{spec.kind}: {report.changed} changed, {report.failed} failed; reason: {reason}", spec.destructive)
            return {"status": "applied", "id": done.id, "report": report, "irreversible": spec.destructive}

        def undo() -> dict:
            nonlocal live
            if not stack:
                return {"status": "empty"}
            top = stack[-1]
            if top.spec.destructive:
                return {"status": "irreversible", "kind": top.spec.kind, "column": top.spec.column}
            if live.column(top.spec.column) is None:
                return {"status": "failed", "reason": f"the column {top.spec.column!r} is gone"}
            live = replace(live, df=transforms.undo(live.df, top.spec.column, top.previous))
            stack.pop()
            host.dataset_changed(live)
            host.record("transformUndone", top.spec.column, f"{top.spec.kind} undone, {top.changed} cells restored")
            return {"status": "undone", "id": top.id, "kind": top.spec.kind, "column": top.spec.column, "restored": top.changed}

        def reveal(row: int, column: str, reason: str) -> dict:
            nonlocal granted
            if live.column(column) is None or not 0 <= row < live.row_count:
                return {"status": "invalid", "reason": "there is no such cell"}
            if (row, column) in refused_reveals:
                return {"status": "alreadyRefused", "reason": "this cell was refused before and isn't asked for again"}
            host.record("revealRequested", column, f"row {row}, reason: {reason}")
            read = lambda: live.df.where(F.col(ROW_ID) == row).select(quoted(column)).first()[0]
            ok, said = host.reveal(row, column, reason, read)
            if not ok:
                refused_reveals.add((row, column))
                host.record("revealRefused", column, f"row {row}: {said}")
                return {"status": "refused", "reason": said}
            granted += 1
            host.record("revealGranted", column, f"row {row} was disclosed", True)
            return {"status": "granted", "value": said}

        def raise_k(new: int) -> str | None:
            """Why the minimum group size stays, or None if it was raised."""
            nonlocal k
            if reason := check_k(new):
                return reason
            if new < k:
                return f"the minimum group size is {k} and only ever rises"
            k = new
            return None

        def settings() -> dict:
            return {
                "k": k, "queries_per_column": budget.limit, "row_count": live.row_count, "column_count": len(live.columns),
                "exhausted": budget.exhausted(), "reveals_granted": granted, "undo_depth": len(stack),
            }

        def history() -> list[dict]:
            return [{"id": a.id, "kind": a.spec.kind, "column": a.spec.column, "applied_at": a.applied_at, "reversible": not a.spec.destructive} for a in stack]

        def columns() -> tuple[ColumnInfo, ...]:
            return live.columns

        self.describe, self.profile_column, self.sample_shapes, self.count = describe, profile_column, sample_shapes, count
        self.aggregate, self.crosstab, self.find_issues, self.duplicates = aggregate, crosstab, find_issues, duplicates
        self.preview, self.commit, self.undo, self.reveal = preview, commit, undo, reveal
        self.settings, self.history, self.columns, self.raise_k = settings, history, columns, raise_k
        self.remaining_for: Callable[[Sequence[str]], int] = left
        self.source_name: Callable[[], str] = lambda: live.source_name
