"""A session: one dataset behind a guard, its journal, its gates and the fourteen tools."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from shapeguard.guard.guard import Guard, GuardConfig, Host
from shapeguard.guard.policy import check_k
from shapeguard.operators.dedupe import clamp
from shapeguard.plans.predicate import parse_query, whole
from shapeguard.plans.transform_spec import SpecError, parse_rows, parse_spec
from shapeguard.types import EVENTS, Answered, Dataset, Refused, TransformReport, TransformSpec

GATE_SECONDS, MAX_PROPOSALS, MAX_LISTED, MAX_OMITTED = 25.0, 100, 100, 20
REFUSALS = ("answerSuppressed", "revealRefused", "budgetExhausted")
TRUSTED = ("apply_transform", "undo_last", "request_reveal", "submit_cleanup_report")


@dataclass(frozen=True)
class Entry:
    id: str
    at: float
    author: str
    kind: str
    subject: str
    detail: str
    irreversible: bool = False


class Journal:
    """An append-only record."""

    SCHEMA = "id string, at double, author string, kind string, subject string, detail string, irreversible boolean"

    def __init__(self) -> None:
        self._entries: list[Entry] = []

    def append(self, kind: str, subject: str, detail: str, author: str = "agent", irreversible: bool = False) -> Entry:
        if kind not in EVENTS:
            raise ValueError(f"unknown event {kind}")
        entry = Entry(uuid.uuid4().hex, time.time(), author, kind, subject, detail, irreversible)
        self._entries.append(entry)
        return entry

    @property
    def entries(self) -> tuple[Entry, ...]:
        return tuple(self._entries)

    def count(self, kind: str) -> int:
        return sum(e.kind == kind for e in self._entries)

    def refusals(self) -> list[Entry]:
        return [e for e in self._entries if e.kind in REFUSALS]

    def summary(self) -> dict[str, int]:
        names = {"tool_calls": "toolCalled", "suppressed_answers": "answerSuppressed", "transforms_applied": "transformApplied", "reveals_requested": "revealRequested", "reveals_granted": "revealGranted"}
        return {name: self.count(kind) for name, kind in names.items()}

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(e).values()) for e in self._entries], self.SCHEMA)


def stamp(at: float) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S%z", time.localtime(at))


def export_journal(journal: Journal, source_name: str, row_count: int, settings: dict, form: str = "json") -> tuple[str, str]:
    """(file name, content) as JSON or Markdown; entries only, never rows."""
    now = stamp(time.time())
    stem = re.sub(r"[^a-z0-9]+", "-", re.sub(r"(?i)\.(csv|tsv|xlsx|xls|txt)$", "", source_name).lower()).strip("-")[:48] or "dataset"
    name = f"journal-{stem}-{now[:10]}.{'json' if form == 'json' else 'md'}"
    if form == "json":
        content = {"version": 1, "exported_at": now, "dataset": {"source_name": source_name, "row_count": row_count}, "settings": settings, "summary": journal.summary()}
        return name, json.dumps(content | {"entries": [asdict(e) for e in journal.entries]}, indent=2)
    cell = lambda t: re.sub(r"\r\n|\r|\n", " ", t.replace("|", "\\|"))
    lines = [f"# Journal of {source_name}", "", f"{now}, {row_count} rows, " + ", ".join(f"{k}: {v}" for k, v in settings.items()), "", "| Measure | Count |", "| --- | --- |"]
    lines += [f"| {k.replace('_', ' ')} | {v} |" for k, v in journal.summary().items()]
    lines += ["", "| # | Time | Author | Event | Subject | Detail |", "| --- | --- | --- | --- | --- | --- |"]
    for i, e in enumerate(journal.entries, 1):
        lines.append(f"| {i} | {stamp(e.at)} | {e.author} | {e.kind}{' (irreversible)' * e.irreversible} | {cell(e.subject)} | {cell(e.detail)} |")
    return name, "\n".join(lines) + "\n"


class Gate:
    """A decision that a person may settle once; unsettled, it falls to its safe answer."""

    def __init__(self, fallback: Any, seconds: float = GATE_SECONDS):
        self.fallback, self.seconds = fallback, seconds
        self.cause = "timeout"
        self._value, self._done, self._lock = fallback, threading.Event(), threading.Lock()

    def settle(self, value: Any) -> bool:
        with self._lock:
            if self._done.is_set():
                return False
            self._value, self.cause = value, "answered"
            self._done.set()
            return True

    def abandon(self) -> None:
        with self._lock:
            if not self._done.is_set():
                self.cause = "abandoned"
                self._done.set()

    def wait(self) -> Any:
        if not self._done.wait(self.seconds):
            with self._lock:
                self._done.set()  # the cause stays "timeout", unless somebody was faster
        return self._value


class People:
    """How the session reaches a person; override what somebody is there to decide."""

    def approve(self, spec: TransformSpec, report: TransformReport, reason: str, rows: int | None, gate: Gate) -> None: ...

    def reveal(self, row: int, column: str, reason: str, read: Callable[[], str], gate: Gate) -> None: ...

    def answer(self, question: str, options: list[str], gate: Gate) -> None: ...


class Session(Host):
    """Holds one dataset at a time. Clearing or replacing it abandons open gates; the
    journal and a raised minimum group size stay."""

    def __init__(self, people: People | None = None, gate_seconds: float = GATE_SECONDS, caller_trusted: Callable[[], bool] = lambda: True):
        self.people, self.gate_seconds, self.caller_trusted = people or People(), gate_seconds, caller_trusted
        self.journal = Journal()
        self.guard: Guard | None = None
        self._dataset: Dataset | None = None
        self._proposals: OrderedDict[str, dict] = OrderedDict()
        self._gates: list[Gate] = []
        self._asking = False
        self._k: int | None = None

    # Host
    def record(self, kind: str, subject: str, detail: str, irreversible: bool = False) -> None:
        self.journal.append(kind, subject, detail, irreversible=irreversible)

    def approve(self, spec: TransformSpec, report: TransformReport, reason: str, rows: int | None) -> tuple[bool, str]:
        return self._gate((False, "nobody approved it in time"), lambda g: self.people.approve(spec, report, reason, rows, g)).wait()

    def reveal(self, row: int, column: str, reason: str, read: Callable[[], str]) -> tuple[bool, str]:
        return self._gate((False, "nobody granted it in time"), lambda g: self.people.reveal(row, column, reason, read, g)).wait()

    def dataset_changed(self, dataset: Dataset) -> None:
        self._dataset = dataset

    def _gate(self, fallback: Any, put: Callable[[Gate], None]) -> Gate:
        gate = Gate(fallback, self.gate_seconds)
        self._gates.append(gate)
        put(gate)
        return gate

    # The dataset
    def load(self, dataset: Dataset, config: GuardConfig = GuardConfig()) -> Guard:
        self._abandon()
        if self._k is not None:
            config = replace(config, k=max(self._k, config.k))
        self.guard, self._dataset, self._k = Guard(dataset, config, self), dataset, config.k
        self.journal.append("datasetLoaded", dataset.source_name, f"{dataset.row_count} rows, {len(dataset.columns)} columns", "human")
        return self.guard

    def clear(self) -> None:
        self._abandon()
        if self._dataset is not None:
            self.journal.append("datasetCleared", self._dataset.source_name, "the table was put away", "human")
        self.guard = self._dataset = None

    def raise_k(self, k: int) -> str | None:
        """Why the minimum group size can't become ``k``, or None. It never falls, with or without a table."""
        reason = check_k(k) or (self.guard.raise_k(k) if self.guard else None)
        if reason is None and not self.guard and self._k is not None and k < self._k:
            reason = f"the minimum group size is {self._k} and can only be raised"
        if reason is None:
            self._k = max(self._k or 0, k)
        return reason

    def _abandon(self) -> None:
        for gate in self._gates:
            gate.abandon()
        self._gates.clear()
        self._proposals.clear()
        self._asking = False

    def export(self, form: str = "json") -> tuple[str, str]:
        settings = self.guard.settings() if self.guard else {}
        shown = {k: settings[k] for k in ("k", "queries_per_column") if k in settings}
        return export_journal(self.journal, self._dataset.source_name if self._dataset else "dataset", self._dataset.row_count if self._dataset else 0, shown, form)

    # The tools
    def tools(self) -> list[str]:
        return list(TOOLS)

    def call(self, name: str, **args: Any) -> dict:
        """A tool's answer as plain data. Refusals are answers; only a malformed call is an error."""
        tool = TOOLS.get(name)
        if tool is None:
            return {"error": f"the tools are {', '.join(TOOLS)}"}
        if name in TRUSTED and not self.caller_trusted():
            return {"status": "refused", "reason": "this tool is only for the session's own caller"}
        if self.guard is None and name != "submit_cleanup_report":
            return {"error": "noDataset: load a dataset first"}
        if extra := set(args) - set(tool.args):
            return {"error": f"{name} takes {', '.join(tool.args) or 'nothing'}, not {', '.join(sorted(extra))}"}
        if lacking := [a for a in tool.required if args.get(a) is None]:
            return {"error": f"{name} needs {', '.join(lacking)}"}
        self.journal.append("toolCalled", name, ", ".join(sorted(args)))
        try:
            return tool.run(self, **args)
        except SpecError as e:
            return {"error": str(e)}


def shown(verdict: Answered | Refused) -> dict:
    if isinstance(verdict, Refused):
        return {"status": "refused", "code": verdict.code, "reason": verdict.reason, "remaining": verdict.remaining}
    value = asdict(verdict.value) if isinstance(verdict.value, TransformReport) else verdict.value
    return {"status": "answered", "value": value, "remaining": verdict.remaining}


def count_where(s: Session, conditions: Any, join: str = "all") -> dict:
    query = parse_query({"conditions": conditions, "join": join}, s.guard.columns())
    return shown(query) if isinstance(query, Refused) else shown(s.guard.count(query))


def aggregate(s: Session, groupBy: str, metric: str = "count", valueColumn: str | None = None) -> dict:  # noqa: N803  the tool's own names
    return shown(s.guard.aggregate(groupBy, metric, valueColumn))


def propose(s: Session, transform: Any, rows: Any = None) -> dict:
    (spec, notes), chosen = parse_spec(transform), parse_rows(rows)
    verdict = s.guard.preview(spec, chosen)
    if isinstance(verdict, Refused):
        return shown(verdict)
    ident = f"proposal_{uuid.uuid4().hex[:8]}"
    s._proposals[ident] = {"spec": spec, "rows": chosen, "source": s.guard.source_name(), "committed": False}
    while len(s._proposals) > MAX_PROPOSALS:
        s._proposals.popitem(last=False)
    s.journal.append("transformProposed", spec.column, f"{spec.kind}: {verdict.value.changed} would change, {verdict.value.failed} would fail")
    out = shown(verdict)
    out["value"]["examples"] = out["value"]["examples"][:5]
    return out | {"proposal": ident, "notes": notes}


def apply(s: Session, proposal: str, reason: str) -> dict:
    own = s._proposals.get(proposal)
    if own is None:
        return {"error": f"there is no proposal {proposal}"}
    if own["committed"]:
        return {"status": "refused", "code": "alreadyCommitted", "reason": "this proposal was applied before"}
    if own["source"] != s.guard.source_name():
        return {"status": "refused", "code": "datasetChanged", "reason": "this proposal was made for another table"}
    done = s.guard.commit(own["spec"], own["rows"], reason)
    if done["status"] == "applied":
        own["committed"] = True
        done["report"] = asdict(done["report"])
    return done


def request_reveal(s: Session, row: Any, column: str, reason: str) -> dict:
    if not whole(row) or row < 0 or not str(reason).strip():
        return {"error": "a reveal needs a row id from 0 and a reason a person can read"}
    return s.guard.reveal(row, column, reason)


def ask_human(s: Session, question: str, options: Any) -> dict:
    choices = options if isinstance(options, list) else []
    keys = [c.strip().lower() for c in choices if isinstance(c, str)]
    if not 2 <= len(choices) <= 4 or len(keys) != len(choices) or not all(keys) or len(set(keys)) != len(keys):
        return {"error": "options are two to four different labels, the last of which changes nothing"}
    if s._asking:
        return {"error": "another question is still open"}
    s._asking = True
    s.journal.append("questionAsked", question, " / ".join(choices))
    try:
        gate = s._gate(choices[-1], lambda g: s.people.answer(question, choices, g))
        answer = gate.wait()
    finally:
        s._asking = False
    return {"answer": answer, "answered_by": "human" if gate.cause == "answered" else "nobody", "cause": gate.cause}


def submit_report(s: Session, summary: str, changes: Any, unresolved: Any) -> dict:
    for name, items in (("changes", changes), ("unresolved", unresolved)):
        if not isinstance(items, list) or len(items) > MAX_LISTED or not all(isinstance(i, str) and i.strip() for i in items):
            return {"error": f"{name} is a list of up to {MAX_LISTED} sentences"}
    refused = s.journal.refusals()
    s.journal.append("reportSubmitted", "report", f"{summary} ({len(changes)} changes, {len(unresolved)} unresolved, {len(refused)} refusals on record)")
    for kind, items in (("changed", changes), ("unresolved", unresolved)):
        for item in items:
            s.journal.append("reportSubmitted", kind, item)
    omitted = refused if not unresolved else []
    if omitted:
        s.journal.append("reportSubmitted", "discrepancy", f"nothing is listed as unresolved, but {len(omitted)} refusal(s) are on record", "system")
    told = s.journal.summary()
    discrepancy = {"omitted_count": len(omitted), "omitted": [f"{e.kind}: {e.subject}" for e in omitted[:MAX_OMITTED]], "truncated": len(omitted) > MAX_OMITTED} if omitted else None
    return {"submitted": True, "changes": len(changes), "unresolved": len(unresolved), "refusals": len(refused), "reveals_requested": told["reveals_requested"], "reveals_granted": told["reveals_granted"], "discrepancy": discrepancy}


def undo_last(s: Session) -> dict:
    return s.guard.undo()


@dataclass(frozen=True)
class Tool:
    run: Callable[..., dict]
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def args(self) -> tuple[str, ...]:
        return self.required + self.optional


TOOLS: dict[str, Tool] = {
    "describe_dataset": Tool(lambda s: shown(s.guard.describe())),
    "profile_column": Tool(lambda s, column: shown(s.guard.profile_column(column)), ("column",)),
    "sample_shapes": Tool(lambda s, column, onlyUnrecognised=False: shown(s.guard.sample_shapes(column, 10, bool(onlyUnrecognised))), ("column",), ("onlyUnrecognised",)),
    "count_where": Tool(count_where, ("conditions",), ("join",)),
    "aggregate": Tool(aggregate, ("groupBy",), ("metric", "valueColumn")),
    "crosstab": Tool(lambda s, rowColumn, columnColumn: shown(s.guard.crosstab(rowColumn, columnColumn)), ("rowColumn", "columnColumn")),
    "find_issues": Tool(lambda s, column=None: shown(s.guard.find_issues([column] if column else [])), (), ("column",)),
    "find_duplicates": Tool(lambda s, columns, threshold=None: shown(s.guard.duplicates(list(columns), clamp(threshold))), ("columns",), ("threshold",)),
    "propose_transform": Tool(propose, ("transform",), ("rows",)),
    "apply_transform": Tool(apply, ("proposal", "reason")),
    "undo_last": Tool(undo_last),
    "request_reveal": Tool(request_reveal, ("row", "column", "reason")),
    "ask_human": Tool(ask_human, ("question", "options")),
    "submit_cleanup_report": Tool(submit_report, ("summary", "changes", "unresolved")),
}
