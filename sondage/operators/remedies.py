"""The cleaning loop: check, choose a remedy, apply it, log it, replay it.

A remedy is the name of a registered function and its arguments as data; nothing
is evaluated from text. It applies only to the table it was proposed for, told by
the table's fingerprint."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from sondage.operators import clean, counts
from sondage.operators.frame import frame_issues

TIERS = ("representation", "values", "rows")
MODEL_TIERS = ("numerical", "structural", "estimand")
STATUS = {"constant": "FAIL", "duplicate_columns": "FAIL", "rank_deficient": "FAIL", "aliased_factors": "FAIL", "collinear": "WARN", "redundant_categories": "WARN", "nested": "WARN", "id_like": "WARN", "unit_level": "WARN", "rank_unchecked": "WARN"}
#: What a remedy may call: (table, **arguments) -> table.
FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "drop_cols": lambda df, names: clean.drop_cols(df, names),
    "wash": clean.wash, "retype": clean.retype, "recode_errors": clean.recode_errors,
    "first_of_copies": lambda df, keys, row_id: counts.copies(df, keys, "first", row_id),
}


@dataclass(frozen=True)
class Remedy:
    key: str
    checks: tuple[str, ...]
    status: str
    tier: str
    remedy: str
    fn: str | None
    args: dict
    target_id: str
    id: int = 0

    @property
    def by_hand(self) -> bool:
        return self.fn is None


@dataclass(frozen=True)
class Check:
    check: str
    status: str
    headline: str
    findings: list[dict]
    candidates: list[Remedy]
    target_id: str


@dataclass
class CleanFrame:
    df: DataFrame
    log: list[dict] = field(default_factory=list)
    checks: list[Check] = field(default_factory=list)


def remedy_key(kind: str, target: str | list[str], qualifier: str | None = None) -> str:
    names = [target] if isinstance(target, str) else sorted(target)
    return f"{kind}/{','.join(names)}" + (f":{qualifier}" if qualifier else "")


def check_frame(df: DataFrame, cor_cut: float = 0.999, v_cut: float = 0.95, target_id: str | None = None) -> Check:
    target = target_id or clean.data_id(df)
    findings, candidates = [], []
    for r in frame_issues(df, cor_cut, v_cut).collect():
        status = STATUS[r.issue]
        findings.append({"finding": r.issue, "columns": r.columns, "status": status, "detail": r.detail})
        names = r.columns.split(", ")
        if r.issue == "id_like":
            candidates.append(Remedy(remedy_key("as_key", names), ("frame",), status, "representation", r.remedy, None, {}, target))
        elif r.issue in ("nested", "unit_level", "rank_unchecked"):
            kind = {"nested": "model_nesting", "unit_level": "group_by", "rank_unchecked": "check_fewer"}[r.issue]
            candidates.append(Remedy(remedy_key(kind, names), ("frame",), status, "representation", r.remedy, None, {}, target))
        else:
            gone = names[-1]
            kind = "drop_cols" if len(names) == 1 else "keep_one"
            candidates.append(Remedy(remedy_key(kind, names), ("frame",), status, "values", r.remedy, "drop_cols", {"names": [gone]}, target))
    worst = "FAIL" if any(f["status"] == "FAIL" for f in findings) else "WARN" if findings else "OK"
    return Check("frame", worst, f"{len(findings)} findings" if findings else "nothing found", findings, candidates, target)


CHECKS: dict[str, Callable[[DataFrame], Check]] = {"frame": check_frame}


def check_data(df: DataFrame, checks: tuple[str, ...] = ("frame",)) -> list[Check]:
    return [CHECKS[c](df) for c in checks]


def assemble(rows: list[Remedy], tiers: tuple[str, ...] = TIERS) -> list[Remedy]:
    """One remedy a key: checks joined, the most cautious tier kept; ordered by tier and numbered."""
    out: dict[str, Remedy] = {}
    for r in rows:
        old = out.get(r.key)
        if old is None:
            out[r.key] = r
            continue
        if (old.fn, old.args) != (r.fn, r.args):
            raise ValueError(f"two changes for {r.key}")
        out[r.key] = replace(old, checks=tuple(dict.fromkeys(old.checks + r.checks)), tier=max(old.tier, r.tier, key=tiers.index))
    ordered = sorted(out.values(), key=lambda r: tiers.index(r.tier))
    return [replace(r, id=i + 1) for i, r in enumerate(ordered)]


def remedies(checks: Check | list[Check]) -> list[Remedy]:
    return assemble([r for c in (checks if isinstance(checks, list) else [checks]) for r in c.candidates])


def merge(*tables: list[Remedy]) -> list[Remedy]:
    rows = [r for t in tables for r in t]
    if len({r.target_id for r in rows}) > 1:
        raise ValueError("remedies of different tables don't merge")
    return assemble(rows)


def remedy_table(df: DataFrame, rows: list[dict]) -> list[Remedy]:
    """Remedies of the user's own: dicts of key, fn, args and tier."""
    target = clean.data_id(df)
    for r in rows:
        if r["fn"] not in FUNCTIONS or r.get("tier", "values") not in TIERS:
            raise ValueError(f"unknown function or tier in {r}")
        json.dumps(r["args"])
    return assemble([Remedy(r["key"], ("user",), "WARN", r.get("tier", "values"), r.get("remedy", ""), r["fn"], r["args"], target) for r in rows])


def find(table: list[Remedy], which: int | str) -> Remedy:
    norm = lambda s: s.replace(" ", "")
    for r in table:
        if r.id == which or (isinstance(which, str) and norm(r.key) == norm(which)):
            return r
    raise KeyError(which)


def apply(frame: CleanFrame | DataFrame, table: list[Remedy], which: int | str, reason: str, recheck: bool = True) -> CleanFrame:
    state = frame if isinstance(frame, CleanFrame) else CleanFrame(frame)
    r = find(table, which)
    before = clean.data_id(state.df)
    if r.target_id != before:
        raise ValueError("this remedy was proposed for another state of the table")
    if r.by_hand:
        raise ValueError(f"{r.key} is done by hand: {r.remedy}")
    df = FUNCTIONS[r.fn](state.df, **{k: _value(v) for k, v in r.args.items()})
    after = clean.data_id(df)
    entry = {"step": len(state.log) + 1, "time": datetime.now(timezone.utc).isoformat(timespec="seconds"), "key": r.key, "check": ",".join(r.checks), "status": r.status, "tier": r.tier, "remedy": r.remedy, "change": json.dumps({"fn": r.fn, "args": r.args}), "reason": reason, "id_before": before, "id_after": after}
    return CleanFrame(df, [*state.log, entry], check_data(df) if recheck else [])


def secret(var: str) -> dict:
    """An argument read from the environment when a remedy runs, never recorded."""
    return {"$env": var}


def _value(v):
    return os.environ[v["$env"]] if isinstance(v, dict) and "$env" in v else v


def cleaning_script(frame: CleanFrame) -> str:
    """A script that replays the log, and stops if a table isn't the one it was."""
    lines = ["from sondage.operators import clean, remedies", "", "", "def replay(df):"]
    for e in frame.log:
        c = json.loads(e["change"])
        lines += [f"    # {e['step']}. {e['key']}: {e['reason']}", f"    assert clean.data_id(df) == {e['id_before']!r}", f"    df = remedies.FUNCTIONS[{c['fn']!r}](df, **{{k: remedies._value(v) for k, v in {c['args']!r}.items()}})"]
    return "\n".join([*lines, "    return df", ""])
