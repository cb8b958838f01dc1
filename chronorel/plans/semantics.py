"""Roles of tables and columns: name rules first, then any number of injected annotators, a vote, fixed rules and checks.

An annotator takes ``(table, columns)``, columns being ``{name: prior role}``,
and returns ``{"table_role": ..., "columns": {name: role}}``; its answers may be
malformed.  A critic takes the same and the voted answer, and may return one of
its own, whose usable parts win.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

#: Roles that answers may give.
TABLE_ROLES = ("static", "entity", "event")
COLUMN_ROLES = ("primary_key", "foreign_key", "timestamp", "identifier", "category", "text", "measure")
#: Parts of names that make a column a time.
TIME_PARTS = ("date", "time", "timestamp")

Annotator = Callable[[str, dict[str, str]], object]


def repair_role(answer: object, allowed: tuple[str, ...], fallback: str) -> str:
    """An allowed role out of an answer: the answer itself, the first allowed word in it, or the fallback."""
    said = str(answer if answer is not None else "").strip().lower()
    return said if said in allowed else next((w for w in re.split(r"[^a-z_]+", said) if w in allowed), fallback)


def fixed_role(name: str, role: str, prior: str) -> str:
    """What names and keys decide whatever was answered: keys stay keys, id names identify, time names are times."""
    low = name.lower()
    if prior in ("primary_key", "foreign_key"):
        return prior
    if low.endswith("id") and role not in ("primary_key", "foreign_key", "identifier"):
        return "identifier"
    return "timestamp" if any(p in low for p in TIME_PARTS) and not low.endswith("id") else role


def _vote(answers: list[str], prior: str) -> str:
    """Most frequent answer; the prior wins ties it takes part in, else the alphabetically first."""
    counts = Counter(answers) or Counter([prior])
    top = max(counts.values())
    best = sorted(r for r, n in counts.items() if n == top)
    return prior if prior in best else best[0]


def annotate(tables: dict[str, tuple[str, dict[str, str]]], annotators: list[Annotator] = (), critic: Callable[[str, dict[str, str], dict], object] | None = None) -> dict:
    """Voted roles of ``{table: (prior table role, {column: prior role})}``, with failures and checks.

    Annotators that raise, or answer no mapping, are counted as failures and
    have no vote; without annotators the priors stand.
    """
    out, failures = [], 0
    for table, (table_prior, columns) in tables.items():
        said: list[dict] = []
        for ask in annotators:
            try:
                answer = ask(table, dict(columns))
            except Exception:  # an injected model may fail in any way; it loses its vote
                answer = None
            if isinstance(answer, dict):
                said.append(answer)
            else:
                failures += 1
        of = lambda a: a.get("columns") if isinstance(a.get("columns"), dict) else {}
        role = _vote([repair_role(a["table_role"], TABLE_ROLES, table_prior) for a in said if a.get("table_role") is not None], table_prior)
        voted = {c: _vote([repair_role(of(a)[c], COLUMN_ROLES, p) for a in said if of(a).get(c) is not None], p) for c, p in columns.items()}
        if critic:
            answer = critic(table, dict(columns), {"table_role": role, "columns": dict(voted)})
            if isinstance(answer, dict):
                role = repair_role(answer.get("table_role"), TABLE_ROLES, role)
                voted = {c: repair_role(of(answer).get(c), COLUMN_ROLES, r) for c, r in voted.items()}
        out.append({"table_name": table, "table_role": role, "columns": [{"name": c, "role": fixed_role(c, r, columns[c]), "prior": columns[c]} for c, r in voted.items()]})
    return {"tables": out, "annotators": len(annotators), "failures": failures, "validation": validate_roles(out)}


def validate_roles(tables: list[dict]) -> dict:
    """Everything wrong with annotated tables: unknown roles, and names that speak against their role."""
    issues = []
    for t in tables:
        if t["table_role"] not in TABLE_ROLES:
            issues.append({"type": "invalid_table_role", "table": t["table_name"], "value": t["table_role"]})
        for c in t["columns"]:
            low, role = c["name"].lower(), c["role"]
            about = {"table": t["table_name"], "column": c["name"], "value": role}
            if role not in COLUMN_ROLES:
                issues.append({"type": "invalid_column_role", **about})
            if any(p in low for p in TIME_PARTS) and not low.endswith("id") and role not in ("timestamp", "primary_key", "foreign_key"):
                issues.append({"type": "timestamp_name_mismatch", **about})
            if low.endswith("id") and role not in ("primary_key", "foreign_key", "identifier"):
                issues.append({"type": "id_name_mismatch", **about})
    return {"passed": not issues, "issue_count": len(issues), "issues": issues}
