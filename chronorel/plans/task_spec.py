"""Compiling a task: greedy path selection, policy merging, rounds with a critic, and a validated specification.

Everything here works on a few hundred candidate paths that live on the driver.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from ..functions.text import json_safe
from .paths import Q_DIVERSITY, Q_HINT, Q_ONE_HOP, Q_OVERFLOW, Q_TARGET

REQUIRED = ("task", "anchor", "selected_paths", "attributes", "budgets", "cutoff")


@dataclass
class PathRow:
    """A scored candidate path on the driver."""

    path_id: str
    tables: list[str]
    depth: int
    final: float
    recommended: bool = True
    temporal_valid: bool = True
    attributes: list[dict] = field(default_factory=list)


def quality(rows: list[PathRow], hints: set[str], targets: set[str], preferred_depth: int = 3) -> float:
    if not rows:
        return 0.0
    seen = {t for r in rows for t in r.tables}
    n = len(rows)
    part = lambda names: len(seen & names) / len(names) if names else 0.0
    return (
        sum(r.final for r in rows) / n + Q_TARGET * part(targets) + Q_HINT * part(hints) + Q_ONE_HOP * sum(r.depth <= 1 for r in rows) / n
        + Q_DIVERSITY * len({r.tables[1] for r in rows if len(r.tables) > 1}) - Q_OVERFLOW * sum(r.depth > preferred_depth for r in rows) / n
    )


def select_greedily(rows: list[PathRow], hints: set[str], targets: set[str], most: int = 10, preferred_depth: int = 3) -> list[PathRow]:
    """Add the path that raises the set's quality most until none does."""
    chosen: list[PathRow] = []
    rest = sorted(rows, key=lambda r: (-r.final, r.path_id))
    while rest and len(chosen) < most:
        now = quality(chosen, hints, targets, preferred_depth)
        best = max(rest, key=lambda r: quality([*chosen, r], hints, targets, preferred_depth))
        if chosen and quality([*chosen, best], hints, targets, preferred_depth) <= now:
            break
        chosen.append(best)
        rest.remove(best)
    return chosen


def merge_policy(policy: dict, patch: dict) -> dict:
    """A copy of the policy with the patch's known keys; nested dicts merge, other values replace."""
    out = dict(policy)
    for k, v in patch.items():
        if k in policy:
            out[k] = merge_policy(policy[k], v) if isinstance(policy[k], dict) and isinstance(v, dict) else v
    return out


def default_policy(rows: list[PathRow], hints: set[str], targets: set[str]) -> dict:
    return {"selected_paths": [r.path_id for r in select_greedily(rows, hints, targets)], "dropped_paths": [], "budgets": {"history": 10, "top_k": 20, "hops": 2, "peers": 3}, "sampling": "most_recent_k"}


def artifact_header(dataset: str, cutoff: object, version: str = "1") -> dict:
    """What every artifact starts with."""
    return {"artifact_version": version, "dataset_name": dataset, "generation_timestamp_utc": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "global_cutoff_time": json_safe(cutoff)}


def prompt_object(task: dict, rows: list[PathRow], semantics: dict, stats: dict, feature_hints: dict | None = None, most: int = 80) -> dict:
    """What a solver or critic reads: the task, its best candidate paths, roles, statistics and hints."""
    best = sorted(rows, key=lambda r: (-r.final, r.path_id))[:most]
    paths = [{"path_id": r.path_id, "depth": r.depth, "path_tables": r.tables, "final_relevance_score": r.final, "top_attribute_candidates": r.attributes[:10]} for r in best]
    return {"task_definition": task, "candidate_paths": paths, "recommended_path_ids": [p["path_id"] for p in paths], "semantics_summary": semantics, "stats_summary": stats, "feature_hints": json_safe(feature_hints or {})}


def task_priors(prompt: dict, ask: Callable[[dict], object] | None = None, neighbours: list[str] | None = None) -> dict:
    """Path priors of a task from an injected model, each key that it leaves out at its default.

    Without a model, or where its answer is no mapping, motifs lead from the
    entity table to its best neighbours, at most 3 deep.
    """
    anchor = str(prompt["task_definition"].get("entity_table", ""))
    plain = {"anchor_table": anchor, "preferred_motifs": [], "optional_motifs": [], "discouraged_tables": [], "preferred_max_depth": 3, "rationale": "model"}
    answer = ask(prompt) if ask else None
    if isinstance(answer, dict):
        return {**plain, **{k: v for k, v in answer.items() if k in plain}}
    return {**plain, "preferred_motifs": [[anchor, n] for n in neighbours or []], "rationale": "fallback"}


def flagged_ids(critique: dict, known: set[str]) -> list[str]:
    """Known path ids that a critique names anywhere in its text."""
    text = json.dumps(json_safe(critique))
    return sorted(p for p in known if f'"{p}"' in text or f"{p} " in text)


def compile_rounds(rows: list[PathRow], hints: set[str], targets: set[str], solver: Callable[[dict], dict] | None = None, critic: Callable[[dict], dict] | None = None, rounds: int = 3) -> tuple[dict, list[dict]]:
    """Solver proposes, critic flags; ends early when the selection is stable. Without either, the default policy."""
    policy, log, known = default_policy(rows, hints, targets), [], {r.path_id for r in rows}
    for n in range(rounds if solver or critic else 0):
        before = list(policy["selected_paths"])
        if solver:
            policy = merge_policy(policy, solver(policy))
        flagged = flagged_ids(critic(policy), known) if critic else []
        policy["dropped_paths"] = sorted({*policy["dropped_paths"], *flagged})
        policy["selected_paths"] = [p for p in policy["selected_paths"] if p in known and p not in policy["dropped_paths"]] or before
        log.append({"round": n + 1, "selected": policy["selected_paths"], "flagged": flagged})
        if policy["selected_paths"] == before and not flagged:
            break
    return policy, log


def make_spec(task: str, anchor: str, cutoff: str, policy: dict, rows: list[PathRow], attrs_per_path: int = 5) -> dict:
    by_id = {r.path_id: r for r in rows}
    plan = [{"path_id": p, "tables": by_id[p].tables, "attributes": by_id[p].attributes[:attrs_per_path]} for p in policy["selected_paths"] if p in by_id]
    return {"version": 1, "created": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), "task": task, "anchor": anchor, "cutoff": cutoff, "selected_paths": policy["selected_paths"], "attributes": plan, "budgets": policy["budgets"], "sampling": policy["sampling"]}


def validate_spec(spec: dict, rows: list[PathRow], cutoff: str, max_depth: int = 4) -> list[str]:
    """Everything that is wrong with a specification; empty if nothing."""
    by_id = {r.path_id: r for r in rows}
    errors = [f"missing key {k}" for k in REQUIRED if k not in spec]
    if errors:
        return errors
    for p in spec["selected_paths"]:
        if p not in by_id:
            errors.append(f"unknown path {p}")
        elif by_id[p].depth > max_depth:
            errors.append(f"path {p} is deeper than {max_depth}")
        elif by_id[p].tables[0] != spec["anchor"]:
            errors.append(f"path {p} does not start at {spec['anchor']}")
    if len(set(spec["selected_paths"])) != len(spec["selected_paths"]):
        errors.append("a path is selected twice")
    errors += [f"budget {k} must be a positive number" for k, v in spec["budgets"].items() if not isinstance(v, int) or v <= 0]
    if spec["cutoff"] != cutoff:
        errors.append("the cutoff is not the bundle's")
    return errors


def feature_columns(spec: dict, always: list[str]) -> dict[str, list[str]]:
    """Tables and columns a specification needs: what feature synthesis may read."""
    out: dict[str, list[str]] = {t: [] for t in always}
    for step in spec["attributes"]:
        for t in step["tables"]:
            out.setdefault(t, [])
        for a in step["attributes"]:
            cols = out.setdefault(a["table"], [])
            if a["column"] not in cols:
                cols.append(a["column"])
    return out


def safety_rules(columns: list[tuple[str, str]], cutoff: str, leakage: tuple[str, ...]) -> dict:
    """Cutoff and columns that must not be read."""
    return {"cutoff": cutoff, "strictly_before_cutoff": True, "excluded_columns": [f"{t}.{c}" for t, c in columns if any(x in c.lower() for x in leakage)]}
