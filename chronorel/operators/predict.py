"""Context text, pluggable batch prediction and error measures."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell_text, first_number, parse_feature
from ..session import ship_package

#: A predictor gets texts and returns as many texts.
Predictor = Callable[[list[str]], list[str]]
STRICT_SUFFIX = "\n\nAnswer with exactly one number and nothing else.\nAnswer:"


def context_lines(rows: DataFrame, value: str, kind: str) -> DataFrame:
    """(query_id, scope, lines): example rows of each query as text, newest first."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" -> "), cell_text(F.col(value), kind))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "tie", line.alias("line")))))
    return rows.groupBy("query_id", "scope").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("lines"))


def feature_table(features: DataFrame, columns: list[str], delta: dict[str, str] | None = None) -> DataFrame:
    """(query_id, csv): a header line and one line of cells; missing cells are empty."""
    kinds = dict(features.dtypes)
    cells = [F.when(cell_text(F.col(f"`{c}`"), kinds[c]) == "", F.lit("")).otherwise(cell_text(F.col(f"`{c}`"), kinds[c])) for c in columns]
    return features.select("query_id", F.concat(F.lit(",".join(columns) + "\n"), F.concat_ws(",", *cells)).alias("csv"))


def rank_feature_names(names: list[str], task_tokens: list[str], hints: dict[str, float], most: int = 24) -> list[str]:
    """Best feature names by words shared with the task, hints and aggregate; then by name."""
    bonus = {"mean": 0.6, "last": 0.6, "delta": 0.4, "max": 0.3, "min": 0.3, "std": 0.2, "sum": 0.2, "count": 0.2}

    def score(n: str) -> float:
        low = n.lower()
        agg = low.split("(")[0].split(".")[-1]
        return sum(t in low for t in task_tokens) + hints.get(n, 0.0) + bonus.get(agg, 0.0)

    return sorted(names, key=lambda n: (-score(n), n))[:most]


def meta_path_lines(values: dict[str, float], most_paths: int = 6, most_features: int = 4, root: str | None = None, tables: set[str] | None = None) -> list[str]:
    """Features grouped by the tables in their names, shortest first; what is cut is counted.

    With a root and the table names, names are parsed and features described.
    """
    groups: dict[str, list[str]] = {}
    for name in sorted(values):
        if root and tables:
            path, said = parse_feature(name, root, tables)
        else:
            path, said = tuple(dict.fromkeys(p.split(".")[0] for p in name.replace(")", "").split("("))), name
        groups.setdefault(" > ".join(path), []).append(f"{said}={values[name]:.4g}")
    lines = []
    for path in sorted(groups, key=lambda g: (g.count(">"), g))[:most_paths]:
        shown = groups[path][:most_features]
        more = len(groups[path]) - len(shown)
        lines.append(f"{path}: {', '.join(shown)}" + (f", … {more} additional" if more else ""))
    return lines


def build_prompts(queries: DataFrame, lines: DataFrame, task: str, features: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """(query_id, prompt): the task, own and other examples, features, and the question."""
    by_scope = lines.groupBy("query_id").pivot("scope", ["self", "other"]).agg(F.first("lines"))
    joined = queries.join(by_scope, "query_id", "left")
    parts = [F.lit(f"Task: {task}"), F.concat(F.lit("Own history:\n"), F.coalesce("self", F.lit("(none)"))), F.concat(F.lit("Others:\n"), F.coalesce("other", F.lit("(none)")))]
    if features is not None:
        joined = joined.join(features, "query_id", "left")
        parts.append(F.concat(F.lit("Features:\n"), F.coalesce("csv", F.lit("(none)"))))
    parts.append(F.concat(F.lit("Question: value for "), F.col("entity").cast("string"), F.lit(" after "), F.date_format("query_time", "yyyy-MM-dd")))
    return joined.select("query_id", F.concat(F.concat_ws("\n\n", *parts), F.lit(STRICT_SUFFIX if strict else "")).alias("prompt"))


def predict(prompts: DataFrame, predictor: Predictor, batch: int = 64) -> DataFrame:
    """(query_id, raw, prediction): batches of texts through the predictor; the first number of an answer counts.

    A predictor may fail on a batch; it is then asked text by text and a text
    that still fails has an empty answer.
    """

    ship_package(prompts.sparkSession)

    def ask(texts: list[str]) -> list[str]:
        try:
            return predictor(texts)
        except Exception:
            if len(texts) == 1:
                return [""]
            return [a for t in texts for a in ask([t])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            answers: list[str] = []
            for at in range(0, len(f), batch):
                answers += ask(list(f["prompt"].iloc[at : at + batch]))
            yield pd.DataFrame({"query_id": f["query_id"], "raw": answers})

    return prompts.mapInPandas(run, "query_id long, raw string").withColumn("prediction", first_number(F.col("raw")))


def last_value(history: DataFrame) -> DataFrame:
    """Baseline: the newest known value of each query."""
    return history.groupBy("query_id").agg(F.max_by("value", F.struct("ts", "tie")).alias("prediction"))


def history_mean(history: DataFrame) -> DataFrame:
    """Baseline: the mean of the known values (two-decimal amounts, summed exactly)."""
    return history.groupBy("query_id").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("prediction"))


def error_stats(scored: DataFrame) -> DataFrame:
    """One row: n, mae, variance and deviation (population) of the absolute error; zeros without rows."""
    e = F.abs(F.col("prediction") - F.col("target"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.agg(F.count(e).alias("n"), zero(F.avg(e)).alias("mae"), zero(F.var_pop(e)).alias("error_variance"), zero(F.stddev_pop(e)).alias("error_std"))


def large_gaps(scored: DataFrame, threshold: float = 100.0) -> DataFrame:
    """Rows whose error reaches the threshold; a NaN target never does."""
    return scored.filter(~F.isnan("target") & (F.abs(F.col("prediction") - F.col("target")) >= threshold))


#: Fixed value: a result line of a run log.
LOG_LINE = r"prediction=([0-9eE.\-]+)\s*\|\s*ground_truth=([0-9eE.\-]+)"


def log_errors(lines: DataFrame, column: str = "value") -> DataFrame:
    """(prediction, target) of the lines of a log that report a result."""
    pick = lambda i: F.regexp_extract(column, LOG_LINE, i).try_cast("double")
    return lines.filter(F.col(column).rlike(LOG_LINE)).select(pick(1).alias("prediction"), pick(2).alias("target"))


def timing_summary(timings: DataFrame) -> DataFrame:
    """Per phase: count, total, mean, median, 95th percentile and maximum of seconds."""
    return timings.groupBy("phase").agg(
        F.count(F.lit(1)).alias("count"), F.sum("seconds").alias("total"), F.avg("seconds").alias("avg"), F.percentile("seconds", F.lit(0.5)).alias("p50"), F.percentile("seconds", F.lit(0.95)).alias("p95"), F.max("seconds").alias("max")
    )


@dataclass
class Timer:
    """Seconds of named phases on the driver."""

    rows: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def phase(self, name: str):
        at = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - at))

    def to_json(self) -> str:
        return json.dumps([{"phase": p, "seconds": s} for p, s in self.rows])
