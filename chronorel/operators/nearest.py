"""Exact k best rows of each query by blocks with bounds, for scores over texts and numbers.

Rows are dealt into cells by a tree of value cuts; its cuts come from a sample of the rows,
which decides how well cells prune and never what is found.  Each cell knows the least and greatest value of each column, hence the best
score that a query can have in it.  A query first meets its most promising
cells; the k-th score found there rules out most others, and it then meets all
that may still hold an equal or better row.  A task compares the queries that meet a
cell with the rows of the cell.  Of rows with equal values only the k + 1
smallest keys are kept, since no more can be among the best k of anyone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship_package

#: Rows a cell aims at, most cells, rows of the sample that cuts them, and entries of a matrix in work.
CELL_ROWS, CELLS, SAMPLE_ROWS, ENTRIES = 1_000, 4_096, 40_000, 1_000_000
#: Cells whose bound is this near below a score are met too: bounds and scores are rounded apart.
NEAR = 2e-6


class Points(NamedTuple):
    """Texts as codes (-1: null), numbers, and which numbers are there."""

    t: np.ndarray
    x: np.ndarray
    has: np.ndarray

    def take(self, a: int, b: int) -> Points:
        return Points(self.t[a:b], self.x[a:b], self.has[a:b])


class Cells(NamedTuple):
    """Per cell: its id, rows, ranges of text hashes and numbers (NaN without any), which numbers some and all rows have, and whether a number is NaN."""

    id: np.ndarray
    n: np.ndarray
    t_low: np.ndarray
    t_high: np.ndarray
    low: np.ndarray
    high: np.ndarray
    some: np.ndarray
    all: np.ndarray
    odd: np.ndarray


class Attributes:
    """Weights for equal texts, up to 1 for close numbers, in the order of ``terms`` (("t" or "x", place, weight)); -1 without a shared column."""

    def __init__(self, terms: list[tuple[str, int, float]]) -> None:
        self.terms, self.digits = terms, 9

    def score(self, q: Points, r: Points) -> np.ndarray:
        total, shared = np.zeros((len(q.x), len(r.x))), np.zeros((len(q.x), len(r.x)), bool)
        for kind, i, w in self.terms:
            if kind == "t":
                a, b = q.t[:, i, None], r.t[None, :, i]
                both, points = (a >= 0) & (b >= 0), w * (a == b)
            else:
                a, b = q.x[:, i, None], r.x[None, :, i]
                both = q.has[:, i, None] & r.has[None, :, i]
                points = np.maximum(0.0, 1.0 - np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1.0))
            total += np.where(both, points, 0.0)
            shared |= both
        return np.where(shared, total, -1.0)

    def bound(self, h: np.ndarray, q: Points, c: Cells) -> np.ndarray:
        total = np.zeros((len(q.x), len(c.n)))
        for kind, i, w in self.terms:
            if kind == "t":
                total += w * ((h[:, i, None] >= c.t_low[None, :, i]) & (h[:, i, None] <= c.t_high[None, :, i]))
            else:
                a = q.x[:, i, None]
                b = np.clip(a, c.low[None, :, i], c.high[None, :, i])
                points = np.maximum(0.0, 1.0 - np.abs(a - b) / np.maximum(np.maximum(np.abs(a), np.abs(b)), 1.0))
                total += np.where(q.has[:, i, None] & c.some[None, :, i], points, 0.0)
        return total


class Static:
    """0.7 of the scaled cosine of the numbers and 0.3 of the share of the query's texts that agree; texts are empty where missing (code 0)."""

    digits = 6

    def _cosine(self, dot, qn, rn):
        """Where the query has no direction: 0.  As in Spark, least(NaN, 1) is 1 and NaN is above 0."""
        cos = np.fmin(np.maximum((dot / (qn * rn + 1e-8) + 1) * 0.5, 0.0), 1.0)
        return np.where((qn > 0) | np.isnan(qn), cos, 0.0)

    def _mixed(self, cos, same, valid, x: int, t: int):
        cat = np.where(valid > 0, same / np.maximum(valid, 1), 0.0)
        return 0.7 * cos + 0.3 * cat if x and t else cos + 0 * cat if x else cat

    def score(self, q: Points, r: Points) -> np.ndarray:
        dot, qq, rr = np.zeros((len(q.x), len(r.x))), np.zeros(len(q.x)), np.zeros(len(r.x))
        for i in range(q.x.shape[1]):
            dot = dot + q.x[:, i, None] * r.x[None, :, i]
            qq, rr = qq + q.x[:, i] ** 2, rr + r.x[:, i] ** 2
        known = q.has.all(1)[:, None] & r.has.all(1)[None, :]
        cos = np.where(known, self._cosine(dot, np.sqrt(qq)[:, None], np.sqrt(rr)[None, :]), 0.0)
        same = sum(((q.t[:, i, None] > 0) & (q.t[:, i, None] == r.t[None, :, i]) for i in range(q.t.shape[1])), np.zeros(dot.shape))
        return self._mixed(cos, same, (q.t > 0).sum(1)[:, None], q.x.shape[1], q.t.shape[1])

    def bound(self, h: np.ndarray, q: Points, c: Cells) -> np.ndarray:
        shape = len(q.x), len(c.n)
        if q.x.shape[1] == 1:  # the cosine is monotone in the row's number
            a, qn = q.x, np.abs(q.x)
            cos = np.maximum(*[self._cosine(a * e[None, :, 0], qn, np.abs(e[None, :, 0])) for e in (c.low, c.high)])
            cos = np.where(q.has & c.some[None, :, 0], cos, 0.0)
        else:
            cos = np.ones(shape)
        same = sum(((q.t[:, i, None] > 0) & (h[:, i, None] >= c.t_low[None, :, i]) & (h[:, i, None] <= c.t_high[None, :, i]) for i in range(q.t.shape[1])), np.zeros(shape))
        return self._mixed(cos, same, (q.t > 0).sum(1)[:, None], q.x.shape[1], q.t.shape[1])


class Features:
    """0.75 exp(-mean relative error) + 0.25 shared share of the query's numbers; -1 without a shared one."""

    digits = 6

    def score(self, q: Points, r: Points) -> np.ndarray:
        total, n = np.zeros((len(q.x), len(r.x))), np.zeros((len(q.x), len(r.x)), np.int64)
        for i in range(q.x.shape[1]):
            both = q.has[:, i, None] & r.has[None, :, i]
            total += np.where(both, np.abs(r.x[None, :, i] - q.x[:, i, None]) / np.maximum(np.abs(q.x[:, i, None]), 1e-6), 0.0)
            n += both
        return np.where(n > 0, 0.75 * np.exp(-(total / np.maximum(n, 1))) + 0.25 * n / np.maximum(q.has.sum(1), 1)[:, None], -1.0)

    def bound(self, h: np.ndarray, q: Points, c: Cells) -> np.ndarray:
        shape = len(q.x), len(c.n)
        sure, n_sure, free, n = np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.zeros(shape)
        for i in range(q.x.shape[1]):
            a = q.x[:, i, None]
            e = np.maximum(np.maximum(c.low[None, :, i] - a, a - c.high[None, :, i]), 0.0) / np.maximum(np.abs(a), 1e-6)
            must, may = q.has[:, i, None] & c.all[None, :, i], q.has[:, i, None] & (c.some & ~c.all)[None, :, i]
            sure, n_sure = sure + np.where(must, e, 0.0), n_sure + must
            free, n = np.where(may, np.minimum(free, e), free), n + must + may
        # numbers that only some rows have may be left out: the mean is no less than the lesser of both means
        mean = np.minimum(np.where(n_sure > 0, sure / np.maximum(n_sure, 1), np.inf), free)
        return np.where(n > 0, 0.75 * np.exp(-mean) + 0.25 * n / np.maximum(q.has.sum(1), 1)[:, None], -1.0)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists of one length as numbers and which are there."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width), flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _places(h: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the tree cuts: missing first, NaN last."""
    m = np.hstack([np.where(has, np.where(np.isnan(v), np.inf, v), -np.inf) for v, has in (h, x)])
    return m


def grow(m: np.ndarray, texts: int, least: int):
    """Nested (column, cut, left, right) with numbered leaves: texts are cut first, then missing numbers, then the widest."""
    leaves = iter(range(1 << 40))

    def spread(v: np.ndarray) -> float:
        if np.isinf(v.min()) or np.isinf(v.max()):
            return np.inf if v.min() < v.max() else 0.0
        return float(v.max() - v.min()) / max(float(np.abs(v).mean()), 1e-300)

    def node(rows: np.ndarray):
        if len(rows) < 2 * least:
            return next(leaves)
        part = m[rows]
        varied = [i for i in range(m.shape[1]) if part[:, i].min() < part[:, i].max()]
        if not varied:
            return next(leaves)
        i = varied[0] if varied[0] < texts else max(varied, key=lambda j: spread(part[:, j]))
        v = np.sort(part[:, i])
        middle, at = v[len(v) // 2], np.searchsorted(v, v[len(v) // 2])
        upto = np.searchsorted(v, middle, "right")
        cut = v[at - 1] if at and (upto == len(v) or len(v) - upto < at) else middle
        left = part[:, i] <= cut
        return i, float(cut), node(rows[left]), node(rows[~left])

    return node(np.arange(len(m)))


def place(tree, m: np.ndarray) -> np.ndarray:
    out = np.zeros(len(m), np.int32)

    def go(node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            out[rows] = node
            return
        left = m[rows, node[0]] <= node[1]
        go(node[2], rows[left])
        go(node[3], rows[~left])

    go(tree, np.arange(len(m)))
    return out


def _leaves(tree) -> int:
    return 1 if isinstance(tree, int) else _leaves(tree[2]) + _leaves(tree[3])


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Which entries of each line are its k greatest, the first of equal ones."""
    if s.shape[1] <= k:
        return s > -np.inf
    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1, None]
    above, level = s > kth, s == kth
    return (above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1)[:, None]))) & (s > -np.inf)


def nearest(queries: DataFrame, rows: DataFrame, key: str, texts: list[Column], numbers: list[Column], measure, k: int) -> DataFrame:
    """(q_key, key, score) with at least the k best rows of each query, another key than its own and a score of 0 or more.

    ``texts`` and ``numbers`` are expressions over both frames.  Equal scores go by key.
    """
    spark = rows.sparkSession
    ship_package(spark)
    kind = rows.schema[key].dataType.simpleString()
    n_t, n_x, digits = len(texts), len(numbers), measure.digits
    form = [F.array(*texts).cast("array<string>").alias("t"), F.array(*numbers).cast("array<double>").alias("x")]
    hashed = F.transform("t", lambda v: F.when(v.isNotNull(), F.xxhash64(v).cast("double"))).alias("h")
    w = Window.partitionBy("t", "x").orderBy("k")
    held = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), *form).withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= k + 1)
    held = materialise(held.select("k", "t", "x", hashed), "near-rows")
    asked = materialise(queries.filter(F.col(key).isNotNull()).select(F.col(key).alias("q"), *form).select("q", "t", "x", hashed), "near-queries")

    total = held.count()
    found_type = f"q {kind}, k {kind}, score double"
    sample = held.filter(F.pmod(F.xxhash64("k"), F.lit(max(1, -(-total // SAMPLE_ROWS)))) == 0).select("h", "x").toArrow()
    drawn = max(1, sample.num_rows)
    least = max(8, int(drawn * max(CELL_ROWS, -(-total // CELLS)) / max(total, 1)) // 2)
    tree = grow(_places(_matrix(sample["h"], n_t), _matrix(sample["x"], n_x)), n_t, least) if sample.num_rows else 0

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = place(tree, _places(_matrix(b.column("h"), n_t), _matrix(b.column("x"), n_x)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    celled = held.mapInArrow(put, f"k {kind}, t array<string>, x array<double>, h array<double>, cell int")
    values = [F.col("h")[i] for i in range(n_t)] + [F.col("x")[i] for i in range(n_x)]
    stats = celled.groupBy("cell").agg(F.count(F.lit(1)), *[f(v) for v in values for f in (F.min, F.max, F.count)]).collect()
    table = np.array([[np.nan if v is None else float(v) for v in r] for r in stats], float).reshape(len(stats), 2 + 3 * len(values))
    low, high, count = (table[:, 2 + j :: 3] for j in range(3))
    cells = Cells(table[:, 0].astype(np.int32), table[:, 1].astype(np.int64), low[:, :n_t], high[:, :n_t], low[:, n_t:], high[:, n_t:], count[:, n_t:] > 0, count[:, n_t:] == table[:, 1, None], (np.isnan(high[:, n_t:]) & (count[:, n_t:] > 0)).any(1))

    def visits(first: bool):
        """Queries beside each cell they meet: the most promising ones, or all others that the k-th score leaves."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, ENTRIES // max(1, len(cells.n)))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    (h, has_h), (x, has) = _matrix(b.column("h"), n_t), _matrix(b.column("x"), n_x)
                    empty = np.array([[v == "" for v in line] for line in b.column("t").to_pylist()], bool).reshape(len(h), n_t)
                    points = Points(np.where(has_h, np.where(empty, 0, 1), -1), x, has)
                    with np.errstate(all="ignore"):
                        limit = measure.bound(np.where(has_h, h, np.nan), points, cells)
                    limit[:, cells.odd] = np.inf
                    limit[(np.isnan(x) & has).any(1)] = np.inf
                    order = np.argsort(-limit, axis=1, kind="stable")
                    size = cells.n[order]
                    early = np.zeros(limit.shape, bool)
                    np.put_along_axis(early, order, np.cumsum(size, axis=1) - size < k + 1, axis=1)
                    go = early if first else ~early & (limit >= b.column("kth").to_numpy(zero_copy_only=False)[:, None] - NEAR)
                    line, col = np.nonzero(go & (limit >= 0))
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(line)) for c in ("q", "t", "x")], pa.array(cells.id[col], pa.int32())], names=["q", "t", "x", "cell"])

        return run

    def compare(group: tuple, qs: pa.Table, rs: pa.Table) -> pa.Table:
        out = []
        if qs.num_rows and rs.num_rows:
            rs = rs.take(pc.sort_indices(rs["k"]))  # equal scores go by key
            both = pa.chunked_array([*qs["t"].chunks, *rs["t"].chunks]).combine_chunks().flatten()
            names = pa.concat_arrays([pa.array([""], both.type), both]).dictionary_encode()  # code 0: empty
            codes = names.indices.fill_null(-1).to_numpy()[1:].reshape(-1, n_t) if n_t else np.zeros((qs.num_rows + rs.num_rows, 0), int)
            same = pa.chunked_array([*qs["q"].chunks, *rs["k"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
            q, r = Points(codes[: qs.num_rows], *_matrix(qs["x"], n_x)), Points(codes[qs.num_rows :], *_matrix(rs["x"], n_x))
            step = max(1, ENTRIES // rs.num_rows)
            for at in range(0, qs.num_rows, step):
                with np.errstate(all="ignore"):
                    s = measure.score(q.take(at, at + step), r)
                    s = np.floor(s * 10.0**digits + 0.5) / 10.0**digits
                s[(same[at : min(at + step, qs.num_rows), None] == same[None, qs.num_rows :]) | (s < 0)] = -np.inf
                line, col = np.nonzero(_best(np.where(np.isnan(s), np.inf, s), k))
                out.append((at + line, col, s[line, col]))
        line, col, s = (np.concatenate(p) for p in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"q": qs["q"].take(pa.array(line)), "k": rs["k"].take(pa.array(col)), "score": pa.array(s, pa.float64())})

    def met(frame: DataFrame, first: bool) -> DataFrame:
        # a query becomes a row per cell: they are spread before that
        pairs = frame.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(visits(first), f"q {kind}, t array<string>, x array<double>, cell int")
        return pairs.groupBy("cell").cogroup(celled.select("k", "t", "x", "cell").groupBy("cell")).applyInArrow(compare, found_type)

    found = met(asked, True)
    if len(cells.n) > 1:
        found = materialise(found, "near-found")
        best = found.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("_r") == k).select("q", F.col("score").alias("kth"))
        rest = asked.join(best, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0)))
        found = found.unionByName(met(rest, False))
    return found.withColumnsRenamed({"q": f"q_{key}", "k": key})
