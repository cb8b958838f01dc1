"""Sequence packing by non-negative least squares over a length histogram.

Documents are tokenised once and cut every ``window`` ids; what remains are
pieces of 1 to ``window`` ids.  Their length histogram has at most ``window``
bins, so planning is bounded at any input size:

1. enumerate shallow combinations (one to three lengths) that fill a window;
2. solve for non-negative repeat counts that reproduce the histogram;
3. round them down to what the histogram still holds;
4. pack the residual counts greedily, longest first, best partner first.

The plan maps ``(length, rank)`` ranges to sequences.  Ranks are numbered within
``(length, salt)`` groups; a length has as many salts as its count asks for, so
that a length shared by most rows (whole windows, in long texts) spreads over
tasks at any size.  The plan that is broadcast has at most ``COMBINATIONS`` runs
from the equations, and each greedy run uses up a length or closes a sequence
that no other length fits, so it does not grow with the rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .shingles import lean

WINDOW, END_ID, COMBINATIONS = 2048, 1, 60_000
#: Pieces of one length that one task numbers.
GROUP_PIECES = 250_000


class Encoder:
    """Ids of a text under a tokenizers file, plus an end id.

    The same vocabulary also comes as ranks, whose encoder gives the same ids
    several times faster for ordinary text; a text that holds the string of a
    special token goes to the tokenizers library itself.
    """

    def __init__(self, path: str, end_id: int) -> None:
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.end, ranks = end_id, path.removesuffix(".json") + ".tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.slow.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray([*ids, self.end], "<u4")


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder a worker process."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def _cutter(path: str, window: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, end_id)
        for batch in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]

            def flush(out: list[list] = out) -> pa.RecordBatch:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "input_ids"][: 5 + with_ids])
                for x in out:
                    x.clear()
                return made

            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py())
                for s in range(0, len(ids), window):
                    piece = ids[s : s + window]
                    for x, value in zip(out, (doc.as_py(), s, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32)), strict=False):
                        x.append(value)
                if len(out[0]) >= 20_000:
                    yield flush()
            if out[0]:
                yield flush()

    return cut


def _nnls(a_rows: np.ndarray, a_cols: np.ndarray, n_cols: int, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """argmin |A x - target| over x >= 0 for a sparse 0/1-count matrix, by accelerated projected gradient."""
    ax = lambda x: np.bincount(a_rows, x[a_cols], len(target))
    at = lambda r: np.bincount(a_cols, r[a_rows], n_cols)
    v = np.ones(n_cols)
    for _ in range(20):  # largest eigenvalue of A'A, for the step
        v = at(ax(v / np.linalg.norm(v)))
    step, x, y, t = 1 / (np.linalg.norm(v) * 1.02), np.zeros(n_cols), np.zeros(n_cols), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * at(ax(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def _combinations(hist: np.ndarray, window: int, most: int) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill the window exactly; triples spread evenly over the lengths."""
    present = [int(k) for k in np.flatnonzero(hist)]
    have = set(present)
    combos: list[tuple[int, ...]] = [(window,)] if window in have else []
    combos += [(k, window - k) for k in present if 2 * k >= window and window - k in have]
    each = max(1, most // max(len(present), 1))
    for a in reversed(present):
        rest = window - a
        mids = [b for b in present if b <= a and 2 * b >= rest and rest - b in have and rest > b]
        for b in mids[:: max(1, len(mids) // each)][:each]:
            combos.append((a, b, rest - b))
    return combos


def plan(hist: np.ndarray, window: int = WINDOW, most: int = COMBINATIONS) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many such sequences)] that uses every piece of the histogram once.

    ``hist[k]`` pieces have length ``k``.  ``most`` bounds the enumerated
    combinations, not the pieces: what they leave is packed greedily.
    """
    left, out = hist.astype(np.int64).copy(), []
    combos = _combinations(hist, window, most)
    if combos:
        cols = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
        rows = np.fromiter((k for c in combos for k in c), np.int64, len(cols))
        counts = _nnls(rows, cols, len(combos), hist.astype(float))
        for i in np.argsort(-counts, kind="stable"):
            need: dict[int, int] = defaultdict(int)
            for k in combos[i]:
                need[k] += 1
            n = min(int(np.floor(counts[i] + 1e-6)), *(int(left[k]) // q for k, q in need.items()))
            if n > 0:
                for k, q in need.items():
                    left[k] -= n * q
                out.append((combos[i], n))
    # residuals: the longest length opens sequences, the longest that fit fill them, many at once
    while (lengths := np.flatnonzero(left)).size:
        top = int(lengths[-1])
        parts, room = [top], window - top
        used: dict[int, int] = defaultdict(int)
        used[top] = 1
        while room:
            fits = lengths[: np.searchsorted(lengths, room, side="right")]
            k = next((int(x) for x in fits[::-1] if left[x] > used[int(x)]), 0)
            if not k:
                break
            used[k] += 1
            parts.append(k)
            room -= k
        n = min(int(left[k]) // q for k, q in used.items())
        for k, q in used.items():
            left[k] -= n * q
        out.append((tuple(parts), n))
    return out


def _ranges(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first rank, first sequence, offset) of each run of ranks."""
    at, base, found = defaultdict(int), 0, defaultdict(list)
    for parts, n in planned:
        offset = 0
        for k in parts:
            found[k].append((at[k], base, offset))
            at[k] += n
            offset += k
        base += n
    return {k: tuple(np.asarray(x, np.int64) for x in zip(*v, strict=True)) for k, v in found.items()}


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and input_ids if asked for).

    A null or empty text has the end id alone.  Every id lies in exactly one
    piece; offsets run without gaps from 0 in each sequence, and no sequence
    exceeds the window.  Rows that repeat an id are packed like any others.
    An empty table gives no pieces.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", input_ids array<int>" * with_ids
    pieces = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t")).mapInArrow(lean(_cutter(tokenizer_path, window, end_id, with_ids)), schema), "pack-pieces")
    hist = np.zeros(window + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most `window` rows
        hist[length] = n
    salts = F.array(*[F.lit(int(x)) for x in np.maximum(1, -(-hist // GROUP_PIECES))])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), salts[F.col("length").cast("int")]).cast("int"))
    counts = materialise(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "pack-counts")  # at most window + rows / GROUP_PIECES rows
    sent = spark.sparkContext.broadcast(_ranges(plan(hist, window)))
    start = counts.withColumn("_first", F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(order)).join(F.broadcast(start), ["length", "_salt"]).withColumn("_rank", F.col("_first") + F.col("_in") - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["input_ids"] * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = sent.value
        for batch in batches:
            lengths, ranks = batch.column(2).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for k in np.unique(lengths):
                begin, base, offset = ranges[int(k)]
                rows = np.flatnonzero(lengths == k)
                run = np.searchsorted(begin, ranks[rows], side="right") - 1
                seq[rows], off[rows] = base[run] + ranks[rows] - begin[run], offset[run]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off), *batch.columns[5:-1]], names=[*names[:5], "sequence_id", "offset", *names[5:]])

    return ranked.select(*names, "_rank").mapInArrow(place, schema.replace("doc_tokens long", "doc_tokens long, sequence_id long, offset long"))
