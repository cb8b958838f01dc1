"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the training documents as
packed arrays of 64-bit keys, summed per key block.  A pair's count ``c`` is
quantised to the level ``1 + floor(log_b c)`` and the filter of its block holds
the pair with every level up to that one; a reader probes level after level
until one is missing.  Word counts stay exact, since the base score needs them.

Tables that fit ``broadcast_bytes`` are broadcast.  Larger ones stay where they
are: documents are brought together in chunks of a bounded number of tokens, each
chunk's distinct keys travel to their blocks, once a chunk and block, and the
answers (word counts, levels of pairs) travel back in the order of the keys.  Both
ways read the same blocks, hence give the same scores.

Model: ``p(w | v) = L * c(vw) / c(v) + (1 - L) * p(w)`` with
``p(w) = (1 - u) * c(w) / N`` for known words and ``u``, the share of words seen
once, for the unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package
from .shingles import WordHashes, give_back, lean, mix, word_hashes

#: Keys a block aims at, tokens a chunk aims at, and the largest broadcast.
BLOCK_KEYS, CHUNK_TOKENS, BROADCAST_BYTES = 1_000_000, 1_000_000, 192 << 20
BASE_LOG, HASHES, BITS_PER_KEY = 1.5, 6, 10
INTERPOLATION = 0.25
_END, _MUL = np.uint64(0x656E64), np.uint64(0x9E3779B97F4A7C15)
_HALF, _THREE, _SEVEN = np.uint64(32), np.uint64(3), np.uint64(7)


def _keys(text: str | None, memo: WordHashes, kinds: int = 2) -> tuple[np.ndarray, ...]:
    """Keys of a text's tokens (its words, then the end) and, of two kinds, of its pairs (the end also stands before the first word)."""
    uni = mix(np.append(word_hashes(text, memo), _END))
    if kinds == 1:
        return (uni,)
    before = np.append(mix(np.array([_END])), uni[:-1])
    return uni, mix(before * _MUL + uni)


def _packed(keys: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, keys, counts) of sorted keys: a block holds the keys with the same upper bits."""
    if bits:
        cut = np.flatnonzero(np.diff(keys >> np.uint64(64 - bits))) + 1
        for k, c in zip(np.split(keys, cut), np.split(counts, cut), strict=True):
            if len(k):
                yield int(k[0] >> np.uint64(64 - bits)), k.tobytes(), c.tobytes()
    elif len(keys):
        yield 0, keys.tobytes(), counts.tobytes()


def _counter(bits: int, kinds: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, n = WordHashes(), tuple([] for _ in range(kinds)), 0

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, keys in enumerate(held):
                u, c = np.unique(np.concatenate(keys), return_counts=True)
                rows += [(kind, *x) for x in _packed(u, c.astype(np.uint32), bits)]
                keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "block", "keys", "counts"])

        for batch in batches:
            for t in batch.column(0):
                for x, y in zip(held, _keys(t.as_py(), memo, kinds), strict=True):
                    x.append(y)
                n += len(held[0][-1])
                if n >= 2_000_000:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return count


def _hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of the probes of (key, level)."""
    h = mix(keys + np.asarray([level], np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return h, mix(h * _MUL) | np.uint64(1)


def _bit(h: np.ndarray, g: np.ndarray, i: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """Position of the i-th probe in a filter of ``size`` bits (below 2 ** 32)."""
    return (((h + np.uint64(i) * g) >> _HALF) * size) >> _HALF


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log-frequency Bloom filter (bytes) of distinct keys and their counts."""
    level = 1 + np.floor(np.log(counts) / np.log(BASE_LOG) + 1e-9).astype(np.int64)
    size = max(64, -(-int(level.sum()) * BITS_PER_KEY // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        h, g = _hashed(keys[level >= q], q)
        for i in range(HASHES):
            bits[_bit(h, g, i, np.uint64(size))] = 1
    return np.packbits(bits, bitorder="little")


def level_count(q: int) -> float:
    """Mean count of a level."""
    return 1.0 if q == 1 else (BASE_LOG ** (q - 1) + BASE_LOG**q - 1) / 2


#: Mean counts by level; 0: absent.  No count of 64 bits has a higher level.
LEVEL_COUNTS = np.array([0.0] + [level_count(q) for q in range(1, 128)])


def probe_levels(filt: np.ndarray, keys: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The highest level whose probes, and all below, succeed; 0 where level 1 fails.

    Each key has a filter of its own ``size`` bits from bit ``start`` of ``filt``.
    """
    out, alive, q = np.zeros(len(keys), np.uint8), np.flatnonzero(size), 1
    while len(alive):
        h, g = _hashed(keys[alive], q)
        n, at = size[alive], start[alive]
        for i in range(HASHES):
            bit = at + _bit(h, g, i, n)
            hit = np.flatnonzero((filt[bit >> _THREE] >> (bit & _SEVEN).astype(np.uint8)) & np.uint8(1))
            if len(hit) < len(alive):  # most absent keys fail at once
                alive, h, g, n, at = alive[hit], h[hit], g[hit], n[hit], at[hit]
        out[alive] = q
        q += 1
        if q == len(LEVEL_COUNTS):  # a filter full of ones
            break
    return out


def probe_filter(filt: np.ndarray, keys: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mean counts of the levels that :func:`probe_levels` finds."""
    return LEVEL_COUNTS[probe_levels(filt, keys, size, start)]


def _block(key: tuple, group: pa.Table) -> pa.Table:
    """One block: exact sorted word counts, or the filter of its pairs."""
    kind, block = int(key[0].as_py()), int(key[1].as_py())
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("counts")]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    total, types, once = int(counts.sum()), len(keys), int((counts == 1).sum())
    if kind:
        data, more = build_filter(keys, counts).tobytes(), b""
    else:
        data, more = keys.tobytes(), counts.astype(np.uint32 if counts.max() < 2**32 else np.int64).tobytes()
    return pa.table({"kind": pa.array([kind], pa.int32()), "block": pa.array([block], pa.int32()), "data": pa.array([data], pa.binary()), "more": pa.array([more], pa.binary()), "total": [total], "types": [types], "once": [once]})


class Tables:
    """Answers keys from blocks of tables laid end to end: word counts exactly, pair counts through the filters."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], bits: int) -> None:
        self.bits = bits
        words = sorted((r for r in rows if r[0] == 0), key=lambda r: r[1])
        pairs = sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.known = join([np.frombuffer(r[2], np.uint64) for r in words], np.uint64)  # blocks are ranges of keys: sorted as a whole
        self.counts = join([np.frombuffer(r[3], np.uint32 if 2 * len(r[3]) == len(r[2]) else np.int64) for r in words], np.uint32)
        self.filter = join([np.frombuffer(r[2], np.uint8) for r in pairs], np.uint8)
        self.blocks = np.array([r[1] for r in pairs], np.int64)
        self.sizes = np.array([8 * len(r[2]) for r in pairs] + [0], np.uint64)  # the last: no such block
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Counts of words as 64-bit integers, levels of pairs as bytes."""
        if not kind:
            if not len(self.known):
                return np.zeros(len(keys), np.int64)
            place = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            return np.where(self.known[place] == keys, self.counts[place], 0).astype(np.int64)
        block = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        place = np.searchsorted(self.blocks, block)
        place = np.where(np.append(self.blocks, -1)[place] == block, place, len(self.blocks))
        return probe_levels(self.filter, keys, self.sizes[place], self.starts[place])


def _scored(ids, texts, ask, n: int, v: int, once: int, kinds: int, memo: WordHashes) -> pa.RecordBatch:
    """Scores of a run of documents; ``ask(kind, keys)`` is asked once for the sorted distinct keys of the run.  Of one kind: no model's score."""
    cut, held = [0], tuple([] for _ in range(kinds))
    for t in texts:
        for x, y in zip(held, _keys(t, memo, kinds), strict=True):
            x.append(y)
        cut.append(cut[-1] + len(held[0][-1]))
    uni, starts = np.concatenate(held[0]), np.asarray(cut[:-1])
    lengths = np.diff(np.asarray(cut))
    total = lambda x: np.add.reduceat(x, starts)
    u, at = np.unique(uni, return_inverse=True)
    counts = ask(0, u).astype(float)
    c = counts[at]
    base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[at]
    score = pa.nulls(len(ids), pa.float64())
    if kinds == 2:
        w, wat = np.unique(np.concatenate(held[1]), return_inverse=True)
        cp = LEVEL_COUNTS[ask(1, w)][wat]
        context = np.append(0.0, c[:-1])
        context[starts] = counts[np.searchsorted(u, mix(np.array([_END])))]
        unknown = max(once, 0.5) / (n + 1)
        p = np.where(c > 0, (1 - unknown) * c / max(n, 1), unknown)
        seen = np.where(context > 0, np.minimum(cp, context) / np.maximum(context, 1), p)
        score = pa.array(total(np.log10(np.where(context > 0, INTERPOLATION * seen + (1 - INTERPOLATION) * p, p))))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(total((c > 0).astype(np.int64)), pa.int64()), pa.array(total(base)), score], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _by_broadcast(docs: DataFrame, tables: DataFrame, bits: int, stats: tuple[int, int, int, int]) -> DataFrame:
    rows = [(r["kind"], r["block"], bytes(r["data"]), bytes(r["more"])) for r in tables.select("kind", "block", "data", "more").toLocalIterator()]
    flat = Tables(rows, bits)
    del rows  # the blocks are copied: only one of the two is held while it is sent
    sent = docs.sparkSession.sparkContext.broadcast(flat)
    del flat
    give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_, memo = sent.value, WordHashes()
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(i.as_py())
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= 2_000_000:
                    yield _scored(ids, texts, tables_, *stats, memo)
                    ids, texts, size = [], [], 0
            if ids:
                yield _scored(ids, texts, tables_, *stats, memo)

    return docs.mapInArrow(lean(run), _SCORES)


def _by_chunks(docs: DataFrame, tables: DataFrame, bits: int, stats: tuple[int, int, int, int], chunks: int) -> DataFrame:
    kinds = stats[3]
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(chunks)).cast("int")).repartition("chunk")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct keys of each chunk by block; the rows come sorted by chunk."""
        memo, chunk, held = WordHashes(), None, tuple([] for _ in range(kinds))

        def flush() -> pa.RecordBatch:
            rows = []
            for kind, keys in enumerate(held):
                u = np.unique(np.concatenate(keys))
                keys.clear()
                rows += [(chunk, kind, b, k) for b, k, _ in _packed(u, np.zeros(len(u), np.uint8), bits)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "kind", "block", "keys"])

        for batch in batches:
            for c, t in zip(batch.column("chunk").to_pylist(), batch.column("text"), strict=True):
                if c != chunk and held[0]:
                    yield flush()
                chunk = c
                for x, y in zip(held, _keys(t.as_py(), memo, kinds), strict=True):
                    x.append(y)
        if held[0]:
            yield flush()

    def answer(key: tuple, asked: pa.Table, held: pa.Table) -> pa.Table:
        kind, block = int(key[0].as_py()), int(key[1].as_py())
        values: list[bytes] = []
        if asked.num_rows:
            held_block = Tables([(kind, block, held.column("data")[i].as_py(), held.column("more")[i].as_py()) for i in range(held.num_rows)], bits)
            keys = [np.frombuffer(k.as_py(), np.uint64) for k in asked.column("keys")]
            values = [x.tobytes() for x in np.split(held_block(kind, np.concatenate(keys)), np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"chunk": asked.column("chunk"), "kind": asked.column("kind"), "block": asked.column("block"), "vals": pa.array(values, pa.binary())})

    def finish(key: tuple, own: pa.Table, answers: pa.Table) -> pa.Table:
        by = sorted(zip(*[answers.column(c).to_pylist() for c in ("kind", "block", "vals")], strict=True))  # blocks are ranges of keys
        known = [np.frombuffer(b"".join(v for k, _, v in by if k == kind), np.uint8 if kind else np.int64) for kind in range(kinds)]

        def ask(kind: int, keys: np.ndarray) -> np.ndarray:
            if len(keys) != len(known[kind]):
                raise RuntimeError("a chunk's answers do not fit its keys")
            return known[kind]

        if not own.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))
        return pa.Table.from_batches([_scored(own.column("doc_id").to_pylist(), own.column("text").to_pylist(), ask, *stats, WordHashes())])

    asked = dealt.sortWithinPartitions("chunk").mapInArrow(lean(wanted), "chunk int, kind int, block int, keys binary")
    answers = asked.groupBy("kind", "block").cogroup(tables.select("kind", "block", "data", "more").groupBy("kind", "block")).applyInArrow(answer, "chunk int, kind int, block int, vals binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, _SCORES)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, broadcast_bytes: int = BROADCAST_BYTES, base_only: bool = False) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on rows whose crc32(id as text) mod ``folds`` is not 0.  A null or
    empty text is one token, the end.  A null id is held in training.  With no
    training rows every word is unknown and train_tokens is 0.  Rows that
    repeat are rows like others.  An empty table gives no rows; further columns
    are ignored; ids are integers.  ``base_only``: no pairs are counted, and the
    column score is left out.
    """
    kinds = 1 if base_only else 2
    ship_package(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    chars = base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(1, chars / 6 / BLOCK_KEYS)))))
    packed = base.filter(~held).select("text").mapInArrow(lean(_counter(bits, kinds)), "kind int, block int, keys binary, counts binary")
    tables = materialise(packed.groupBy("kind", "block").applyInArrow(_block, "kind int, block int, data binary, more binary, total long, types long, once long"), "lm-tables")
    total = tables.groupBy("kind").agg(F.sum("total"), F.sum("types"), F.sum("once"), F.sum(F.length("data") + F.length("more")).alias("bytes")).collect()
    n, v, once = next(((r[1], r[2], r[3]) for r in total if r[0] == 0), (0, 0, 0))
    if sum(r["bytes"] for r in total) <= broadcast_bytes:
        scored = _by_broadcast(base, tables, bits, (n, v, once, kinds))
    else:
        scored = _by_chunks(base, tables, bits, (n, v, once, kinds), max(1, int(chars / 6 / CHUNK_TOKENS)))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", *["score"][: kinds - 1])
