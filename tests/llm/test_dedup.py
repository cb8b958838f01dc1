"""Exact, line and near de-duplication, decontamination and sharding against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronorel.llm.decontaminate import contained_items, drop_contaminated
from chronorel.llm.exact_dedup import drop_exact_copies, exact_dedup
from chronorel.llm.line_dedup import drop_common_lines
from chronorel.llm.near_dedup import drop_near_copies, near_duplicates
from chronorel.llm.queries import ORACLE_SQL, QUERIES
from chronorel.llm.sharding import shard_by_bytes

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest()].append(i)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, h) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [4, 512])
def test_exact(docs_of, odd, counters):
    rows = odd + [(100 + n, "hot  text") for n in range(40)] + [(200 + n, f"pair {n // 2}") for n in range(20)]
    got = exact_dedup(docs_of(rows), counters=counters).collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows)
    kept = drop_exact_copies(docs_of(rows), counters=counters)
    assert kept.columns == docs_of(rows).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, k, _, keep, _ in brute_exact(rows) if keep)


def brute_lines(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            seen[key(x)].add(i)
    gone = {k for k, ids in seen.items() if k and len(ids) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [3, 512])
def test_lines(docs_of, odd, counters):
    rnd = random.Random(1)
    rows = odd + [(100 + n, "\n".join(rnd.choice(["Header  ", " header", "line A", f"own {n}", "", "Ünïcode", "ünïcode"]) for _ in range(rnd.randrange(90)))) for n in range(40)]
    got = drop_common_lines(docs_of(rows), min_docs=4, counters=counters).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows, 4)


def shingles(t, k):
    w = [x for x in SPACE.split((t or "").translate(LOW)) if x]
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_near(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a != b and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def near_rows(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for b in range(n // 8):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))]
        for c in range(8):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 8)) if c else 0):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((b * 8 + c, " ".join(w).upper() if c == 3 else " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (5, 2)])
def test_near(docs_of, k, seed, monkeypatch):
    import chronorel.llm.near_dedup as N

    monkeypatch.setattr(N, "BLOCK_X", 3)
    monkeypatch.setattr(N, "BLOCK_Y", 5)
    rows = near_rows(seed) + [(900, None), (901, ""), (902, " ")]
    got = near_duplicates(docs_of(rows), shingle_words=k).collect()
    assert sorted(map(tuple, got)) == brute_near(rows, k)


def test_steps_leave_no_shuffle_files(spark):
    """Without waiting for the driver's garbage collection; the caller's setting stays as it was."""
    from chronorel.session import materialise

    blocks, key = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}

    setting, before = spark.conf.get(key), shuffles()
    done = materialise(spark.range(20_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "t-shuffles")
    for _ in range(20):  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert done.count() == 7 and spark.conf.get(key) == setting


def test_near_steps_shuffle_keys_once(docs_of, monkeypatch):
    """The key rows are the largest shuffle: no step holds them twice."""
    import chronorel.llm.near_dedup as N

    real, twice = N.materialise, []

    def watched(df, name):
        if df._jdf.queryExecution().optimizedPlan().toString().count("posexplode(") > 2:
            twice.append(name)
        return real(df, name)

    monkeypatch.setattr(N, "materialise", watched)
    rows = near_rows(3, 40)
    assert sorted(map(tuple, near_duplicates(docs_of(rows), shingle_words=2).collect())) == brute_near(rows, 2)
    assert not twice


def test_near_misses_are_rare():
    from chronorel.llm.near_dedup import BANDS, ROWS

    assert 2 * (1 - 0.8**ROWS) ** BANDS < 2.1e-4  # as 9 bands of 2 had it


def test_near_odd_rows(docs_of, odd):
    got = near_duplicates(docs_of(odd), shingle_words=5).collect()
    assert len(got) == len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_shingles"] == 0 and by[1]["kept"] and by[1]["component_id"] == 1
    assert by[None]["component_id"] is None and by[4]["n_shingles"] == 1
    kept = drop_near_copies(docs_of(odd), shingle_words=5)
    assert kept.count() == len(odd)


def brute_contained(rows, items):
    out = set()
    for item, text in items:
        q = shingles(text, 5)
        k = min(5, len([x for x in SPACE.split((text or "")) if x]))
        for i, t in rows:
            if q and 100 * len(q & shingles(t, k)) >= 80 * len(q):
                out.add((i, item, len(q), len(q & shingles(t, k))))
    return out


def test_decontamination(spark, docs_of, odd):
    rnd = random.Random(5)
    word = lambda: f"v{rnd.randrange(5000)}"
    items = [(n, " ".join(word() for _ in range(rnd.randrange(1, 60)))) for n in range(30)] + [(90, None), (91, " "), (92, "Two words")]
    rows = list(odd)
    for n in range(60):
        w = [word() for _ in range(rnd.randrange(0, 400))]
        passage = items[rnd.randrange(30)][1].upper().split(" ")
        for _ in range(rnd.choice([0, 0, 1, 3])):
            passage[rnd.randrange(len(passage))] = word()
        at = rnd.randrange(len(w) + 1)
        rows.append((100 + n, "\t".join(w[:at] + passage + w[at:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contained_items(docs_of(rows), bench)
    assert {tuple(r)[:4] for r in got.collect()} == brute_contained(rows, items)
    hit = {i for i, *_ in brute_contained(rows, items)}
    assert Counter(r["doc_id"] for r in drop_contaminated(docs_of(rows), bench).collect()) == Counter(i for i, _ in rows if i not in hit)
    assert contained_items(docs_of(rows), bench.limit(0)).count() == 0 and contained_items(docs_of([]), bench).count() == 0


def test_decontamination_without_broadcast(spark, docs_of, monkeypatch):
    import chronorel.llm.decontaminate as C

    text = " ".join(f"t{n}" for n in range(30))
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    monkeypatch.setattr(C, "BROADCAST_KEYS", 0)
    assert [r["doc_id"] for r in contained_items(docs_of([(1, "x " + text + " y"), (2, "x y")]), bench).collect()] == [1]


def check_shards(rows, got, shards):
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1) for i, t in rows if i is not None)
    assert all(r["text_crc32"] in {zlib.crc32((t or "").encode()) for _, t in rows} for r in got)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    for rs in by.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    assert set(by) <= set(range(shards))
    return {s: sum(r["size"] for r in rs) for s, rs in by.items()}


def test_shards(docs_of, odd):
    rnd = random.Random(3)
    rows = [(n, "x" * rnd.randrange(2000) if n % 3 else "the same text again") for n in range(3000)]
    sums = check_shards(rows, shard_by_bytes(docs_of(rows), 8).collect(), 8)
    mean = sum(sums.values()) / 8
    assert len(sums) == 8 and max(sums.values()) < 1.05 * mean and min(sums.values()) > 0.95 * mean
    check_shards(odd, shard_by_bytes(docs_of(odd), 8).collect(), 8)
    assert shard_by_bytes(docs_of([]), 8).count() == 0


def test_one_text_for_all(docs_of):
    rows = [(n, "same") for n in range(800)]
    sums = check_shards(rows, shard_by_bytes(docs_of(rows), 8).collect(), 8)
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 10


@pytest.mark.parametrize("make", [exact_dedup, drop_common_lines, near_duplicates, shard_by_bytes])
def test_empty_table(docs_of, make):
    assert make(docs_of([])).count() == 0


def rows_left(frame):
    return sorted((tuple(r)[:2] for r in frame.collect()), key=repr)


def test_stages_drop_rows_not_ids(spark, docs_of):
    """Null and repeated ids: only rows that are copies or hold a passage themselves go."""
    text = " ".join(f"t{n}" for n in range(60))
    near, other, last = text + " end", " ".join(f"o{n}" for n in range(40)), " ".join(f"l{n}" for n in range(40))
    rows = [(1, text), (None, text.upper()), (None, near), (None, other), (2, near), (2, last), (3, text), (3, text), (4, None), (5, ""), (None, last)]
    docs = docs_of(rows)
    assert rows_left(drop_near_copies(docs, shingle_words=5)) == sorted([(1, text), (None, other), (2, last), (4, None), (5, "")], key=repr)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    gone = Counter([(3, text), (3, text), (5, ""), (None, near), (None, last)])
    assert rows_left(kept) == sorted((Counter(rows) - gone).elements(), key=repr)
    bench = spark.createDataFrame([(7, other), (8, last)], "item_id long, text string")
    clean = drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert rows_left(clean) == sorted([r for r in rows if r[1] not in (other, last)], key=repr)


def test_near_links_null_ids(docs_of):
    text = " ".join(f"t{n}" for n in range(60))
    rows = [(None, text), (5, text + " end"), (None, "x y"), (9, text), (None, "x y")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows)).collect()), key=repr)
    assert got == sorted([(None, 5, False), (5, 5, True), (9, 5, False), (None, None, True), (None, None, True)], key=repr)


def test_items_of_every_length_in_one_pass(spark, docs_of):
    items = [(n, " ".join(f"w{k}" for k in range(n))) for n in range(1, 12)] + [(3, "W0 W1  W2"), (20, "a a a a a a"), (20, "a a a a a a a")]
    rows = [(n, "so " + " ".join(f"w{k}" for k in range(n)) + " it") for n in range(0, 12)] + [(30, "a " * 9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r)[:4] for r in contained_items(docs_of(rows), bench).collect()} == brute_contained(rows, items)
