"""Small fixtures with known answers: boundaries, missing values, ties, cycles, leakage, determinism."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronorel.catalog import Catalog, TableDef, TaskDef, open_catalog, task_kind
from chronorel.functions import text as X
from chronorel.operators import features as D
from chronorel.operators import graph as G
from chronorel.operators import history as H
from chronorel.operators import labels as L
from chronorel.operators import nearest as N
from chronorel.operators import predict as Z
from chronorel.operators import profiling as P
from chronorel.operators import similarity as M
from chronorel.operators import temporal as T
from chronorel.plans import paths as A


def day(n, base=dt.datetime(2020, 1, 1)):
    return base + dt.timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_unknown_names_are_told(spark):
    with pytest.raises(ValueError, match="supported: shop"):
        open_catalog(spark, "/nowhere", "other")
    with pytest.raises(KeyError, match="known"):
        open_catalog(spark, "/nowhere").df("other")
    with pytest.raises(ValueError, match="unknown sampling"):
        H.build_history(None, None, "e", 1, "id", sampling="other")
    with pytest.raises(ValueError, match="known"):
        L.labels_for("shop", "other")


def test_task_kinds(spark):
    schema = frame(spark, [(1, 2.0, "a")], "k long, v double, s string").schema
    assert task_kind(TaskDef("t", "e", "k", "ts", "v"), schema) == "regression"
    assert task_kind(TaskDef("t", "e", "k", "ts", "s"), schema) == "classification"
    assert task_kind(TaskDef("t", "e", "k", "ts", dst_entity_col="k"), schema) == "link"
    with pytest.raises(ValueError):
        TaskDef("t", "e", "k", "ts").output_col


def test_window_bounds(spark):
    """(ts, ts + H]: open at the start, closed at the end."""
    spine = frame(spark, [(day(0),)], "ts timestamp_ntz")
    events = frame(spark, [(1, day(0), 1.0), (1, day(1), 2.0), (1, day(10), 4.0), (1, day(11), 8.0), (2, day(0), 16.0)], "e long, at timestamp_ntz, v double")
    got = {r["e"]: r["label"] for r in L.window_sum(spine, events, "e", "at", "v", 10).collect()}
    assert got == {1: 6.0}
    active = {r["e"]: r["label"] for r in L.window_sum_of_active(spine, events, "e", "at", "v", 10).collect()}
    assert active == {1: 6.0, 2: 0.0}
    assert {r["e"]: r["label"] for r in L.churn(spine, events, "e", "at", 10).collect()} == {1: 0, 2: 1}


def test_null_values_in_labels(spark):
    spine = frame(spark, [(day(0),)], "ts timestamp_ntz")
    events = frame(spark, [(1, day(1), None), (2, day(1), None), (2, day(2), 3.0)], "e long, at timestamp_ntz, v double")
    assert {r["e"]: r["label"] for r in L.window_sum(spine, events, "e", "at", "v", 10).collect()} == {1: 0.0, 2: 3.0}
    assert {r["e"]: r["label"] for r in L.window_avg(spine, events, "e", "at", "v", 10).collect()} == {2: 3.0}


@pytest.mark.parametrize(("k", "kept"), [(3, [2, 6, 9]), (4, [2, 5, 6, 9])])
def test_recent_min_overlap(spark, k, kept):
    history = frame(spark, [(1, day(n), n) for n in (1, 2, 5, 6, 9)], "entity long, ts timestamp_ntz, id long")
    requests = frame(spark, [(7, 1, day(20))], "request_id long, entity long, query_time timestamp_ntz")
    got = H.build_history(requests, history, "entity", k, "id", sampling="recent_min_overlap", gap_days=3).collect()
    assert sorted(r["id"] for r in got) == kept


def test_horizon_boundary(spark):
    history = frame(spark, [(1, day(0), 1), (1, day(10), 2)], "entity long, ts timestamp_ntz, id long")
    requests = frame(spark, [(7, 1, day(10))], "request_id long, entity long, query_time timestamp_ntz")
    ids = lambda **o: [r["id"] for r in H.visible(requests, history, "entity", **o).collect()]
    assert ids(horizon_days=10) == [1] and ids(horizon_days=10, inclusive=False) == [] and ids() == [1]


def test_random_prior_is_fixed_by_the_seed(spark):
    history = frame(spark, [(1, day(n), n) for n in range(30)], "entity long, ts timestamp_ntz, id long")
    requests = frame(spark, [(7, 1, day(99))], "request_id long, entity long, query_time timestamp_ntz")
    pick = lambda df, s: sorted(r["id"] for r in H.random_prior(H.visible(requests, df, "entity"), 5, "id", s).collect())
    assert pick(history, 1) == pick(history.repartition(7), 1) != pick(history, 2)


def brute_history(requests, history, k, horizon):
    out = set()
    for rid, e, q in requests:
        seen = sorted(((t, i) for h, t, i in history if h == e and t + dt.timedelta(days=horizon) <= q), reverse=True)
        out |= {(rid, i) for _, i in seen[:k]}
    return out


def test_bulk_history_equals_one_by_one(spark):
    history = [(n % 3, day(n * 7 % 50), n) for n in range(60)]
    requests = [(r, r % 3, day(20 + r)) for r in range(25)]
    got = H.build_history(frame(spark, requests, "request_id long, entity long, query_time timestamp_ntz"), frame(spark, history, "entity long, ts timestamp_ntz, id long"), "entity", 4, "id", 5)
    assert {(r["request_id"], r["id"]) for r in got.collect()} == brute_history(requests, history, 4, 5)
    assert H.violations(got, "entity", 5, "id").count() == 0


def small_catalog(spark, note_value=5.0):
    tables = [TableDef("team", "team_id"), TableDef("player", "player_id", fks={"team_id": "team"}), TableDef("game", "game_id", "at", {"player_id": "player"}), TableDef("note", None, "at", {"game_id": "game"}), TableDef("badge", "badge_id", fks={"player_id": "player"})]
    frames = {
        "team": frame(spark, [(1, "x")], "team_id long, name string"),
        "player": frame(spark, [(1, 1), (2, None), (3, 9)], "player_id long, team_id long"),
        "game": frame(spark, [(1, 1, day(1), 10.0), (2, 1, day(2), float("nan")), (3, 1, day(5), 30.0), (4, 2, None, 1.0), (5, 8, day(1), 1.0)], "game_id long, player_id long, at timestamp_ntz, points double"),
        "note": frame(spark, [(1, day(1), note_value), (1, day(4), 7.0), (2, day(2), 1.0), (1, day(1), note_value)], "game_id long, at timestamp_ntz, size double"),
        "badge": frame(spark, [(1, 1), (2, 1)], "badge_id long, player_id long"),
    }
    return Catalog(spark, "", tables, "small", frames)


def test_edges_drop_null_and_dangling_keys(spark):
    e = G.edges(small_catalog(spark)).collect()
    assert sorted((r["src_table"], r["src_pk"]) for r in e if r["src_table"] in ("player", "game", "badge")) == [("badge", "1"), ("badge", "2"), ("game", "1"), ("game", "2"), ("game", "3"), ("player", "1")]
    assert len({r["src_pk"] for r in e if r["src_table"] == "note"}) == 4  # equal rows stay apart


def test_neighbors_respect_the_cutoff(spark):
    adj = G.adjacency(G.edges(small_catalog(spark), ["team", "player", "game", "badge"]))
    seed = frame(spark, [(1, "player", "1", day(2))], "query_id long, `table` string, pk string, cutoff timestamp_ntz")
    got = [(r["dst_table"], r["dst_pk"]) for r in G.neighbors_before(seed, adj, 2).collect()]
    assert sorted(got) == [("game", "1"), ("game", "2")]
    far = G.khop(seed, adj, 2, 10).collect()
    assert not [r for r in far if r["dst_table"] == "game" and r["dst_pk"] == "3"]  # later than the cutoff
    assert [r for r in far if r["hop"] == 2 and r["dst_table"] == "player" and r["dst_pk"] == "1"]  # visited nodes stay in results


def test_cycle_and_self_loop(spark):
    t = [TableDef("n", "id", "at", {"up": "n"})]
    c = Catalog(spark, "", t, "loop", {"n": frame(spark, [(1, 2, day(1)), (2, 1, day(1)), (3, 3, day(1))], "id long, up long, at timestamp_ntz")})
    adj = G.adjacency(G.edges(c))
    seeds = frame(spark, [(1, "n", "1", day(9)), (2, "n", "3", day(9))], "query_id long, `table` string, pk string, cutoff timestamp_ntz")
    assert G.khop(seeds, adj, 4, 5).count() > 0


def features(spark, **kw):
    c = small_catalog(spark, **kw)
    targets = frame(spark, [(1, 1, day(4)), (2, 2, day(4)), (3, 1, day(0))], "query_id long, entity long, cutoff timestamp_ntz")
    return {r["query_id"]: r.asDict() for r in D.synthesize(c, targets, "player", 2).collect()}


def test_features(spark):
    f = features(spark)
    assert f[1]["player.COUNT(game)"] == 2 and f[1]["player.SUM(game.points)"] == 10.0  # NaN is missing, later games unseen
    assert f[2]["player.COUNT(game)"] == 0 and f[2]["player.SUM(game.points)"] is None
    assert f[1]["player.COUNT(badge)"] == 2 and f[3]["player.COUNT(badge)"] == 2  # static children are always visible
    assert f[1]["player.SUM(game.SUM(note.size))"] == 11.0 and f[1]["player.team.name"] == "x" and f[2]["player.team.name"] is None


def test_features_do_not_see_the_future(spark):
    c = small_catalog(spark)
    changed = c.df("note").withColumn("size", F.when(F.col("at") >= F.lit(day(4)), F.lit(999.0)).otherwise(F.col("size")))
    targets = frame(spark, [(1, 1, day(4))], "query_id long, entity long, cutoff timestamp_ntz")
    a = D.synthesize(c, targets, "player", 2).collect()
    b = D.synthesize(c.with_table(c.tables["note"], changed), targets, "player", 2).collect()
    assert a == b


def test_feature_vectors(spark):
    maps = frame(spark, [(1, {"a": 3.0, "b": 4.0}), (2, {"a": 1.0}), (3, {})], "query_id long, features map<string,double>")
    names = D.vocabulary(maps)
    assert names == ["a", "b"]
    assert {r["query_id"]: (r["norm"], r["nonzero"]) for r in D.vectorize(maps, names).collect()} == {1: (5.0, 2), 2: (1.0, 1), 3: (0.0, 0)}


def test_profiles_of_odd_columns(spark):
    df = frame(spark, [(1, float("nan"), None, [1], {"a": 1}), (2, 4.0, None, [1], {"a": 1}), (3, 4.0, None, [2], {"a": 2})], "id long, v double, z string, l array<int>, m map<string,int>")
    s = {r["column"]: (r["n_missing"], r["n_unique"]) for r in P.schema_profile(df, "t").collect()}
    assert s == {"id": (0, 3), "v": (1, 1), "z": (3, 0), "l": (0, 2), "m": (0, 2)}
    assert P.numeric_stats(df.limit(1), ["id"]).first()["std"] == 0.0
    assert [(r["bin"], r["n"]) for r in P.histogram(df, "v").collect()] == [(11, 2)]
    assert P.stable_sample(df, ["id"], 10, 2).count() == 3 and P.stable_sample(df, ["id"], 2, 2).count() == 2
    assert P.temporal_extent(df.limit(0), "t", None).first()["is_empty"]


def test_perfect_association(spark):
    df = frame(spark, [(str(n % 2), str(n % 2), float(n % 2), float(n)) for n in range(100)], "a string, b string, x double, y double")
    assert P.cramers_v(df, ["a", "b"]).first()["score"] == pytest.approx(1.0)
    assert P.eta_squared(df, ["a"], ["x"]).first()["score"] == pytest.approx(1.0)
    assert P.spearman(df, ["y", "x"]).count() == 1 and P.spearman(df.limit(10), ["y", "x"]).count() == 0


def test_ranks_and_quantiles_by_ranges(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random(3000) < 0.33, 7.0, np.round(np.exp(rng.normal(0, 9, 3000)), 3)) * rng.choice([-1, 1], 3000)  # a third in two values
    y = np.where(rng.random(3000) < 0.1, np.nan, np.round(x / 10) + rng.integers(0, 3, 3000))
    df = frame(spark, [(float(a), float(b), 1.0, None) for a, b in zip(x, y)], "x double, y double, one double, none double")
    counts = df.groupBy("one", F.col("x").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = {r["v"]: (r["before"], r["total"]) for r in P.rows_before(counts, ["one"]).collect()}
    assert placed == {float(v): (int((x < v).sum()), 3000) for v in set(x)}
    found = {r["column"]: r["q"] for r in P.quantiles(df, ["x", "y", "none"], P.QUANTILES).collect()}
    assert sorted(found) == ["x", "y"]
    assert found["x"] == pytest.approx(list(np.quantile(x, P.QUANTILES))) and found["y"] == pytest.approx(list(np.nanquantile(y, P.QUANTILES)))
    by_pair = {(r["a"], r["b"]): (r["score"], r["n"]) for r in P.spearman(df, ["x", "y", "one"]).collect()}
    both = pd.DataFrame({"x": x, "y": y}).dropna().rank()
    assert by_pair["x", "y"][0] == pytest.approx(both["x"].corr(both["y"])) and by_pair["x", "y"][1] == len(both)
    assert by_pair["x", "one"] == (None, 3000)
    assert {r["column"]: r["mode"] for r in P.modes(df, ["one", "none"]).collect()} == {"one": "1.0", "none": None}
    assert P.spearman(df.limit(0), ["x", "y"]).count() == 0 and P.quantiles(df.limit(0), ["x"], (0.5,)).count() == 0


def test_points_of_columns_and_tables(spark):
    names = ["label", "targetvalue", "Future_total", "leaky", "outcome", "amount", "rider_id", "note", "order_score", "at"]
    roles = {"rider_id": "identifier", "note": "text", "at": "timestamp"}
    rows = [("rides", n, roles.get(n, "measure"), n not in ("note", "at")) for n in names]
    columns = frame(spark, rows, "`table` string, `column` string, role string, numeric boolean").withColumn("leaks", X.leakage_name(F.col("column")))
    assert {r["column"] for r in columns.filter("leaks").collect()} == set(names[:5])
    scores = {r["column"]: r["score"] for r in A.column_relevance(columns, "order totals", "score").collect()}
    leaking = 2.0 + 1.0 - 4.0
    assert scores == {**dict.fromkeys(names[:5], leaking), "amount": 3.0, "rider_id": 1.0 - 3.0, "note": -1.5, "at": -1.5, "order_score": 3.0 + 4.0 + 2 * 1.4}
    assert A.table_scores(columns, ["rides", "score"]).first()["score"] == pytest.approx(0.9 + 0.6 + 2 * 0.15)
    aggs = {r["column"]: r["a"] for r in columns.select("column", A.suggested_aggs(F.col("column"), F.col("role")).alias("a")).collect()}
    assert aggs["note"] == ["count", "nunique", "mode"] and aggs["order_score"][-1] == "delta" and aggs["amount"][-1] == "sum"


def test_key_names():
    assert P.name_fits("o_custkey", "customer", "c_custkey") and not P.name_fits("statusid", "status", "status_id")
    assert P.name_fits("rider_id", "riders", "id") and not P.name_fits("amount", "customer", "c_custkey")


def test_texts(spark):
    assert X.identifier_tokens("Order_Lines x") == ["order", "lines", "lin", "line"]
    assert X.identifier_tokens("boxes gas es yes") == ["boxes", "box", "boxe", "gas", "es", "yes"]
    assert X.task_tokens("predict the next orders of a customer, using bus 12 lines") == ["orders", "order", "customer", "bus", "lines", "lin", "line"]
    assert X.find_json('say {"a": 1} and {"a": {"b": 2}} {') == {"a": {"b": 2}}
    assert X.find_json("none {") is None
    known = {"orders", "lineitem", "customer"}
    assert X.parse_feature("customer.c_acctbal", "customer", known) == (("customer",), "c acctbal")
    assert X.parse_feature("customer.COUNT(orders)", "customer", known) == (("customer", "orders"), "count of rows in orders")
    assert X.parse_feature("customer.SUM(orders.MEAN(lineitem.l_qty))", "customer", known) == (("customer", "orders", "lineitem"), "sum of mean of l qty within lineitem within orders")
    assert X.parse_feature("customer.orders.lineitem.l_qty", "customer", known) == (("customer", "orders", "lineitem"), "l qty within lineitem within orders")
    assert X.parse_feature("customer.DIFF(SUM(a) (b)", "customer", known)[1] == "DIFF(SUM(a) (b)"
    assert X.parse_feature("customer.", "customer", known) == (("customer",), "feature")
    assert Z.meta_path_lines({"customer.MEAN(orders.o_x)": 2.0}, root="customer", tables=known) == ["customer > orders: mean of o x within orders=2"]
    assert X.json_safe({("a", 1): float("nan"), "t": dt.date(2020, 1, 2)}) == {"a|1": None, "t": "2020-01-02"}
    assert X.quote("a`b") == "`a``b`"
    values = [(3.0,), (1234567.5,), (0.00012,), (2.5,), (None,), (float("nan"),)]
    got = [r[0] for r in frame(spark, values, "v double").select(X.number_text(F.col("v"))).collect()]
    assert got == ["3", "1.235e+06", "1.200e-04", "2.5", "", ""]
    said = frame(spark, [("is -3.5e1.",), ("no",), (None,)], "s string").select(X.first_number(F.col("s"))).collect()
    assert [r[0] for r in said] == [-35.0, 0.0, 0.0]
    assert frame(spark, [(None,), (2.0,), (2.5,), (float("nan"),)], "v double").select(T.entity_key(F.col("v"), "double")).collect() == [("",), ("2",), ("2.5",), ("",)]


def test_search_in_blocks_equals_broadcast(spark, monkeypatch):
    v = frame(spark, [(n, [float(n % 7), float(n % 5), 1.0]) for n in range(60)] + [(99, [0.0, 0.0, 0.0])], "k long, v array<double>")
    q = v.filter("k % 3 = 0")
    one = sorted(map(tuple, M.cosine_search(q, v, "k", "v", 4).collect()))
    monkeypatch.setattr(M, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(M, "BLOCK_ROWS", 4)
    assert sorted(map(tuple, M.cosine_search(q, v, "k", "v", 4).collect())) == one
    assert not [r for r in one if 99 in r[:2]]


def test_map_similarity(spark):
    df = frame(spark, [({"a": 1.0, "b": 2.0}, {"a": 1.0}), ({"a": 1.0}, {"c": 1.0})], "x map<string,double>, y map<string,double>")
    assert [r[0] for r in df.select(M.map_similarity("x", "y")).collect()] == [pytest.approx(0.875), -1.0]


def test_predictor_failures_and_metrics(spark):
    prompts = frame(spark, [(1, "a"), (2, "bad"), (3, "c")], "query_id long, prompt string")

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [f"answer {len(t)}" for t in texts]

    got = {r["query_id"]: (r["raw"], r["prediction"]) for r in Z.predict(prompts, model).collect()}
    assert got == {1: ("answer 1", 1.0), 2: ("", 0.0), 3: ("answer 1", 1.0)}
    scored = frame(spark, [(1.0, 2.0), (5.0, 2.0)], "prediction double, target double")
    assert Z.error_stats(scored).first().asDict() == {"n": 2, "mae": 2.0, "error_variance": 1.0, "error_std": 1.0}
    assert Z.error_stats(scored.limit(0)).first()["mae"] == 0.0
    assert Z.large_gaps(frame(spark, [(1.0, float("nan")), (500.0, 1.0)], "prediction double, target double")).count() == 1
    assert Z.meta_path_lines({"r.SUM(c.x)": 1.0, "r.p.y": 2.0, "r.MAX(c.x)": 3.0}, most_features=1)[-1].endswith("1 additional")
    with (timer := Z.Timer()).phase("x"):
        pass
    assert timer.rows[0][0] == "x" and "seconds" in timer.to_json()


def test_results_do_not_depend_on_partitions(spark):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            c = small_catalog(spark)
            adj = G.adjacency(G.edges(c, ["team", "player", "game", "badge"]))
            seed = frame(spark, [(1, "player", "1", day(9))], "query_id long, `table` string, pk string, cutoff timestamp_ntz").repartition(n)
            return sorted(map(str, G.khop(seed, adj, 3, 2).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)

    assert run(1) == run(7)


# searches by cells with bounds


def _best_by_hand(rows, score, digits, k=3):
    out = set()
    for q in rows:
        if q[0] is None or q[0] % 4:
            continue
        near = sorted((-round(s, digits), r[0]) for r in rows if r[0] not in (None, q[0]) and (s := score(q, r)) is not None)
        out |= {(q[0], key, round(-s, digits), i + 1) for i, (s, key) in enumerate(near[:k])}
    return out


def _searched(df, digits):
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()
    return {(r[0], r[1], round(r["score"], digits), r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("cell", [2, 1000])
def test_similar_attributes_meets_few_pairs_and_loses_none(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "A ", "b", "c", "", None]), rnd.choice("xyz"), rnd.choice([None, True, False]), rnd.choice([None, -4, 0, 1, 2, 50])) for i in range(1, 301)] + [(301, None, None, None, None), (304, None, None, None, None), (None, "a", "x", True, 1)]

    def score(q, r):
        total, n = 0.0, 0
        for i, w in ((1, 2.0), (2, 2.0), (3, 1.0)):
            a, b = (v.strip().lower() if isinstance(v, str) else v for v in (q[i], r[i]))
            if a is not None and b is not None:
                n, total = n + 1, total + w * (a == b)
        if q[4] is not None and r[4] is not None:
            n, total = n + 1, total + max(0.0, 1 - abs(q[4] - r[4]) / max(abs(q[4]), abs(r[4]), 1.0))
        return total if n else None

    df = spark.createDataFrame(rows, "key int, s string, t string, f boolean, x int")
    got = _searched(M.similar_by_attributes(df.filter("key % 4 = 0"), df, "key", ["s", "t", "f", "x"], 3), 9)
    assert got == _best_by_hand(rows, score, 9)


@pytest.mark.parametrize("cell", [2, 1000])
def test_static_search_meets_few_pairs_and_loses_none(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    rnd = random.Random(4)
    for d in (0, 1, 2):
        rows = [(i, [rnd.choice([0.0, 1e-5, -3e-5, 0.25 * rnd.randint(-8, 8)]) for _ in range(d)], [rnd.choice(["p", "q", "r", ""]), rnd.choice("uv")]) for i in range(1, 301)]

        def score(q, r):
            norm = lambda v: math.sqrt(sum(a * a for a in v))
            cos = min(max((sum(a * b for a, b in zip(q[1], r[1])) / (norm(q[1]) * norm(r[1]) + 1e-8) + 1) * 0.5, 0.0), 1.0) if norm(q[1]) > 0 else 0.0
            cat = sum(a == b != "" for a, b in zip(q[2], r[2])) / sum(a != "" for a in q[2])
            return 0.7 * cos + 0.3 * cat if q[1] else cat

        df = spark.createDataFrame(rows, "key long, num array<double>, cat array<string>").withColumn("num_norm", M.norm("num"))
        assert _searched(M.static_search(df.filter("key % 4 = 0"), df, "key", 3), 6) == _best_by_hand(rows, score, 6)


@pytest.mark.parametrize("cell", [2, 1000])
def test_feature_search_meets_few_pairs_and_loses_none(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL_ROWS", cell)
    rnd = random.Random(5)
    rows = [(i, {n: rnd.choice([0.0, -1.0, float(rnd.randint(1, 40)), 1e5 * rnd.random()]) for n in "abc" if rnd.random() < 0.7}) for i in range(1, 301)]

    def score(q, r):
        both = [n for n in q[1] if n in r[1]]
        if both:
            return 0.75 * math.exp(-sum(abs(r[1][n] - q[1][n]) / max(abs(q[1][n]), 1e-6) for n in both) / len(both)) + 0.25 * len(both) / len(q[1])

    df = spark.createDataFrame(rows, "key long, f map<string,double>")
    assert _searched(M.feature_search(df.filter("key % 4 = 0"), df, "key", "f", 3), 6) == _best_by_hand(rows, score, 6)


def test_searches_of_empty_tables(spark):
    df = spark.createDataFrame([], "key long, num array<double>, cat array<string>, f map<string,double>, s string")
    assert M.static_search(df, df, "key", 3).count() == M.feature_search(df, df, "key", "f", 3).count() == M.similar_by_attributes(df, df, "key", ["s"], 3).count() == 0
