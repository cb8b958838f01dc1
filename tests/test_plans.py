"""Task compilation, configuration, artifacts and streams."""

import math

import pytest
from pyspark.sql import functions as F

from chronorel.catalog import open_catalog
from chronorel.plans import paths as A
from chronorel.plans import schema_graph as S
from chronorel.plans import task_spec as K
from chronorel.sources import artifacts as R
from chronorel.streaming import windows as V

ROWS = [K.PathRow("p1", ["c", "o"], 1, 5.0, attributes=[{"table": "o", "column": "x"}]), K.PathRow("p2", ["c", "o", "l"], 2, 4.0), K.PathRow("p3", ["c", "n", "r", "s", "t"], 4, -3.0)]


def test_greedy_selection_gains_coverage():
    chosen = [r.path_id for r in K.select_greedily(ROWS, {"o", "l"}, {"l"})]
    assert chosen[0] in ("p1", "p2") and "p3" not in chosen


def test_rounds_stop_when_stable():
    policy, log = K.compile_rounds(ROWS, {"o"}, {"o"}, solver=lambda p: {"selected_paths": ["p1", "p2"], "unknown": 1}, critic=lambda p: {"bad": ["p2"]} if "p2" in p["selected_paths"] else {}, rounds=4)
    assert policy["selected_paths"] == ["p1"] and "unknown" not in policy and 1 <= len(log) <= 4


def test_spec_validation():
    policy, _ = K.compile_rounds(ROWS, {"o"}, {"o"})
    spec = K.make_spec("t", "c", "2020-01-01", policy, ROWS)
    assert K.validate_spec(spec, ROWS, "2020-01-01") == []
    assert K.validate_spec({**spec, "selected_paths": ["p9"], "cutoff": "x"}, ROWS, "2020-01-01") == ["unknown path p9", "the cutoff is not the bundle's"]
    assert K.validate_spec({}, ROWS, "x")[0] == "missing key task"
    assert "o" in K.feature_columns(spec, ["c"]) and K.safety_rules([("a", "label_x"), ("a", "b")], "c", ("label",))["excluded_columns"] == ["a.label_x"]


def test_dominated_path_loses(spark):
    p = spark.createDataFrame([(["c", "o"], ["e"], [1.0], 1, 1.0, 1.0), (["c", "n", "o"], ["e", "f"], [1.0, 1.0], 2, 1.0, 1.0)], "tables array<string>, edges array<string>, weights array<double>, depth int, relevance double, row_multiplier double")
    got = {r["depth"]: r["dominated"] for r in A.rescore(p, ["o"]).collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.65)}
    with_llm = A.rescore(p.withColumn("llm", F.lit(1.0)), ["o"]).filter("depth = 1").first()["final"]
    assert with_llm == pytest.approx(2.2 + 0.3 + 0.3 - 0.12 * math.log1p(1), abs=1e-3)


def test_affinity_and_inferred_edges(spark):
    df = spark.createDataFrame([("entity", "event"), ("event", "event"), ("lookup", "x"), ("bridge", "x"), ("static", "x"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(S.affinity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.85, 0.65, 0.75, 0.55, 0.7]
    key = "child string, `column` string, parent string, parent_column string, overlap double"
    declared = spark.createDataFrame([("a", "x", "b", "y", 1.0)], key).withColumn("source", F.lit("declared"))
    both = S.with_inferred(declared, spark.createDataFrame([("a", "x", "b", "y", 0.9), ("a", "z", "b", "y", 0.9)], key))
    assert sorted((r["column"], r["source"]) for r in both.collect()) == [("x", "declared"), ("z", "inferred")]


def test_roles_and_keys_from_the_caller(spark):
    c = open_catalog(spark, "/root/testdata/sf0.001")
    plain = S.declared_keys(c).count()

    def infer(catalog):
        row = "child string, `column` string, parent string, parent_column string, overlap double, uniqueness double, confidence string"
        return spark.createDataFrame([("part", "p_size", "nation", "n_nationkey", 0.5, 0.1, "low"), ("orders", "o_custkey", "customer", "c_custkey", 1.0, 1.0, "high")], row)

    keys = S.declared_keys(c, role_of=lambda name, t: "event" if t.time_col else "entity", infer=infer)
    assert keys.count() == plain + 1 and {r["child_role"] for r in keys.filter("child = 'orders'").collect()} == {"event"}
    new = keys.filter("source = 'inferred'").first()
    assert (new["child_role"], new["parent_role"], new["one_sided"]) == ("entity", "entity", False)


def test_roles_and_measures(spark):
    c = spark.createDataFrame([("t", "a", "measure", 0.0), ("t", "b", "measure", 0.5), ("t", "target_x", "measure", 0.0), ("t", "k", "primary_key", 0.0)], "`table` string, `column` string, role string, missing_ratio double")
    assert S.trusted_measures(c).first()["measures"] == ["a"]
    assert S.role_histogram(c).first()["roles"] == {"measure": 3, "primary_key": 1}


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    path = R.artifact_path(str(tmp_path), "train", "shop", "t", k=3)
    built = []
    for _ in range(2):
        R.build_once(spark, path, lambda: built.append(1) or df)
    assert len(built) == 1 and R.read_frame(spark, path).count() == 2
    assert R.artifact_path("r", "train", "d", "t", k=3) != R.artifact_path("r", "train", "d", "t", k=4)
    with pytest.raises(FileNotFoundError):
        R.read_frame(spark, f"{path}-no")
    assert R.empty_like(df).schema == df.schema and R.empty_like(df).count() == 0
    R.write_json(f"{tmp_path}/a.json", {"x": float("nan")})
    assert R.read_json(f"{tmp_path}/a.json") == {"x": None}
    for n in range(2):
        R.append_jsonl(f"{tmp_path}/l.jsonl", {"n": n})
    assert len(open(f"{tmp_path}/l.jsonl").readlines()) == 2
    with pytest.raises(FileNotFoundError, match="schema, stats, graph"):
        R.load_bundle(str(tmp_path))
    for n in R.REQUIRED_BUNDLE:
        R.write_json(f"{tmp_path}/{n}.json", {})
    assert set(R.load_bundle(str(tmp_path))) == set(R.REQUIRED_BUNDLE)


def test_vectors_and_stats_resume(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0], 2.0), (2, [0.0, 1.0], 1.0)], "query_id long, vector array<double>, norm double")
    meta = spark.sql("SELECT 1L AS query_id, timestamp_ntz'2020-01-01' AS time UNION ALL SELECT 2L, NULL")
    R.write_vectors(v, meta, str(tmp_path / "v"), ["a", "b"])
    rows, names = R.read_vectors(spark, str(tmp_path / "v"))
    assert names == ["a", "b"] and rows.count() == 1
    R.write_vectors(v, meta, str(tmp_path / "w"), ["a"])
    with pytest.raises(ValueError, match="vocabulary"):
        R.read_vectors(spark, str(tmp_path / "w"))
    seen = []

    def profile(df, name):
        seen.append(name)
        return df.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))

    for _ in range(2):
        assert R.stats_per_table(spark, str(tmp_path / "s"), {"a": v, "b": v}, profile, {"cutoff": "x"}).count() == 2
    assert seen == ["a", "b"]


def test_config(tmp_path):
    (tmp_path / "c.py").write_text("DATASET='shop'\nTASK='churn'\nHISTORY=5\n")
    assert R.load_config(str(tmp_path / "c.py"))["history"] == 5
    with pytest.raises(ValueError, match="sampling"):
        R.validate_config({"dataset": "d", "task": "t", "sampling": "x"})
    with pytest.raises(ValueError, match="dataset"):
        R.validate_config({"task": "t"})


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = V.read_events(spark, str(tmp_path / "in"), events.schema, 1)
    q = V.window_counts(stream, "ts", ["event_type"], "value", "1 day", late="60 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = sorted(map(tuple, V.window_counts(events, "ts", ["event_type"], "value", "1 day").collect()))
    assert sorted(map(tuple, spark.table("w").collect())) == batch
    e = V.append_edges(V.read_events(spark, str(tmp_path / "in"), events.schema), lambda b: b.select("event_id", "user_id", "ts"), str(tmp_path / "edges"), str(tmp_path / "cp"))
    e.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "edges")).count() == events.count()


def test_cli(capsys):
    from chronorel import cli

    cli.main(["--root", "/root/testdata/sf0.001", "tables"])
    assert "customer" in capsys.readouterr().out


def test_cli_splits_and_preprocess(capsys, tmp_path, spark):
    from chronorel import cli

    root = "/root/testdata/sf0.001"
    cli.main(["--root", root, "materialize"])
    assert "region 5 rows 2 columns" in capsys.readouterr().out
    when = ["--table", "orders", "--val", "1999-01-01", "--test", "2000-01-01"]
    cli.main(["--root", root, "splits", *when])
    said = capsys.readouterr().out
    assert sum(int(x.split()[1]) for x in said.splitlines()[:3]) == 1500 and "o_orderdate" in said
    cli.main(["--root", root, "preprocess", *when, "--out", str(tmp_path)])
    train = spark.read.parquet(str(tmp_path / "shop__orders__train"))
    assert train.count() == int(said.splitlines()[0].split()[1]) and train.filter("o_orderdate >= timestamp_ntz'1999-01-01'").count() == 0
    assert (tmp_path / "manifest.json").exists()


def test_annotation():
    from chronorel.plans import semantics as M

    tables = {"visits": ("event", {"visit_id": "primary_key", "user_id": "foreign_key", "when_time": "category", "kind": "category", "price": "measure", "ref_id": "category"})}
    one = lambda t, c: {"table_role": "entity|event", "columns": {"kind": "text", "price": "Measure!", "when_time": "text"}}
    two = lambda t, c: {"table_role": "event", "columns": {"kind": "text", "price": "nonsense", "visit_id": "text"}}
    bad = lambda t, c: 1 / 0
    got = M.annotate(tables, [one, two, bad, lambda t, c: "no mapping"])
    roles = {c["name"]: c["role"] for c in got["tables"][0]["columns"]}
    assert roles == {"visit_id": "primary_key", "user_id": "foreign_key", "when_time": "timestamp", "kind": "text", "price": "measure", "ref_id": "identifier"}
    assert got["failures"] == 2 and got["tables"][0]["table_role"] == "event" and got["validation"]["passed"]
    critic = lambda t, c, voted: {"columns": {"kind": "category", "price": 7}}
    assert {c["name"]: c["role"] for c in M.annotate(tables, [one, two], critic)["tables"][0]["columns"]}["kind"] == "category"
    wrong = [{"table_name": "t", "table_role": "x", "columns": [{"name": "a_id", "role": "text"}, {"name": "the_date", "role": "measure"}, {"name": "b", "role": "y"}]}]
    assert [i["type"] for i in M.validate_roles(wrong)["issues"]] == ["invalid_table_role", "id_name_mismatch", "timestamp_name_mismatch", "invalid_column_role"]
    assert M.repair_role(None, M.TABLE_ROLES, "static") == "static"


def test_priors_and_column_hints(spark):
    from chronorel.plans import paths as A

    rows = [(["c", "o"], 1, 1.0, True), (["c", "o", "l"], 2, 1.0, True), (["p", "l", "o", "c"], 5, 1.0, True)]
    paths = spark.createDataFrame(rows, "tables array<string>, depth int, relevance double, recommended boolean")
    priors = {"preferred_motifs": [["C", "O"]], "optional_motifs": [["l"]], "discouraged_tables": ["P"], "preferred_max_depth": 3}
    got = [(r["prior_bonus"], r["final"], r["recommended"]) for r in A.with_priors(paths, priors).orderBy("depth").collect()]
    assert got == [(3.8, 4.8, True), (5.3, 6.3, True), (-1.5, -0.5, False)]
    columns = spark.createDataFrame([("o", "price", 1.0), ("o", "day", 1.0)], "`table` string, `column` string, score double")
    assert {r["column"]: r["score"] for r in A.hinted_columns(columns, {("O", "price"): 2.0}).collect()} == {"price": 1.9, "day": 1.0}


def test_prompt_and_priors():
    prompt = K.prompt_object({"entity_table": "c"}, ROWS, {}, {}, {("o", "price"): 1.0})
    assert [p["path_id"] for p in prompt["candidate_paths"]] == [r.path_id for r in sorted(ROWS, key=lambda r: (-r.final, r.path_id))]
    assert K.task_priors(prompt, neighbours=["o"])["preferred_motifs"] == [["c", "o"]]
    assert K.task_priors(prompt, lambda p: {"preferred_max_depth": 2, "other": 1}) == {"anchor_table": "c", "preferred_motifs": [], "optional_motifs": [], "discouraged_tables": [], "preferred_max_depth": 2, "rationale": "model"}
    assert K.task_priors(prompt, lambda p: "no")["rationale"] == "fallback"
    assert K.artifact_header("shop", "2000-01-01")["global_cutoff_time"] == "2000-01-01"
