"""Hand-built cases for the semantics that are easy to get wrong."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import calibration, text
from plumbline.operators import attribution, cohort, contracts, detectors, evaluate, experiments, labels, ranking, vectors
from plumbline.sources import io
from plumbline.streaming import windows


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw,encoder,surface", [("[**a**] b", "unknown b", "PHI b"), ("[**a\nb**]", "[**a\nb**]", "[**a\nb**]"), ("___", "unknown", "PHI"), ("____", "unknown_", "PHI"), ("______", "unknownunknown", "PHI"), ("__", "__", "__")])
def test_placeholders(spark, raw, encoder, surface):
    assert one(spark, raw, text.encoder_form) == encoder and one(spark, raw, text.surface_form) == surface


def test_sections(spark):
    keys = lambda t, **k: set(one(spark, t, lambda c: text.section_keys(c, **k)))
    assert keys("Planned visit") == {"plan"}
    assert keys("Assessment : x\nassessment: y") == {"assessment ", "assessment"}
    assert keys("assessment and plan:") == {"assessment"}
    assert keys("x\n\n  HPI:") == {"hpi"} and keys("a\rHPI:") == set()


@pytest.mark.parametrize("value,tokens", [("", []), ("  \n ", []), (" a  b\n", ["a", "b"]), ("a b", ["a", "b"]), ("x² é", ["x²", "é"])])
def test_tokens(spark, value, tokens):
    assert one(spark, value, text.whitespace_tokens) == tokens


@pytest.mark.parametrize("raw,code", [(" 038.9 ", "0389"), ("0389", "0389"), ("nan", None), ("", None), (None, None), ("None", None), (" v1.2", "V12")])
def test_codes(spark, raw, code):
    assert one(spark, raw, text.normalised_code) == code


@pytest.mark.parametrize("n,count", [(0, 0), (1, 1), (510, 1), (511, 2), (766, 2), (767, 3), (1200, 4)])
def test_token_windows(spark, n, count):
    w = spark.createDataFrame([([str(k) for k in range(n)],)], "t array<string>").select(text.token_windows(F.col("t")).alias("w")).first().w
    assert len(w) == count and (not n or w[-1][-1] == str(n - 1))


NOTES = [(1, "2001-01-01", 10, None, "a"), (1, "2001-01-01", 11, "", "b"), (1, "2002-01-01", 12, "1", "c"), (2, None, 13, None, "d"), (2, "1999-01-01", 14, None, "e"), (3, "2000-01-01", 15, None, None), (3, "1999-01-01", 16, None, "f")]


def test_latest(spark):
    df = spark.createDataFrame(NOTES, "k int, day string, row int, bad string, text string")
    order = [F.col("day").desc(), F.col("row").desc()]
    ok = F.col("bad").isNull() | (F.col("bad") != "1")
    pick = lambda **k: {r.k: r.row for r in cohort.latest_per_key(df, ["k"], order, eligible=ok, **k).collect()}
    assert pick() == {1: 11, 2: 14, 3: 15}
    assert pick(required="text") == {1: 11, 2: 14, 3: 16}
    assert pick(required="text", null_policy="after") == {1: 11, 2: 14}
    assert {r.row for r in cohort.group_max_keep_ties(df.where("k = 1 and bad is null or bad = ''"), ["k"], "day").collect()} == {10, 11}


def test_one_to_one(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    assert cohort.one_to_one(a, b.limit(1), ["k"]).count() == 1
    with pytest.raises(Exception, match="repeat"):
        cohort.one_to_one(a, b, ["k"]).collect()


def test_auroc(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.1), ("b", 1, 0.5), ("b", 0, 0.5), ("c", 1, 0.3)]
    got = {r.g: r.auroc for r in evaluate.auroc(spark.createDataFrame(rows, "g string, y int, s double"), ["g"], "s", "y").collect()}
    assert got == {"a": 0.75, "b": 0.5, "c": None}
    flipped = evaluate.auroc(spark.createDataFrame([(g, y, -s) for g, y, s in rows], "g string, y int, s double"), ["g"], "s", "y")
    assert {r.g: r.auroc for r in flipped.collect()}["a"] == 0.25


def test_votes(spark):
    order = ("Structural", "Clinical", "Administrative")
    def votes(k, names, fixed):
        return [(k, i + 1, n, "High" if i == 2 else "Low") for i, n in enumerate(names)] + ([(k, 0, fixed, "High")] if fixed else [])

    rows = votes("u", ["Clinical"] * 5, "Clinical") + votes("v", ["Clinical", "Clinical", "Structural", "Structural", "Administrative"], None) + votes("w", ["Clinical"] * 4 + [None], "Structural") + votes("x", ["Clinical"] * 3 + ["Structural"] * 2, "Structural")
    got = {r.k: r for r in attribution.resolved(spark.createDataFrame(rows, "k string, run_no int, category string, confidence string"), "k", order).collect()}
    assert (got["u"].category, got["u"].stable, got["u"].consistency_rate, got["u"].confidence) == ("Clinical", True, 1.0, "High")
    assert (got["v"].category, got["v"].stable, got["v"].resolution) == ("Structural", None, "stochastic_tie_break")
    assert got["w"].category is None and got["w"].n_valid_runs == 4
    assert got["x"].stable is False and got["x"].resolution == "unique_modal"


def test_calls_keep_failures(spark):
    def client():
        def ask(prompt, run, temperature):
            if run == 2:
                raise TimeoutError("late")
            return f"{prompt}:{run}"
        return ask

    got = attribution.called(spark.createDataFrame([("r", "p")], "k string, prompt string"), "k", "prompt", client).collect()
    assert len(got) == 6 and [r.error for r in got if r.run_no == 2] == ["TimeoutError: late"]


def test_alarms(spark):
    rows = [("hit", 0, False), ("hit", 100, True), ("hit", 200, False), ("late", 0, True), ("late", 100, False), ("late", 200, True), ("none", 0, False), ("none", 100, False)]
    got = {r.run: r for r in detectors.alarm_summary(spark.createDataFrame(rows, "run string, start int, alarm boolean"), ["run"], "start", 100, 100).collect()}
    assert got["hit"].boundary_hit and got["hit"].delay == 0
    assert (got["late"].boundary_hit, got["late"].pre_alarms, got["late"].first_post_start, got["late"].delay) == (False, 1, 200, 1)
    assert got["none"].first_post_start is None and got["none"].total_alarms == 0


def test_calibration():
    d, p = calibration.alarm_threshold()
    assert d == 13 and abs(float(p) - 0.0384188161) < 5e-11
    assert abs(float(calibration.tail_at_half(100, 12)) - 0.0518195192) < 5e-11
    assert calibration.rises_to_half(12, 3) and isinstance(p, Fraction)
    assert math.isclose(sum(calibration.binomial_pmf(30, 0.3)), 1)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    rows = [(k, [float(v) for v in rng.normal(0.0 if k < 60 else 0.8, 1, 5)], "x" if k < 60 else "y") for k in range(120)]
    return rows, spark.createDataFrame(rows, "id long, v array<float>, g string")


def test_kernels(spark, points):
    rows, df = points
    x, y = (np.array([np.float32(v) for _, v, g in rows if g == s], float) for s in "xy")
    sigma = vectors.median_sigma(np.concatenate([x, y]))

    def kernel(a, b):
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / (2 * sigma**2))

    expected = (kernel(x, x).sum() - 60) / (60 * 59) + (kernel(y, y).sum() - 60) / (60 * 59) - 2 * kernel(x, y).mean()
    got = vectors.mmd2(df.where("g = 'x'"), df.where("g = 'y'"), "id", "v", sigma)
    test = vectors.permutation_test(x, y, sigma, spark, replicates=50)
    assert math.isclose(got, expected, abs_tol=1e-9) and math.isclose(test["mmd2"], expected, abs_tol=1e-9)
    assert test["drift"] and test["p_value"] == 0
    assert not vectors.permutation_test(x[::2], x[1::2], sigma, spark, replicates=50)["drift"]
    with pytest.raises(ValueError):
        vectors.mmd2(df.where("id = 0"), df.where("g = 'y'"), "id", "v", sigma)


def test_pca_and_frechet(spark, points):
    rows, df = points
    x = np.array([np.float32(v) for _, v, g in rows if g == "x"], float)
    pca = vectors.fitted_pca(df.where("g = 'x'"), "v", target=1.0)
    assert math.isclose(pca["ratio"].sum(), 1) and int(pca["k"]) == 5
    assert np.allclose(vectors.moments(df.where("g = 'x'"), "v")[2], np.cov(x.T))
    assert abs(vectors.frechet(df.where("g = 'x'"), df.where("g = 'x'"), "v")["distance"]) < 1e-6
    z = np.array([r.projected for r in vectors.projected(df.where("g = 'x'").orderBy("id"), "v", pca).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(z, axis=1), np.linalg.norm(x - x.mean(0), axis=1))


@pytest.mark.parametrize("parts", [1, 7])
def test_positions(spark, parts):
    df = spark.range(100, numPartitions=parts).select((F.col("id") * 37 % 100).alias("v"))
    assert {r.v: r.pos for r in ranking.with_positions(df, [F.col("v").desc()]).collect()} == {v: 99 - v for v in range(100)}
    assert ranking.with_positions(df.limit(0), [F.col("v")]).count() == 0


def test_top_codes_needs_enough(spark):
    codes = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "id int, code string")
    assert [tuple(r) for r in labels.top_codes(codes, "id", 2).collect()] == [(1, "a", 2), (2, "b", 1)]
    with pytest.raises(Exception, match="fewer than"):
        labels.top_codes(codes, "id", 3).collect()


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [float("nan")])], "k int, g string, v array<double>")
    assert contracts.violations(df, contracts.Contract(columns=["k"], rows=2, unique=["k"], permutation="k", cells=(["g"], 1))) == []
    assert len(contracts.violations(df, contracts.Contract(rows=3, finite=["v"], values={"g": ["a"]}))) == 3
    with pytest.raises(contracts.ContractError):
        contracts.enforced(df, contracts.Contract(columns=["nope"]))
    nan = df.select("k", F.lit(float("nan")).alias("x"))
    assert contracts.same_within(nan, df.select("k", F.lit(None).cast("double").alias("x")), ["k"], ["x"]).count() == 0


def test_sections_and_chunks():
    body = "x" * 600
    note = f"HPI: a\nHospital Course: {body}\nPlan: b\nBrief Hospital Course: {body}y\nHistory of Present Illness:" + "z" * 900
    kind, header, start, end = experiments.section_of(note, 500)
    assert (kind, header) == ("primary", "Brief Hospital Course") and note[start:end].strip() == body + "y"
    assert experiments.section_of("none", 5) is None and experiments.section_of(None, 5) is None
    chunks = experiments.report_chunks("FINDINGS: Lungs are clear today. Heart size is normal now. No.\nIMPRESSION: fine")
    assert [c for *_, c in chunks] == ["Lungs are clear today.", "Heart size is normal now."]
    assert experiments.report_chunks("nothing") is None


def test_donors_are_of_other_subjects(spark):
    hosts = spark.createDataFrame([(1, 10, 30)], "host long, subject long, target int")
    donors = spark.createDataFrame([(10, "own", 0, "o" * 50), (11, "d1", 0, "a" * 20), (11, "d1", 1, "b" * 20), (12, "d2", 0, "c" * 5)], "subject long, donor string, chunk_order int, chunk string")
    r = experiments.replacement_bodies(hosts, donors, "host", "target").first()
    assert r.complete and "o" not in r.body and r.length == len(r.body)


def test_sources(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "ids.csv").write_text("hadm_id\n12\n 7 \n\nnan\n")
    assert sorted(r.id for r in io.read_ids(spark, f"{path}/ids.csv").collect()) == [7, 12]
    (tmp_path / "bad.csv").write_text("1.5\n")
    with pytest.raises(Exception, match="not an integer"):
        io.read_ids(spark, f"{path}/bad.csv").collect()
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "k int, t string")
    io.write_csv(df, f"{path}/csv")
    assert sorted(map(tuple, io.read_csv(spark, f"{path}/csv", "k int, t string").collect())) == [(1, 'a "b"\nc'), (2, None)]
    np.save(f"{path}/m.npy", np.arange(6).reshape(2, 3))
    assert [r.vector for r in io.read_npy(spark, f"{path}/m.npy").orderBy("pos").collect()] == [[0, 1, 2], [3, 4, 5]]
    io.save_model(spark, {"w": np.eye(2)}, f"{path}/model")
    assert (io.load_model(spark, f"{path}/model")["w"] == np.eye(2)).all()
    todo, seen = spark.range(10).toDF("k"), []
    work = lambda rows: seen.append(rows.count()) or rows
    io.append_remaining(todo.limit(4), f"{path}/done", "k", work)
    assert io.append_remaining(todo, f"{path}/done", "k", work).count() == 10 and seen == [4, 6]
    for seq, v in ((1, "a"), (2, "b")):
        io.append_jsonl(spark.createDataFrame([(1, seq, v)], "seed int, seq int, v string"), f"{path}/log")
    assert [r.v for r in io.read_latest_jsonl(spark, f"{path}/log", "seed int, seq int, v string", "seed", "seq").collect()] == ["b"]
    with pytest.raises(Exception, match="repeated key"):
        io.concat_shards([df, df], "k").collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:00:00", float(k)) for k in range(48)]
    df = spark.createDataFrame(rows, "id int, t string, value double").select("id", F.col("t").cast("timestamp").alias("ts"), "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed_drift(stream, "ts", [], "value", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("drift").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("drift").collect())) == sorted(map(tuple, windows.windowed_drift(df, "ts", [], "value").collect()))
    windows.resumable_sink(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 48


def test_kernel_blocks(spark, monkeypatch):
    """Samples of many blocks give the sums of one, and more rows than any driver-side bound are no error."""
    import numpy as np

    from plumbline.operators import vectors

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    got = {r.id: (r.a, r.b) for r in vectors.kernel_means(df, "id", "v", {"a": df, "b": df.where("id < 20")}, 1.3).collect()}
    full = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 1.3**2))
    assert all(np.allclose(got[k], (full[k].sum(), full[k, :20].sum())) for k in range(60))
    monkeypatch.undo()
    many = spark.range(25_000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    assert vectors.kernel_means(many, "id", "v", {"a": many.where("id < 21000")}, 1.0).count() == 25_000


def _shuffled_mb(spark, run):
    """MB that a run writes to shuffles, by the status of its stages."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    run()
    return (written() - before) / 1e6


def test_kernel_grid_shuffle_follows_rows(spark, monkeypatch):
    """Each row is shuffled a fixed number of times, however many blocks there are and bandwidths are asked for."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 100)
    monkeypatch.setattr(vectors, "CHUNK_ROWS", 300, raising=False)
    rows = spark.range(0, 4000, 1, 4).select("id", F.array(*[F.rand(k) for k in range(16)]).alias("v")).localCheckpoint()
    x, y = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    grid = []
    mb = _shuffled_mb(spark, lambda: grid.extend(vectors.mmd2_grid([x], y, "id", "v", [0.5, 1.0, 2.0])[0]))
    assert mb < 4 * 4000 * 16 * 8 / 1e6
    a, b = (np.array([r.v for r in s.collect()]) for s in (x, y))
    for sigma, got in zip((0.5, 1.0, 2.0), grid, strict=True):
        xx, yy, xy = (np.exp(-((p[:, None] - q[None]) ** 2).sum(-1) / (2 * sigma**2)) for p, q in ((a, a), (b, b), (a, b)))
        assert math.isclose(got, (xx.sum() - 2000) / (2000 * 1999) + (yy.sum() - 2000) / (2000 * 1999) - 2 * xy.mean(), abs_tol=1e-9)


def test_row_sums_shuffle_and_python_follow_rows(spark, monkeypatch):
    """The rows are shuffled once with their sums and the sample once; a key given twice keeps a sum for each row."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 400)
    rows = spark.range(0, 8000, 1, 4).select("id", F.array(*[F.rand(k) for k in range(16)]).alias("v")).localCheckpoint()
    got = []
    assert _shuffled_mb(spark, lambda: got.extend(vectors.kernel_means(rows, "id", "v", {"a": rows}, 1.0).collect())) < 4 * 8000 * 16 * 8 / 1e6
    x = np.array([r.v for r in rows.where("id < 50").collect()])
    y = np.array([r.v for r in rows.collect()])
    want = np.exp(-((x[:, None] - y[None]) ** 2).sum(-1) / 2).sum(1)
    assert np.allclose([r.a for r in sorted(got) if r.id < 50], want) and len(got) == 8000
    one = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert vectors.kernel_means(one, "id", "v", {"a": one}, 1.0).count() == 3


def test_witness_and_mean_of_odd_tables(spark, tmp_path):
    """A vec_id given twice has one witness, the mean over its pairs; a side without rows gives null, as SQL does."""
    import duckdb

    from plumbline.plans.registry import ORACLE_SQL, QUERIES

    rows = [(1, [0.0, 1.0], 0), (1, [1.0, 5.0], 1), (2, [0.0, 0.0], 7), (3, [2.0, 9.0], 8)]
    for name, kept in (("both", rows), ("base", rows[:2]), ("target", rows[2:])):
        spark.createDataFrame(kept, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/{name}/embeddings.parquet/*.parquet'")
        for query in ("witness_scores", "rbf_mean"):
            got = sorted(map(tuple, QUERIES[query](spark, f"{tmp_path}/{name}").collect()))
            assert got == sorted(con.sql(ORACLE_SQL[query]).fetchall()), (name, query)


def test_kernel_rows_reach_python_alone(spark):
    """What a worker's batch holds is rows of the one side, not pairs of blocks: its memory doesn't follow the samples' size."""
    rows = spark.range(50).select("id", F.array(F.rand(1), F.rand(2)).alias("v"))
    plan = vectors.kernel_means(rows, "id", "v", {"a": rows}, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_label_tasks_are_bounded(spark, monkeypatch, broadcast):
    """However many orders there are, no task joins and counts many more rows than TASK_ROWS, and the counts stay."""
    import duckdb

    from plumbline.plans import labels as plans
    from plumbline.plans.registry import ORACLE_SQL, QUERIES

    data = "/root/testdata/sf0.001"
    monkeypatch.setattr(labels, "TASK_ROWS", 500, raising=False)
    monkeypatch.setattr(labels, "BROADCAST_ROWS", broadcast, raising=False)
    codes = plans._parts(spark, data)[1]
    assert codes.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 750
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name in ("code_dedup", "all_zero_count", "support_table"):
        assert sorted(map(tuple, QUERIES[name](spark, data).collect())) == sorted(con.sql(ORACLE_SQL[name]).fetchall())


def test_projected_drift_shuffles_each_row_a_few_times(spark, monkeypatch):
    """The statistic on projected rows moves them a fixed number of times, though they are doubles from a Python function."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 400)
    rows = spark.range(0, 8000, 1, 4).select("id", F.array(*[F.rand(k) for k in range(16)]).alias("v")).localCheckpoint()
    pca = vectors.fitted_pca(rows.where("id % 2 = 0"), "v", target=1.0)
    x, y = (vectors.projected(rows.where(f"id % 2 = {k}"), "v", pca) for k in (0, 1))
    got, most = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on larger tables
    try:
        mb = _shuffled_mb(spark, lambda: got.append(vectors.mmd2(x, y, "id", "projected", 1.0)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert mb < 4 * 8000 * 16 * 8 / 1e6
    # all components are kept: distances, and so the statistic, are those of the rows
    assert math.isclose(got[0], vectors.mmd2(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id", "v", 1.0), abs_tol=1e-9)


def test_all_zero_tasks_are_bounded(spark, monkeypatch):
    """The anti join keeps the members as they were dealt: no task has many more of them than its share."""
    from plumbline.plans import labels as plans

    monkeypatch.setattr(labels, "TASK_ROWS", 500, raising=False)
    zero = labels.all_zero(*plans._parts(spark, "/root/testdata/sf0.001"), "o_orderkey")
    assert zero.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 80


def test_support_table_deals_its_rows(spark):
    """The support table's codes come from dealt tasks, which adaptive plans leave as they are."""
    from plumbline.plans.registry import QUERIES

    assert "RepartitionByExpression" in QUERIES["support_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
