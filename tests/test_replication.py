"""Gates, replays, variants, masked pooling and joint resamples against plain recomputations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import contracts, evaluate, experiments, replication
from plumbline.sources import io


def test_bands_and_corpora(spark):
    ranks = spark.createDataFrame([(k,) for k in (1, 50, 51, 2450, 2451)], "r int")
    assert [x.b for x in ranks.select(replication.rank_band(F.col("r")).alias("b")).collect()] == ["top", "top", "middle", "middle", "bottom"]
    classes = {"a": "base|first", "b": "target"}
    named = lambda t: spark.createDataFrame([(t,)], "t string").select(replication.corpus_class(F.col("t"), classes).alias("c")).first().c
    assert [named(t) for t in ("The BASE", "first target", "Target 2")] == ["a", "a", "b"]
    for bad in ("other", None):
        with pytest.raises(Exception, match="no corpus"):
            named(bad)


def test_frozen_and_pca():
    replication.frozen({"runs": 5, "extra": 1}, {"runs": 5})
    with pytest.raises(contracts.ContractError, match="runs is 4.*model is None"):
        replication.frozen({"runs": 4}, {"runs": 5, "model": "m"})
    pca = {"components": np.zeros((2, 3)), "ratio": np.array([0.6, 0.3, 0.1]), "k": np.array(2)}
    assert replication.pca_contract(pca, 3, 2, 0.9, 1e-9) == pytest.approx(0.9)
    for wrong in ((3, 3, 0.9), (4, 2, 0.9), (3, 2, 0.91), (3, 2, float("nan"))):
        with pytest.raises(contracts.ContractError):
            replication.pca_contract(pca, *wrong, 1e-9)


def test_provenance(spark):
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, h string")
    listed = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (5, "e")], "k int, h string")
    assert {tuple(r) for r in replication.provenance(found, listed, "k", "h").collect()} == {(2, "changed"), (4, "unlisted"), (5, "missing")}
    assert replication.provenance(found.limit(0), listed.limit(0), "k", "h").isEmpty()


def test_selection_replay(spark):
    a = spark.createDataFrame([("t", 1, 1), ("t", 2, 2), ("b", 3, 1), ("r", 4, 1)], "g string, k int, o int")
    b = spark.createDataFrame([("t", 1, 2), ("t", 2, 1), ("b", 5, 1), ("r", 4, 1)], "g string, k int, o int")
    got = {r.g: tuple(r)[1:] for r in replication.selection_replay(a, b, "g", "k", "o").collect()}
    assert got == {"t": (2, 0, 0, True, False), "b": (0, 1, 1, False, False), "r": (1, 0, 0, True, True)}


def test_attached(spark):
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    texts = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    assert {(r.k, r.t, r.text_missing) for r in replication.attached(chosen, texts, "k", "t").collect()} == {(1, "x", False), (2, None, True), (3, None, True)}


def test_variants(spark):
    rows = [(7, "HEAD: \n old body  \nPLAN: x", 5, 20, "new"), (3, "a b c", 0, 5, ""), (5, "ab", 2, 2, "z")]
    hosts = spark.createDataFrame(rows, "k long, t string, s int, e int, f string")
    got = {r.k: r for r in replication.variants(hosts, "t", "s", "e", "f", "k").collect()}
    for order, (k, t, s, e, f) in enumerate(sorted(rows), 1):
        body = t[s:e]
        lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
        want = t[:s] + lead + f + tail + t[e:]
        r = got[k]
        assert r.variant_text == want and r.variant_order == order and r.variant_id == f"variant_{order:03d}"
        assert (r.original_body_length, r.inserted_filler_length, r.note_character_change) == (len(body), len(f), len(want) - len(t))
        assert r.replacement_body_length == len(lead + f + tail) and r.seed_sequence_json == f"[42,{k}]"


def test_masks(spark):
    row = spark.createDataFrame([(["a", "bb"],)], "w array<string>")
    r = row.select(text.attention_mask(F.col("w"), 6).alias("a"), text.pooling_mask(F.col("w"), 6).alias("p")).first()
    assert (r.a, r.p) == ([1, 1, 1, 1, 0, 0], [0, 1, 1, 0, 0, 0])
    v = spark.createDataFrame([([[9.0, 9.0], [1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [0, 1, 1, 0])], "v array<array<double>>, m array<int>")
    assert v.select(text.masked_mean(F.col("v"), F.col("m"), 2).alias("x")).first().x == [2.0, 4.0]
    with pytest.raises(Exception, match="no token to pool"):
        v.select(text.masked_mean(F.col("v"), F.transform("m", lambda _: F.lit(0)), 2)).collect()


def _cohort(seed):
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 12)), c, float(rng.integers(0, 6)), int(rng.integers(0, 2))) for _ in range(120) for c in ("a", "b")]


def _resample(rows, rng):
    clusters = sorted({r[0] for r in rows})
    drawn = [clusters[i] for i in rng.integers(0, len(clusters), len(clusters))]
    rows, aucs = [r for c in drawn for r in rows if r[0] == c], []
    for code in ("a", "b"):
        pos, neg = ([r[2] for r in rows if r[1] == code and r[3] == y] for y in (1, 0))
        if not pos or not neg:
            return None
        aucs.append(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
    return float(np.mean(aucs))


def test_paired_bootstrap(spark):
    a, b = _cohort(1), _cohort(2)
    frames = [spark.createDataFrame(x, "u long, c string, s double, y int") for x in (a, b)]
    got = evaluate.paired_bootstrap(*frames, "u", "c", "s", "y", 8, seed=5, batch=8).orderBy("replicate").collect()
    want, r = [], 0
    while len(want) < 8:
        rng = np.random.default_rng([5, r])
        pair = _resample(a, rng), _resample(b, rng)
        want += [] if None in pair else [pair]
        r += 1
    for row, (x, y) in zip(got, want, strict=True):
        assert (row.source_auc, row.target_auc, row.delta) == pytest.approx((x, y, y - x))


def test_bootstrap_without_a_class(spark):
    one = spark.createDataFrame([(1, "a", 0.5, 1), (2, "a", 0.7, 1)], "u long, c string, s double, y int")
    with pytest.raises(ValueError, match="too few"):
        evaluate.cluster_bootstrap(one, "u", "c", "s", "y", 2, batch=2, most_factor=2)


def test_coefficients(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    rows = [([float(v) for v in r], "p" if r[0] > 0 else "q") for r in x]
    models = evaluate.one_vs_rest(spark.createDataFrame(rows, "v array<double>, c string"), "v", "c", ["p", "q"])
    p, q = evaluate.coefficient_table(spark, models).orderBy("label_index").collect()
    assert (p.code, q.code) == ("p", "q") and p.asDict().keys() == {"label_index", "code", "intercept", "pc_01", "pc_02"}
    assert (q.pc_01, q.pc_02, q.intercept) == pytest.approx((-p.pc_01, -p.pc_02, -p.intercept), abs=1e-4)
    scores = x @ [p.pc_01, p.pc_02] + p.intercept
    assert np.mean((scores > 0) == (x[:, 0] > 0)) > 0.9


def test_greedy_hosts(spark):
    rng = np.random.default_rng(3)
    rows = [(c, k, int(rng.integers(0, 9)), float(rng.integers(0, 20)), bool(rng.integers(0, 3))) for c in "xy" for k in range(60)]
    df = spark.createDataFrame(rows, "c string, k long, u long, s double, ok boolean")
    got = {(r.c, r.arm, r.selection_order): (r.k, r.u, r.passed_over) for r in experiments.greedy_hosts(df, "c", "u", "s", "k", "ok", 4).collect()}
    draw = {r.k: r.d for r in df.select("k", F.md5(F.concat(F.lit("42:"), F.col("k").cast("string"))).alias("d")).distinct().collect()}
    want = {}
    for c in "xy":
        mine, used = [r for r in rows if r[0] == c], set()
        for arm, order in (("top", sorted(mine, key=lambda r: (-r[3], r[1]))), ("random", sorted(mine, key=lambda r: (draw[r[1]], r[1])))):
            n = skipped = 0
            for _, k, u, _, ok in order:
                if n == 4:
                    break
                if not ok or u in used:
                    skipped += 1
                    continue
                used.add(u)
                n += 1
                want[c, arm, n] = (k, u, skipped)
    assert got == want


def test_resume_by_identity(spark, tmp_path):
    todo = spark.range(6).toDF("k")
    run = {"model": "m", "stride": 256}
    work = lambda df: df.withColumn("v", F.col("k") * 2)
    io.append_remaining(todo.limit(3), f"{tmp_path}/done", "k", work, run)
    assert io.append_remaining(todo, f"{tmp_path}/done", "k", work, run).count() == 6
    with pytest.raises(ValueError, match="another run"):
        io.append_remaining(todo, f"{tmp_path}/done", "k", work, run | {"stride": 128})


def test_replacement_order(spark):
    from hashlib import md5

    rng = np.random.default_rng(4)
    donors = [(int(s), f"d{s}{k}", i, "x" * int(rng.integers(1, 9)) + f"{s}{k}{i}") for s in range(3) for k in range(4) for i in range(int(rng.integers(1, 4)))]
    hosts = [(h, h % 4, need) for h, need in ((1, 20), (2, 45), (3, 10_000), (4, 0))]
    got = {r.host: r for r in experiments.replacement_bodies(spark.createDataFrame(hosts, "host long, subject long, target int"), spark.createDataFrame(donors, "subject long, donor string, chunk_order int, chunk string"), "host", "target", most_chunks=6).collect()}
    for h, subject, need in hosts:
        names = sorted({d for s, d, _, _ in donors if s != subject}, key=lambda d: (md5(f"42:{h}:{d}".encode()).hexdigest(), d))
        taken, used = [], []
        for name in names:
            for _, d, _, chunk in sorted(x for x in donors if x[1] == name):
                if len("\n".join(taken)) < need and len(taken) < 6:
                    taken.append(chunk)
                    used.append(d)
        body = "\n".join(taken)
        assert (got[h].body, got[h].n_chunks, got[h].length, got[h].complete, got[h].donors) == (body, len(taken), len(body), len(body) >= need, ",".join(dict.fromkeys(used)))


def test_substitution_shuffles_each_row_a_few_times(spark, monkeypatch):
    from test_operators import _shuffled_mb

    from plumbline.operators import vectors

    monkeypatch.setattr(vectors, "BLOCK_ROWS", 400)
    rows = spark.range(0, 8000, 1, 4).select("id", F.array(*[F.rand(k) for k in range(16)]).alias("v")).localCheckpoint()
    x, y = rows.where("id % 2 = 0"), rows.where("id % 2 = 1")
    moved = x.withColumn("v", F.transform("v", lambda e: e + 0.5))
    got, most = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on larger tables
    try:
        mb = _shuffled_mb(spark, lambda: got.update(replication.substitution(x, moved, y, "id", "v", 1.0)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert mb < 6 * 8000 * 16 * 8 / 1e6
    a, b = (vectors.mmd2(s, y, "id", "v", 1.0) for s in (x, moved))
    assert (got["original"], got["preferred"]) == pytest.approx((a, b), abs=1e-12)
