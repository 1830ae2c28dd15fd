import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import gates as G
from quillon.operators import inference as I
from quillon.operators import items as M
from quillon.operators import retrieval as R
from quillon.operators import sampling as S


def test_ranks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 7)  # several blocks
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (40, 4)).astype(float)  # many ties
    v[5] = v[6]
    pool = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    q = pool.select("id", F.col("id").alias("gt"), F.reverse("vec").alias("vec"))
    got = {r.query_id: r for r in R.rank_against_pool(q, pool).collect()}
    for i in range(40):
        s = v @ v[i][::-1]
        assert got[i].n_greater == (s > s[i]).sum() and got[i].n_equal == (s == s[i]).sum() - 1 and got[i].n_before == (s[:i] == s[i]).sum()
    top = R.top_members(q, pool, 3).orderBy("query_id", "rank").collect()
    assert len(top) == 120
    for i in range(40):
        s = v @ v[i][::-1]
        order = sorted((j for j in range(40) if j != i), key=lambda j: (-s[j], j))[:3]
        assert [r.member_id for r in top if r.query_id == i] == order


def test_ranks_of_missing_truth_and_empty_pool(spark):
    pool = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(1, 9, [1.0, 0.0])], "id long, gt long, vec array<double>")
    assert R.rank_against_pool(q, pool).count() == 0
    assert R.rank_against_pool(q, pool.limit(0)).count() == 0


def test_wilcoxon_and_mann_whitney(spark):
    d = spark.createDataFrame([("g", x) for x in [1.0, -2.0, 3.0, 3.0, 0.0, None, -1.0]], "g string, d double")
    r = I.wilcoxon(d, ["g"], "d").first()
    assert (r.n, r.w_plus, r.w_minus) == (5, 1.5 + 4.5 + 4.5, 1.5 + 3)
    v = spark.createDataFrame([("g", 1.0, True), ("g", 2.0, True), ("g", 2.0, False), ("g", 5.0, False)], "g string, v double, first boolean")
    assert I.mann_whitney(v, ["g"], "v", "first").first().u == 0.5


@pytest.mark.parametrize("b,c", [(0, 0), (1, 0), (3, 9), (20, 5), (4, 4)])
def test_mcnemar(spark, b, c):
    p = spark.range(1).select(I.mcnemar_exact(F.lit(b).cast("long"), F.lit(c).cast("long")).alias("p")).first().p
    n = b + c
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n)
    assert abs(p - want) < 1e-12


def test_bootstrap_of_one_cluster_and_holm(spark):
    one = spark.createDataFrame([("g", "s", 3.0, 4)], "g string, c string, s double, n long")
    rep = I.bootstrap(one, ["g"], "c", ["s", "n"], 10).collect()
    assert len(rep) == 10 and all(r.s == 3.0 and r.n == 4 for r in rep)
    p = spark.createDataFrame([("f", k, x) for k, x in zip("abc", (0.01, 0.04, 0.03))], "f string, k string, p double")
    h = {r.k: r.p_holm for r in I.holm(p, ["f"], "p", ["k"]).collect()}
    assert h == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})
    loose = {r.k: r.p_holm for r in I.holm(p, ["f"], "p", ["k"], monotone=False).collect()}
    assert loose == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.04})
    assert spark.range(1).select(I.normal_p(F.lit(1.959964)).alias("p")).first().p == pytest.approx(0.05, abs=1e-6)


def test_gates(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 9.0), (2, None)], "k int, v double")
    report = G.report(
        [G.expect_rows(df, "rows", 3), G.expect_unique(df, "unique", ["k"]), G.expect_range(df, "range", "v", 0, 1, hard=False), G.expect_lossless_join(df.dropDuplicates(["k"]), df.limit(0), "join", ["k"], ["v"]), G.expect_same_set(df, df, "set")]
    )
    got = {r.gate: (r.ok, r.observed) for r in report.collect()}
    assert got == {"rows": (True, "3"), "unique": (False, "1"), "range": (False, "1"), "join": (False, "2"), "set": (True, "0")}
    with pytest.raises(AssertionError, match="join, unique"):
        G.enforce(report)
    assert G.environment(spark).count() == 4


def test_samples_and_splits(spark):
    df = spark.createDataFrame([("a" if i < 50 else "b" if i < 52 else None, i) for i in range(60)], "g string, k long")
    s = S.sample_per_group(df, ["g"], "k", 3).collect()
    assert {g: sum(r.g == g for r in s) for g in ("a", "b", None)} == {"a": 3, "b": 2, None: 3}
    n = {(r.g, r.new_split): r["count"] for r in S.stratified_split(df, ["g"], "k").groupBy("g", "new_split").count().collect()}
    assert n[("a", "test")] == 5 and n[("a", "val")] == 5 and n[("b", "train")] == 2 and n[(None, "test")] == 1


def test_items(spark):
    i = spark.createDataFrame([("k|swap", "k", "x"), ("k|random", "k", "y"), ("j|swap", "j", None)], "item string, twin string, a string")
    bad = spark.createDataFrame([("k|random",)], "item string")
    assert [r.item for r in M.excise(i, bad, "item", "twin").collect()] == ["j|swap"]
    moved = M.override(i.select("item", F.lit("old").alias("label")), spark.createDataFrame([("j|swap", "new")], "item string, new_label string"), "item", "label")
    assert {(r.item, r.label, r.provenance) for r in moved.collect()} == {("k|swap", "old", "rule"), ("k|random", "old", "rule"), ("j|swap", "new", "certified")}
    pool = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "id string, idx long")
    got = {r.id: r.donor for r in M.next_not_self(pool.select("id"), pool, "id").collect()}
    assert set(got) == {"a", "b", "c"} and all(k != v for k, v in got.items())
