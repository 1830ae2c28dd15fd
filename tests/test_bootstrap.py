"""The bootstraps' draws, and that they never become rows to broadcast."""

import hashlib
from collections import Counter

import duckdb
import pytest

from oracle import assert_same, connect
from quillon.functions import hashing as H
from quillon.operators import inference as I
from quillon.plans import registry

FOLDER = "/root/testdata/sf0.01"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def draw(b, j, seed=42):
    return int(hashlib.md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:12], 16)


def exchanged_rows(node):
    """Rows that leave each broadcast exchange and each explode of a plan that has run."""
    kind, found = node.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        return exchanged_rows(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return exchanged_rows(node.plan())
    if kind in ("BroadcastExchangeExec", "GenerateExec"):
        found.append(node.metrics().apply("numOutputRows").value())
    return found + [n for i in range(node.children().size()) for n in exchanged_rows(node.children().apply(i))]


def test_draws_equal_md5(monkeypatch):
    monkeypatch.setattr(H, "BATCH", 64)
    got = {b: [] for b in range(5, 112)}
    for b, j, piece in H.draw_ints(42, 5, 112, 1203):
        for x, row in enumerate(piece):
            assert len(got[b + x]) == j
            got[b + x] += row.tolist()
    assert all(row == [draw(b, j) for j in range(1203)] for b, row in got.items())


def test_bootstrap_in_parts_against_brute_force(spark, monkeypatch):
    for name, value in (("PACKED", 4), ("HELD", 8), ("DRAWS", 50), ("LEAST", 3)):  # several rows, parts and tasks a group
        monkeypatch.setattr(I, name, value)
    rows = [(g, f"s{i}", float("inf") if (g, i) == ("b", 5) else i / 4, i) for g, n in (("a", 3), ("b", 21), (None, 2)) for i in range(n)]
    rep = I.bootstrap(spark.createDataFrame(rows, "g string, c string, s double, n long"), ["g"], "c", ["s", "n"], 12).collect()
    assert Counter(r.g for r in rep) == {"a": 12, "b": 12}  # as the SQL: a null group joins nothing
    for r in rep:
        own = sorted((x for x in rows if x[0] == r.g), key=lambda x: hashlib.md5(x[1].encode()).hexdigest())
        picked = [own[draw(r.b, j) % len(own)] for j in range(len(own))]
        assert (r.s, r.n) == (sum(x[2] for x in picked), sum(x[3] for x in picked))


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["bootstrap_gap", "cluster_bootstrap_ci", "did_joint", "replication_verdict"])
def test_draws_are_no_rows(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    df.collect()
    assert max(exchanged_rows(df._jdf.queryExecution().executedPlan()), default=0) < 5000
    assert_same(spark, connection, QUERIES[name], SQL[name], FOLDER)


def test_pairs_of_groups_are_made_in_one_pass(spark, connection):
    df = QUERIES["did_independent"](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    assert max(exchanged_rows(plan)) <= 20_000  # 10 pairs of groups in 2,000 replicates; there are 182,000 draws
    assert "Join" not in plan.toString().split("FlatMapGroupsInArrow")[0]
    assert_same(spark, connection, QUERIES["did_independent"], SQL["did_independent"], FOLDER)


def same_with(spark, folder, name, rows):
    """Whether a query equals its SQL on the scores of scale 0.001 and more rows, given as SQL over ``scores``."""
    duckdb.sql(f"COPY (WITH scores AS (FROM '/root/testdata/sf0.001/item_scores.parquet') FROM scores UNION ALL {rows}) TO '{folder}/item_scores.parquet'")
    assert_same(spark, connect(folder), QUERIES[name], SQL[name], str(folder))


def test_lowest_seed_is_that_of_all_scores(spark, tmp_path):
    same_with(spark, tmp_path, "did_joint", "SELECT * REPLACE ('0' AS seed, NULL AS sample_id) FROM scores")


def test_draws_without_either_condition(spark, tmp_path):
    same_with(spark, tmp_path, "cluster_bootstrap_ci", "SELECT * REPLACE ('other' AS component, 'other' AS probe_condition) FROM scores")


def test_verdicts_beside_a_component_without_swaps(spark, tmp_path):
    same_with(spark, tmp_path, "replication_verdict", "SELECT * REPLACE ('other' AS component) FROM scores WHERE probe_condition = 'random'")
