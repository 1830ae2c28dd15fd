"""Audits over hand-made labels."""

from quillon.plans import registry


def test_populations_of_both_slots(spark, tmp_path):
    labels = ["noisy; linear rise", " Step;Linear Fall ", "step; linear rise", "smooth; noisy", None]
    spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "pair_no long, class_label string").write.parquet(f"{tmp_path}/pairs.parquet")
    components = [("C1", "shape", "linear rise", "linear fall"), ("C4", "fluct", "noisy", "step"), ("C5", "shape", "saw teeth", "slow wave")]
    spark.createDataFrame(components, "component string, slot string, value_a string, value_b string").write.parquet(f"{tmp_path}/component_pairs.parquet")
    got = {tuple(r) for r in registry.queries()["pair_populations"](spark, str(tmp_path)).collect()}
    assert got == {("C1:linear rise/linear fall", "shape", 3, 2), ("C4:noisy/step", "fluct", 3, 1)}
