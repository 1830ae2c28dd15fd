"""Items of both slots over hand-made captions."""

from quillon.plans import registry

PAIRS = [
    (1, "s1", "noisy; linear rise", "It goes up. It is noisy."),
    (2, "s2", "step; linear fall", "It goes down. It has a step."),
]


def test_both_slots_yield_items(spark, tmp_path):
    spark.createDataFrame(PAIRS, "pair_no long, sample_id string, class_label string, caption string").write.parquet(f"{tmp_path}/pairs.parquet")
    components = [("C1", "shape", "linear rise", "linear fall"), ("C4", "fluct", "noisy", "step")]
    spark.createDataFrame(components, "component string, slot string, value_a string, value_b string").write.parquet(f"{tmp_path}/component_pairs.parquet")
    got = {(r.slot, r.item_key): r.distractor for r in registry.queries()["swap_items"](spark, str(tmp_path)).collect()}
    assert got == {
        ("shape", "C1|1|linear fall"): "It goes down. It is noisy.",
        ("shape", "C1|2|linear rise"): "It goes up. It has a step.",
        ("fluct", "C4|1|step"): "It goes up. It has a step.",
        ("fluct", "C4|2|noisy"): "It goes down. It is noisy.",
    }
    checked = {tuple(r) for r in registry.queries()["item_validate"](spark, str(tmp_path)).collect()}
    assert checked == {("C1", 2, 0, 0, 2), ("C4", 2, 0, 0, 2)}


def test_all_ids_and_all_series(spark, tmp_path):
    ids = [f"c|s{i}|swap" for i in range(40)]
    spark.createDataFrame([(i,) for i in ids], "item_id string").write.parquet(f"{tmp_path}/probe1_items.parquet")
    series = [(1, "short", [25.0, 50.0]), (2, "long", [25.0] * 100)]
    spark.createDataFrame(series, "pair_no long, sample_id string, series array<double>").write.parquet(f"{tmp_path}/pairs.parquet")
    assert sorted(r.id for r in registry.queries()["id_list_roundtrip"](spark, str(tmp_path)).collect()) == sorted(ids)
    got = {r.sample_id: (r.top, r.bottom) for r in registry.queries()["moving_average"](spark, str(tmp_path)).collect()}
    assert got == {"short": (3.0, 3.0), "long": (25.0, 13.0)}
