"""Problems 1 to 3 against brute force, with hot groups and dirty rows."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import canonical, nearedits, overlap
from quillon.llm.text import words

PAIRS = "pair_no long, split string, dataset string, series array<double>, caption string, id string, tokens string"


def similarity(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def znorm(s):
    if s is None or any(v is None for v in s):
        return None
    x = np.array(s, float)
    return None if len(x) == 0 or x.max() == x.min() else (x - x.mean()) / x.std()


def make_pairs(n=240, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    bases = [[rng.uniform(0, 9) for _ in range(rng.choice([3, 12, 12, 30]))] for _ in range(12)]
    captions = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12]))) for _ in range(15)]
    rows = []
    for i in range(n):
        base = bases[0] if rng.random() < 0.35 else rng.choice(bases)  # a third of all rows share one series
        x = [v * 3 + 7 + rng.uniform(-1, 1) * rng.choice([0, 0.05, 0.2]) for v in base]
        if rng.random() < 0.05:
            x = [1.5] * len(x)
        if rng.random() < 0.03:
            x = None
        elif rng.random() < 0.03:
            x[0] = None
        c = rng.choice(captions).split()
        if rng.random() < 0.4:
            c[rng.randrange(len(c))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            rng.shuffle(c)
        c = rng.choice([" ".join(c), " ".join(c).upper(), "", None] if rng.random() < 0.1 else [" ".join(c)])
        rows.append((i, rng.choice(["train", "train", "val", "test", None]), "d", x, c, "clash", "clash"))
    return rows


@pytest.mark.parametrize("hot_cell,bounds", [(1000, ((64, 2),)), (0, ((1, 1), (3, 2), (12, 3), (64, 2))), (0, ((1, 1), (5, 2), (9, 3))), (20, ((2, 1),))])
def test_overlaps_equal_brute_force(spark, hot_cell, bounds):
    rows = make_pairs()
    overlaps = overlap.cross_split_overlaps(spark.createDataFrame(rows, PAIRS), small=10, hot_cell=hot_cell, bounds=bounds)
    found = {(r.eval_id, r.train_id): r for r in overlaps.collect()}
    expected = set()
    for a in rows:
        for b in rows:
            if a[1] in ("val", "test") and b[1] == "train":
                x, y = znorm(a[3]), znorm(b[3])
                if x is not None and y is not None and len(x) == len(y) and np.abs(x - y).max() <= 0.05 and similarity(a[4] or "", b[4] or "") >= 0.6:
                    expected.add((a[0], b[0]))
    assert set(found) == expected and len(expected) > 40
    e, t = next(iter(expected))
    text = {r[0]: r[4] for r in rows}
    assert found[(e, t)].similarity == pytest.approx(similarity(text[e], text[t]))


def test_overlaps_of_nothing(spark):
    empty = spark.createDataFrame([], PAIRS)
    assert overlap.cross_split_overlaps(empty).count() == 0
    only_train = spark.createDataFrame([r for r in make_pairs(30) if r[1] == "train"], PAIRS)
    assert overlap.cross_split_overlaps(only_train).count() == 0
    assert overlap.overlap_report(only_train, overlap.cross_split_overlaps(only_train)).count() == 0


def make_texts(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    bases = [rng.choices(vocabulary, k=rng.randint(18, 60)) for _ in range(25)]
    rows = []
    for i in range(n):
        t = list(bases[0] if rng.random() < 0.35 else rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            rng.shuffle(t)
        rows.append((f"p{i}", " ".join(t)))
    rows += [("m1", None), ("m2", ""), ("m3", "short one"), ("m4", "x " * 5000), ("m5", "x " * 4100)]
    return rows


@pytest.mark.parametrize("block", [2, 2000])
def test_near_edits_equal_brute_force(spark, block):
    rows = make_texts()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "rec string, text string, set_key string")
    members, links = nearedits.near_edits(df, block=block)
    found = {(r.rec_a, r.rec_b) for r in nearedits.near_edit_pairs(members, links).collect()}
    long = [(k, t) for k, t in rows if t and len(words(t)) >= 20]
    expected = {(a, b) for a, x in long for b, y in long if a < b and similarity(x, y) >= 0.8}
    assert found == expected and len(expected) > 500
    groups = {r.rec: r.group_id for r in nearedits.near_edit_groups(members, links).collect()}
    assert all(groups[a] == groups[b] for a, b in expected) and set(groups) == {x for p in expected for x in p}


def test_near_edits_of_nothing(spark):
    members, links = nearedits.near_edits(spark.createDataFrame([("a", None)], "rec string, text string"))
    assert nearedits.near_edit_pairs(members, links).count() == 0
    assert nearedits.near_edit_groups(members, links).count() == 0


def test_estimate_is_corrected_for_chance(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = [("a", " ".join(base)), ("b", " ".join(base[:40] + [f"v{i}" for i in range(20)])), ("c", " ".join(f"u{i}" for i in range(60)))]
    rng.shuffle(rows)
    sets = nearedits.word_sets(spark.createDataFrame(rows, "rec string, text string"), 1).withColumn("set_key", F.ascii("rec").cast("long"))
    signed = nearedits.signatures(sets, 56, 8, 2, 11).join(sets.select("rec", "set_key"), "set_key")

    x = signed.select(F.col("rec").alias("ra"), F.col("packed").alias("pa")).crossJoin(signed.select(F.col("rec").alias("rb"), F.col("packed").alias("pb")))
    est = {(r.ra, r.rb): r.e for r in x.select("ra", "rb", nearedits.estimate(F.col("pa"), F.col("pb"), 448, 2).alias("e")).collect()}
    assert est[("a", "a")] == 1.0 and abs(est[("a", "b")] - 0.5) < 0.12 and abs(est[("a", "c")]) < 0.12


LINES = [
    '{"caption": "A  Rise!", "series": [1, 2.50], "split": null, "class_label": "x"}',
    '{"series":[1.0,2.5],"class_label":"x","caption":"a rise"}',
    '{"caption": "a-rise", "class_label": "x", "series": [1e0, 25e-1], "split": null}',
    '{"caption": "a rise", "series": [1, 2.5], "class_label": "X"}',
    '{"caption": "a ris", "series": [1, 2.5], "class_label": "x"}',
    '{"caption": null, "series": [1, 2.5], "class_label": "x"}',
    '{"caption": "", "series": [1, 2.5], "class_label": "x"}',
    '{"caption": "a rise", "series": [true, 2.5], "class_label": "x"}',
    '{"caption": "a rise", "series": [1, 2.5',
    '{"caption": "a rise", "series": [NaN, 2.5]}',
    "[1, 2]",
    "",
    None,
    "[" * 100_000,
    json.dumps({"caption": "w " * 100_000}),
    json.dumps({"caption": "W" * 1 + "w" * 99_999}),
]


@pytest.mark.parametrize("hot_least", [1, 1000])
def test_lines_collapse(spark, hot_least):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(LINES)] + [(100 + i, LINES[0], "k", "k") for i in range(50)]
    df = spark.createDataFrame(rows, "line_id long, line_text string, key string, id string").repartition(7)
    keyed, records = canonical.collapse_lines(df, hot_share=0.0 if hot_least == 1 else 1e-4, hot_least=hot_least)
    found = {(r.keep_id, r.copy_id) for r in canonical.copies(keyed, records).collect()}
    assert found == {(0, 1), (0, 2)} | {(0, 100 + i) for i in range(50)} | {(14, 15)}
    assert {r.keep_id: r.n_copies for r in records.collect()}[0] == 53


def test_lines_of_nothing(spark):
    keyed, records = canonical.collapse_lines(spark.createDataFrame([], "line_id long, line_text string"))
    assert records.count() == 0 and canonical.copies(keyed, records).count() == 0
