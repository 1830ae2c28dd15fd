import pytest
from pyspark.sql import functions as F

from quillon.functions import dates as D
from quillon.functions import text as T

PANEL = [
    ("rises then falls", "dependent", "order_claim"),
    ("stays flat", "invariant", "anchored"),
    ("no fluctuation", "invariant", "negated_motion"),
    ("volatile", "ambiguous", "idiom"),
    ("volatile with a late drop", "dependent", "order_claim"),
    ("a straight line", "ambiguous", "straight_alone"),
    ("a straight and steady line", "invariant", "anchored"),
    ("??", "ambiguous", "junk"),
    ("quite nice", "ambiguous", "no_anchor"),
    ("little change until the end", "dependent", "order_claim"),
    ("ups and downs", "ambiguous", "idiom"),
    ("Upwards", "dependent", "order_claim"),
]


@pytest.mark.parametrize("text,label,reason", PANEL)
def test_rule_panel(spark, text, label, reason):
    r = spark.createDataFrame([(text,)], "t string").select(T.order_label(F.col("t")).alias("r")).first().r
    assert (r.label, r.reason) == (label, reason)


def value(spark, expr, *args):
    names = [f"c{k}" for k in range(len(args))]
    return spark.createDataFrame([args], ", ".join(f"{n} {'int' if isinstance(a, int) else 'string'}" for n, a in zip(names, args))).select(expr(*map(F.col, names)).alias("v")).first().v


def test_texts(spark):
    assert value(spark, T.sentences, "One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert value(spark, T.sentences, "") == [] and value(spark, T.sentences, None) is None
    assert value(spark, T.word_count, "  a  b ") == 2 and value(spark, T.word_count, " ") == 0
    assert value(spark, lambda t: T.swap_words(t, {"first": "last", "last": "first"}), "First the last, firstly") == "Last the first, firstly"
    assert value(spark, lambda t: T.swap_stems(t, "ris", "fall"), "Rises and falling") == "Falles and rising"
    assert value(spark, T.replace_first, "a b a", "a", "x") == "x b a" and value(spark, T.replace_first, "abc", "z", "x") == "abc"
    assert value(spark, T.first_direction, "It declines, then rises") == "down" and value(spark, T.first_direction, "flat") == "none"
    assert value(spark, T.first_difference, "abcd", "abxd") == 3 and value(spark, T.first_difference, "ab", "ab") is None and value(spark, T.first_difference, "ab", "abc") == 3
    assert value(spark, T.frame, "In New York it  rains") == "<PLACE> it rains"
    assert value(spark, T.pins, "a Positive spike", "positive spike") is True and value(spark, T.pins, "x", "clean") is None


def test_dates(spark):
    assert value(spark, lambda s, o: D.partial_date(s, o), "March 5,", "May 1, 2019") == (3, 5, 2019)
    assert value(spark, lambda s, o: D.partial_date(s, o), "June 2020", "") == (6, None, 2020)
    assert value(spark, lambda s, o: D.partial_date(s, o), "soon", "") is None
    assert value(spark, lambda m, d, y: D.period_slot(m, d, y, False), 3, 2, 2021) == "The past week from February 23 to March 2, 2021."
    assert value(spark, lambda m, d, y: D.period_slot(m, d, y, True), 3, 2, 2021) == "The past six months from September 2, 2020 to March 2, 2021."


def test_every_pattern_is_counted(spark, tmp_path):
    from quillon.functions import vocabulary as V
    from quillon.plans import registry

    texts = ["Up then down", "a slope from low to a higher crest", "trending, then steep", "late", None]
    spark.createDataFrame([(t,) for t in texts], "caption string").write.parquet(f"{tmp_path}/pairs.parquet")
    got = {r.pattern: r.n_captions for r in registry.queries()["pattern_docfreq"](spark, str(tmp_path)).collect()}
    assert got == {"up": 1, "then": 2, "down": 1, r"slop\w*": 1, r"from\b[^.]*\bto": 1, "higher": 1, r"crest\w*": 1, r"trend\w*": 1, r"steep\w*": 1, "late[rst]*": 1}
    assert set(got) <= set(V.ORDER_CLAIMS)
