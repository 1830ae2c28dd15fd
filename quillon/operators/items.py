"""Forced-choice items: clause pools, substitution, random controls, answer orders, excision, certified labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators.sampling import hash_key, hash_ranks


def clause_pools(sentences: DataFrame) -> DataFrame:
    """(slot, value, clause): the distinct standalone sentences of ``sentences(slot, value, clause)``."""
    return sentences.select("slot", "value", "clause").where("clause is not null and value is not null").distinct()


def both_directions(pairs: DataFrame) -> DataFrame:
    """(component, slot, source, target): each unordered value pair in both directions."""
    two = F.array(F.struct(F.col("value_a").alias("source"), F.col("value_b").alias("target")), F.struct(F.col("value_b").alias("source"), F.col("value_a").alias("target")))
    return pairs.select("component", "slot", F.explode(two).alias("d")).select("component", "slot", "d.source", "d.target")


def closest_clause(items: DataFrame, pools: DataFrame, k: int = 3, seed: str = "42") -> DataFrame:
    """For ``items(item_key, slot, target, clause)`` the pool clause of the target value: among the k closest in length
    (ties by text) one is picked by hash. Items whose target has no clause are left out."""
    candidates = items.select("item_key", "slot", F.col("target").alias("value"), F.length("clause").alias("len")).join(
        pools.select("slot", "value", F.col("clause").alias("new_clause")), ["slot", "value"]
    )
    near = F.row_number().over(W.partitionBy("item_key").orderBy(F.abs(F.length("new_clause") - F.col("len")), "new_clause"))
    best = candidates.withColumn("near", near).where(F.col("near") <= k)
    pick = F.row_number().over(W.partitionBy("item_key").orderBy(hash_key(F.concat_ws("|", "item_key", "near"), seed)))
    return best.withColumn("pick", pick).where("pick = 1").select("item_key", "new_clause")


def random_partner(items: DataFrame, key: str, a: str, b: str, seed: str = "42", candidates: int = 20) -> DataFrame:
    """(key, partner): for every row another one that differs in both ``a`` and ``b``, relaxed to differing in ``a``.

    Rows are not paired with each other: distinct (a, b) cells are, a partner cell is chosen by hash, and within its
    ``candidates`` rows of lowest hash each row draws one by its own key. The cells are the product of two label sets, which
    bounds the theta join."""
    from quillon.functions.hashing import hash_index

    ranked = hash_ranks(items.select(key, a, b), [a, b], key, seed).where(F.col("nth") <= candidates)
    pool = F.transform(F.array_sort(F.collect_list(F.struct("nth", key))), lambda r: r[key])
    cells = ranked.groupBy(a, b).agg(pool.alias("pool"))
    left = cells.select(F.col(a).alias("a1"), F.col(b).alias("b1"))
    pairs = left.join(cells, F.col("a1") != F.col(a))
    strict = (F.col(b) != F.col("b1")).cast("int")
    order = W.partitionBy("a1", "b1").orderBy(F.desc(strict), hash_key(F.concat_ws("|", "a1", "b1", a, b), seed), a, b)
    chosen = pairs.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("a1", "b1", "pool", strict.alias("strict"))
    partner = F.get("pool", hash_index(F.col(key), F.size("pool")).cast("int"))
    return items.join(chosen, (F.col(a) == F.col("a1")) & (F.col(b) == F.col("b1"))).select(key, partner.alias("partner"), "strict")


def next_not_self(jobs: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """(key, donor): the member of ``pool(id, idx)`` at hash(key) mod n, or the next one if that is the key itself."""
    from quillon.functions.hashing import hash_index

    n = pool.agg(F.count("*").alias("n"))  # one row
    at = jobs.crossJoin(F.broadcast(n)).withColumn("i", hash_index(F.col(key), F.col("n")))
    first = pool.select(F.col("idx").alias("i"), F.col("id").alias("first_id"))
    second = pool.select(F.col("idx").alias("i2"), F.col("id").alias("second_id"))
    return (
        at.withColumn("i2", F.pmod(F.col("i") + 1, F.col("n")))
        .join(first, "i")
        .join(second, "i2")
        .select(key, F.when(F.col("first_id") == F.col(key), F.col("second_id")).otherwise(F.col("first_id")).alias("donor"))
    )


def answer_orders(items: DataFrame, correct: str, distractor: str, template: str) -> DataFrame:
    """Two rows per item, the correct text as A and as B, with the letter, the rendered prompt and the template's hash."""
    orders = F.explode(F.array(F.lit("corrA"), F.lit("corrB")))
    a_first = F.col("answer_order") == "corrA"
    c, d = F.col(correct), F.col(distractor)
    both = items.withColumn("answer_order", orders)
    a, b = F.when(a_first, c).otherwise(d), F.when(a_first, d).otherwise(c)
    prompt = F.replace(F.replace(F.lit(template), F.lit("{option_a}"), a), F.lit("{option_b}"), b)
    return both.withColumns(
        {"option_a": a, "option_b": b, "correct_letter": F.when(a_first, "A").otherwise("B"), "prompt": prompt, "template_sha": F.substring(F.sha2(F.lit(template), 256), 1, 12)}
    )


def excise(items: DataFrame, bad: DataFrame, item: str, twin: str) -> DataFrame:
    """Items without the bad ones and without every item that shares a twin key with a bad one."""
    keys = items.join(bad, item, "left_semi").select(twin).distinct()
    return items.join(keys, twin, "left_anti")


def override(base: DataFrame, moves: DataFrame, key: str, label: str) -> DataFrame:
    """Labels replaced where ``moves(key, new_label)`` has one, with the source of each label."""
    joined = base.join(moves, key, "left")
    return joined.withColumn("provenance", F.when(F.col("new_label").isNotNull(), "certified").otherwise("rule")).withColumn(label, F.coalesce("new_label", label)).drop("new_label")


def drop_last_field(c: Column) -> Column:
    """A composite key without its last ``|`` field."""
    return F.regexp_replace(c, r"\|[^|]*$", "")
