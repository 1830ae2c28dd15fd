"""Problem 4: train, validation and test splits that keep related records together.

Method: the names a record gives its sample are linked by distributed union-find (local forests merged hierarchically,
see ``components``); the groups are then assigned largest first to the split furthest below its target. The greedy step
works on the numbers of groups by label and exact size: equal groups of a label fill the label's deficits level by level;
groups that a label has no room for are settled over all labels together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.components import components
from quillon.llm.skew import attach, hot_keys
from quillon.session import stage

#: Characters that count as blanks at the ends of a name.
BLANKS = " \t\r\n\u00a0"


def sample_name(name: Column) -> Column:
    """A sample's name regardless of letter case, slash or backslash, and blanks at the ends."""
    return F.btrim(F.lower(F.replace(name, F.lit("\\"), F.lit("/"))), F.lit(BLANKS))


def caption_sample(caption_id: Column) -> Column:
    """The name before the last ``#`` of a caption id; null without one."""
    return F.when(F.instr(caption_id, "#") > 0, sample_name(F.regexp_extract(caption_id, "(?s)^(.*)#", 1)))


def class_label(label: Column) -> Column:
    """A class label regardless of letter case and of blanks at its ends and around its semicolon."""
    return F.lower(F.regexp_replace(F.btrim(label, F.lit(BLANKS)), r"\s*;\s*", "; "))


def related_groups(records: DataFrame, id_col: str = "pair_no") -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, split, label, node)`` and labels ``(node, root)`` of the names that are linked to other names.

    A row's node is one of its names, null if it has none (such a row is a group of its own). A node without a label
    is its own root.
    """
    rows = records.select(
        F.col(id_col).cast("long").alias("id"),
        F.col("split").cast("string").alias("split"),
        class_label(F.col("class_label")).alias("label"),
        sample_name(F.col("sample_id")).alias("s"),
        caption_sample(F.col("caption_id")).alias("c"),
    )
    links = rows.where("s <> c").select(F.col("s").alias("a"), F.col("c").alias("b")).distinct()
    return rows.select("id", "split", "label", F.coalesce("s", "c").alias("node")), components(links)


def node_counts(rows: DataFrame) -> DataFrame:
    """(node, n, low, high): rows, smallest and largest split of every name."""
    return rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("split").alias("low"), F.max("split").alias("high"))


def split_conflicts(records: DataFrame, id_col: str = "pair_no") -> DataFrame:
    """(id): every row of a group whose rows have more than one non-null split, rows with a null split included.

    Rows without any sample name conflict with nothing; an empty table gives an empty result. Splits are pre-aggregated
    per name before groups are formed, so a hot name is one row when groups are formed; its rows are found by a broadcast.
    """
    rows, labels = related_groups(records, id_col)
    per_node = node_counts(rows).join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_node = stage(per_node, "p4-nodes")
    torn = per_node.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("root")
    nodes = per_node.join(torn, "root", "left_semi").select("node")
    return attach(rows.where("node is not null"), nodes, "node", hot_keys(per_node.select("node", "n"), "node"), "inner").select("id")


def pour(need: list[float], size: int, groups: int) -> list[int]:
    """How many of ``groups`` equal groups each split takes below its target: poured down to a common level, so the split
    furthest below target gets most. A group that fits below no target is left over."""
    low, high = min(need) - size * groups, max(need)
    for _ in range(60):
        level = (low + high) / 2
        if sum(max(0, math.floor((d - level) / size)) for d in need) > groups:
            low = level
        else:
            high = level
    return [max(0, min(math.floor((d - high) / size), math.floor(d / size + 1e-9))) for d in need]


def _label_quotas(shares: list[float]):
    """Quotas of one label: for every size of its groups how many go to each split, largest first, and how many are left
    over because the label's smaller groups could not make up for them; these prefer the split furthest below target."""

    def run(key: tuple, sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        total = int((sizes["size"] * sizes["n"]).sum())
        need, smaller, out = [s * total for s in shares], total, []
        for size, n in zip(sizes["size"].tolist(), sizes["n"].tolist()):
            smaller -= size * n
            taken = pour(need, size, n)
            need = [d - t * size for d, t in zip(need, taken)]
            while sum(taken) < n and smaller >= size:  # later groups can even this out
                k = max(range(len(need)), key=lambda j: need[j])
                taken[k] += 1
                need[k] -= size
            prefers = sorted(range(len(need)), key=lambda j: -need[j])[: max(1, n - sum(taken))]
            out.append((key[0], size, np.cumsum(taken).tolist(), n - sum(taken), prefers, [0.0] * len(need)))
        if out:
            out[-1][5][:] = need  # what the label is short of, together with its left-over groups
        return pd.DataFrame(out, columns=["label", "size", "bounds", "left", "prefers", "short"])

    return run


def settle(left: list[tuple[int, int, int]], need: list[float]) -> dict[tuple[int, int], list[int]]:
    """For groups left over, ``(size, preferred split, number)``: how many of each kind go to each split so that the
    splits fill their common need, largest first, preferences where they fit."""
    out: dict[tuple[int, int], list[int]] = {}
    need = list(need)
    for size in sorted({s for s, _, _ in left}, reverse=True):
        wishes = {p: n for s, p, n in left if s == size}
        taken = pour(need, size, sum(wishes.values()))
        need = [d - t * size for d, t in zip(need, taken)]
        while sum(taken) < sum(wishes.values()):
            k = max(range(len(need)), key=lambda j: need[j])
            taken[k] += 1
            need[k] -= size
        given = {p: [min(n, taken[p]) if j == p else 0 for j in range(len(need))] for p, n in wishes.items()}
        room = [t - sum(g[j] for g in given.values()) for j, t in enumerate(taken)]
        for p, n in sorted(wishes.items()):
            for j in range(len(need)):
                more = min(room[j], n - sum(given[p]))
                given[p][j] += more
                room[j] -= more
            out[(size, p)] = given[p]
    return out


def _places(groups: DataFrame, keys: list[str]) -> DataFrame:
    """``groups`` with ``place``, the number of each within its keys in the order of its hash, counted range by range of
    the hash, so that a kind with a third of all groups is not ordered by one task."""
    counts = stage(groups.groupBy(*keys, "slice").agg(F.count("*").alias("n")), "p4-counts")
    before = counts.select(*keys, "slice", (F.sum("n").over(W.partitionBy(*keys).orderBy("slice")) - F.col("n")).alias("before"))
    nth = F.row_number().over(W.partitionBy(*keys, "slice").orderBy("order", "group_id"))
    return groups.withColumn("nth", nth).join(before, [*keys, "slice"]).withColumn("place", F.col("nth") + F.col("before")).drop("nth", "before")


def assign_splits(
    records: DataFrame, id_col: str = "pair_no", shares: dict[str, float] | None = None, slices: int = 256
) -> DataFrame:
    """(id, group_id, old_split, new_split) for every row: related rows share a split, shares hold per label as far as
    groups allow.

    A group's label is the one most of its rows have (ties: the smallest; null counts as a label). Rows without names
    are groups of one. Each label places its groups by themselves, largest first, in a task of its own that sees one row
    per size (a label of n rows has fewer than sqrt(2n) sizes). Groups that no split of the label has room for are settled
    over all labels together, by size and preferred split, which is the only list that reaches the driver; it is as short.
    Equal groups are ordered by a hash of their id, so reruns agree whatever the partitioning. An empty table gives an
    empty result.
    """
    shares = shares or {"train": 0.8, "val": 0.1, "test": 0.1}
    names = list(shares)
    rows, labels = related_groups(records, id_col)
    hot = hot_keys(node_counts(rows).select("node", "n"), "node")
    root = F.coalesce("root", "node", F.concat(F.lit("\u0001row "), "id"))
    grouped = attach(rows, labels, "node", hot).select("id", "split", F.coalesce("label", F.lit("")).alias("label"), root.alias("group_id"))
    grouped = stage(grouped, "p4-grouped")
    votes = grouped.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    groups = votes.groupBy("group_id").agg(
        F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("k"), "label")).getField("label").alias("label")
    )
    order = F.xxhash64("group_id")
    groups = groups.select("group_id", "label", "size", order.alias("order"), F.floor((order / 2.0**64 + 0.5) * slices).alias("slice"))
    groups = stage(groups, "p4-groups")
    sizes = groups.groupBy("label", "size").agg(F.count("*").alias("n"))
    schema = "label string, size long, bounds array<long>, left long, prefers array<int>, short array<double>"
    quotas = stage(sizes.groupBy("label").applyInPandas(_label_quotas([shares[s] for s in names]), schema), "p4-quotas")
    placed = _places(groups, ["label", "size"]).join(quotas.select("label", "size", "bounds", "prefers"), ["label", "size"])
    choice = F.array_position(F.transform("bounds", lambda b: F.col("place") <= b), True) - 1  # -1: left over
    placed = placed.withColumn("k", choice)
    over = placed.where("k < 0").withColumn("wish", F.get("prefers", F.pmod(F.col("place") - 1 - F.element_at("bounds", -1), F.size("prefers")).cast("int")))
    over = stage(over.select("group_id", "size", "wish", "order", "slice"), "p4-over")
    need = quotas.agg(*[F.coalesce(F.sum(F.col("short")[j]), F.lit(0.0)).alias(f"n{j}") for j in range(len(names))]).first()
    kinds = over.groupBy("size", "wish").agg(F.count("*").alias("n")).collect()  # fewer than sqrt(2n) sizes, a few wishes
    table = [(s, w, np.cumsum(t).tolist()) for (s, w), t in settle([tuple(r) for r in kinds], list(need)).items()]
    settled = records.sparkSession.createDataFrame(table, "size long, wish int, bounds array<long>")
    late = _places(over, ["size", "wish"]).join(F.broadcast(settled), ["size", "wish"]).withColumn("k", choice)
    named = F.element_at(F.array(*map(F.lit, names)), (F.col("k") + 1).cast("int"))
    chosen = placed.where("k >= 0").select("group_id", "k").unionByName(late.select("group_id", "k")).select("group_id", named.alias("new_split"))
    big = hot_keys(groups.select("group_id", F.col("size").alias("n")), "group_id")
    return attach(grouped, chosen, "group_id", big).select("id", "group_id", F.col("split").alias("old_split"), "new_split")


def split_balance(assigned: DataFrame, records: DataFrame, id_col: str = "pair_no") -> DataFrame:
    """Rows per class label and new split, and how many of them had another split before."""
    label = records.select(F.col(id_col).cast("long").alias("id"), F.coalesce(class_label(F.col("class_label")), F.lit("")).alias("label"))
    return (
        assigned.join(label, "id")
        .groupBy("label", "new_split")
        .agg(F.count("*").alias("n_rows"), F.count_if(F.col("old_split") != F.col("new_split")).alias("n_moved"))
    )
