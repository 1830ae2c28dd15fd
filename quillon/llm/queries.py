"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import canonical, leakage, nearedits, overlap, packing, sample, spans, splits, sql
from quillon.session import kept_folder, read_table, stage

#: Times at which the growing sample of problem 5 is extended; the last step takes everything.
CUTOFFS = ["2031-10-01 00:00:00", "2032-04-01 00:00:00", "2032-10-01 00:00:00", "2033-04-01 00:00:00"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.cross_split_overlaps(read_table(spark, sf, "pairs"))
    return found.select(F.least("eval_id", "train_id").alias("pair_a"), F.greatest("eval_id", "train_id").alias("pair_b"))


def p1_overlap_by_split(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read_table(spark, sf, "pairs")
    return overlap.overlap_report(pairs, overlap.cross_split_overlaps(pairs))


def caption_records(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of pairs and distractors of the validation sample as one collection (rec, text)."""
    captions = read_table(spark, sf, "pairs").select(F.concat(F.lit("p"), "pair_no").alias("rec"), F.col("caption").alias("text"))
    distractors = read_table(spark, sf, "manual_validation_sample").select(
        F.concat(F.lit("m"), "idx").alias("rec"), F.col("caption_distractor").alias("text")
    )
    return captions.unionByName(distractors).where("text is not null")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearedits.near_edit_pairs(*nearedits.near_edits(caption_records(spark, sf)))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    return nearedits.near_edit_groups(*nearedits.near_edits(caption_records(spark, sf)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.copies(*canonical.collapse_lines(read_table(spark, sf, "pair_lines")))


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.collapse_lines(read_table(spark, sf, "pair_lines"))[1].select("keep_id", "n_copies")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_conflicts(read_table(spark, sf, "pairs")).select(F.col("id").alias("pair_no"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.assign_splits(read_table(spark, sf, "pairs")).withColumnRenamed("id", "pair_no")


def p4_balance(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read_table(spark, sf, "pairs")
    return splits.split_balance(splits.assign_splits(pairs), pairs)


def p4_check(spark: SparkSession, sf: str) -> DataFrame:
    """What every assignment must fulfil: all rows assigned, no torn group, each split within a hundredth of its share."""
    assigned = splits.assign_splits(read_table(spark, sf, "pairs"))
    groups = assigned.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("new_split").alias("k"), *[F.count_if(F.col("new_split") == s).alias(s) for s in ("train", "val", "test")])
    share = lambda s: F.sum(s) / F.sum("n")
    near = (F.abs(share("train") - 0.8) <= 0.01) & (F.abs(share("val") - 0.1) <= 0.01) & (F.abs(share("test") - 0.1) <= 0.01)
    return groups.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("k") != 1).alias("n_torn"), near.alias("near"))


def p5_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sample with its ledger kept below the shared folder, one ledger for each data folder."""
    return sample.grow_sample(read_table(spark, sf, "pairs"), CUTOFFS, folder=kept_folder(spark, "p5-ledger", sf.rstrip("/")))


def p5_sample_closed(spark: SparkSession, sf: str) -> DataFrame:
    """The sample as of the latest half-yearly cut-off that the table has reached: rebuilt from the table alone, it keeps
    its keys whenever later rows arrive. Keys first loaded after that cut-off, or without a time, wait for the next."""
    pairs = read_table(spark, sf, "pairs")
    return sample.grow_sample(pairs, sample.closed_cutoffs(pairs, CUTOFFS), open_step=False)


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_texts(read_table(spark, sf, "documents"), read_table(spark, sf, "pack_spec"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf), read_table(spark, sf, "pack_spec"))


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must fulfil, per capacity: all texts with tokens packed, no container over its capacity, no text
    cut that fits, and at most three in a hundred containers (and one) more than the tokens need."""
    spec = read_table(spark, sf, "pack_spec")
    packed = stage(p6_containers(spark, sf).where("container_id is not null"), "p6-packed")
    texts = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("parts")).join(F.broadcast(spec), "spec_id")
    per_text = texts.groupBy("spec_id").agg(F.count("*").alias("n_texts"), F.count_if(F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("n_cut"))
    fill = packing.fill_report(packed, spec).join(F.broadcast(spec), "spec_id")
    fill = fill.select("spec_id", (F.col("most") > F.col("capacity_tokens")).cast("long").alias("n_over"), (F.col("n_containers") <= 1.03 * F.col("least_containers") + 1).alias("well_filled"))
    return per_text.join(fill, "spec_id").select("spec_id", "n_texts", "n_cut", "n_over", "well_filled")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.verbatim_leaks(leakage.template_hits(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Verbatim and re-parameterised leaks with the share of the item's words in the longest consistent stretch."""
    leaks = leakage.leaked_items(leakage.template_hits(read_table(spark, sf, "documents"), read_table(spark, sf, "eval_items")))
    kind = F.when(F.col("n_exact") > 0, "verbatim").when(F.col("consistent"), "re-parameterised")
    return leaks.withColumn("kind", kind).where("kind is not null").select(
        "doc_id", "eval_id", "kind", "n_windows", "same_words", F.round(F.col("longest") / F.col("item_words"), 6).alias("covered")
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    members, links, _ = spans.shared_spans(read_table(spark, sf, "documents"))
    return spans.span_pairs(members, links)


def p8_shared(spark: SparkSession, sf: str) -> DataFrame:
    """The share of every document; those without text or shorter than a span share nothing."""
    documents = read_table(spark, sf, "documents")
    members, _, stretches = spans.shared_spans(documents)
    share = spans.shared_share(members, stretches).select("doc_id", "shared_chars", "share")
    n = F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")
    return documents.select("doc_id", n).join(share, "doc_id", "left").na.fill(0, ["shared_chars", "share"])


def p8_stretches(spark: SparkSession, sf: str) -> DataFrame:
    members, _, stretches = spans.shared_spans(read_table(spark, sf, "documents"))
    return spans.document_stretches(members, stretches)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_overlap_by_split, p2_found, p2_groups, p3_found, p3_records, p4_found, p4_splits, p4_balance, p4_check,
            p5_sample, p5_sample_closed, p6_containers, p6_fill, p6_check, p7_found, p7_leaks, p8_found, p8_shared, p8_stretches,
        )
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle(CUTOFFS)
