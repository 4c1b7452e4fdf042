"""The corpus pipeline: toxicity, exact dedup, near dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the columns of
documents. A row is told by its doc_id and a digest of its text, so that rows of one doc_id, or of a null one, with unlike texts are
documents of their own.

Defined cases, of every stage: a null text counts as empty; repeated rows get the same decision, and where one of a group stays it is
one row; an empty table gives no rows; other columns than doc_id and text are passed on as they are, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, ngram_join, packing, substring_dedup, toxicity
from corpusloom.llm.base import documents, few, saved
from corpusloom.llm.queries import TOXIC, tokenizer


def column(name: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects. Empty texts have the score of no evidence; without labels of both kinds,
    or of documents at hand, there is no model and all rows stay."""
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model, TOXIC)


def without(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows of dropped (doc_id, key), and with one of each of repeated (doc_id, key)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("k"))

    def same(pairs: DataFrame) -> Column:
        return F.col("d").eqNullSafe(pairs["its_doc"]) & (F.col("k") == pairs["its_key"])

    def named(pairs: DataFrame, name: str) -> DataFrame:
        return few(saved(pairs.select(F.col("doc_id").alias("its_doc"), F.col("key").alias("its_key")).distinct(), name))

    gone, again = named(dropped, "dropped"), named(repeated, "repeated")
    left = rows.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        once = left.join(again, same(again), "left_semi").dropDuplicates(["d", "k"])
        left = left.join(again, same(again), "left_anti").unionByName(once)
    return left.select("row.*")


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the longest original, of those the smallest doc_id."""
    found = saved(exact_dedup.exact_duplicates(docs).select("doc_id", "key", "group_size", "kept"), "exact")
    several = found.where("group_size > 1").groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    return without(docs, several.where("not kept"), several.where("kept and rows > 1"))


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, a null one only where there is no other. Texts without words have no
    group and stay."""
    near = saved(ngram_join.near_duplicates(docs).where("group_id is not null").select("doc_id", "key", "component_id", "group_id"), "near")
    first = near.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    tied = first.groupBy("group_id").agg(F.min("key").alias("stays"), F.count(F.lit(1)).alias("rows")).where("rows > 1")  # of one doc_id
    tied = first.join(few(saved(tied, "tied")), "group_id")
    dropped = near.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key").unionByName(tied.where("key <> stays").select("doc_id", "key"))
    return without(docs, dropped, tied.where("key = stays").select("doc_id", "key"))


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that occur elsewhere; a text that loses something has its remaining words joined by blanks, one that loses all goes."""
    others = F.struct(*[column(c) for c in docs.columns if c != "text"])
    cut = substring_dedup.remove_repeated_windows(docs.select("doc_id", "text", others.alias("row"), F.col("text").isNull().alias("none")), carry=True)
    cut = cut.where("n_removed = 0 or n_removed < n_units").select("n_removed", "kept", "text", "carried.row", "carried.none")
    text = F.when(F.col("none"), None).when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    return cut.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece. An empty text has the terminator alone."""
    pieces = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_out), ("ngram_jaccard_join", near_out), ("substring_dedup", repeats_out), ("packing", packed)]
#: SQL expresses neither the model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
