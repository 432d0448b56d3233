"""Exact deduplication by sorting content.

Normalised texts are range-partitioned by sampled splitters (``repartitionByRange`` on their first characters, then a
hash of the whole), each range is sorted externally, and equal neighbours -- compared in full, byte by byte -- form a group.  The group's smallest or largest
identifier stays.

Skew: a text whose copies would fill a noticeable part of a partition is salted by its identifier, so its copies are
dealt over several ranges and meet again as one row per salt.  At most ``SHARES`` such texts per partition exist, which
bounds the list that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, shuffle_partitions, written

#: A text is hot if its copies make more than 1 / SHARES of an even partition; there are at most SHARES hot texts per partition.
SHARES = 4
#: Characters by which ranges are cut; texts that share them are cut by a hash, and are still compared in full.
HEAD = 32


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    keep: "min" (smallest identifier stays) or "max".  Texts are equal when identical after lower-casing A-Z.
    A null text counts as empty.  A null identifier yields to any other; of rows that repeat an identifier in a group,
    one is kept.  Texts of any length are compared whole.  An empty table gives an empty result; other columns are
    not read, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))

    # Equal texts have equal hints; unequal texts with one hint only share their salting.
    hint = F.xxhash64(F.lower(F.decode(F.encode("text", "UTF-8"), "UTF-8")))
    counts = docs.groupBy(hint.alias("hint")).agg(F.count("*").alias("n"))
    total = docs.count()
    hot = counts.where(F.col("n") > max(1, total // (SHARES * parts))).select("hint", F.lit(True).alias("hot"))

    # Equal texts have equal heads and hints, so these few bytes can stand for a text in the splitters that are sampled.
    salted = (
        docs.withColumn("hint", hint)
        .join(F.broadcast(hot), "hint", "left")
        .select(
            "id",
            "hint",
            ascii_lower(F.col("text")).alias("norm"),
            F.col("hot").isNotNull().alias("hot"),
            F.when(F.col("hot"), F.coalesce(F.pmod(F.xxhash64("id"), F.lit(parts)), F.lit(0))).otherwise(0).alias("salt"),
        )
    )
    first = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    same = Window.partitionBy("head", "hint", "salt", "norm")
    best = F.min if keep == "min" else F.max
    ranged = salted.withColumn("head", F.substring("norm", 1, HEAD)).repartitionByRange("head", "hint", "salt")
    found = ranged.select(
        "id",
        "hot",
        "norm",
        F.row_number().over(same.orderBy(first)).alias("nth"),
        best("id").over(same).alias("salt_keep"),
        F.count("*").over(same).alias("salt_size"),
    ).select(
        "id",
        "nth",
        "salt_keep",
        "salt_size",
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("hot") & (F.col("nth") == 1), F.col("norm")).alias("hot_text"),
    )
    found = written(found, "exact-dedup")

    # The salts of a hot text meet: one row each, compared in full again.
    meet = Window.partitionBy("hot_text")
    merged = found.where(F.col("hot_text").isNotNull()).select(
        F.col("salt_keep").alias("of"), F.col("text_sha256").alias("sha"), best("salt_keep").over(meet).alias("keep"), F.sum("salt_size").over(meet).alias("size")
    )
    return (
        found.drop("hot_text")
        .join(merged, F.col("salt_keep").eqNullSafe(F.col("of")) & (F.col("text_sha256") == F.col("sha")), "left")
        .select(
            F.col("id").alias(id_col),
            F.when(F.col("sha").isNotNull(), F.col("keep")).otherwise(F.col("salt_keep")).alias("keep_id"),
            F.coalesce("size", "salt_size").alias("group_size"),
            ((F.col("nth") == 1) & (F.col("sha").isNull() | F.col("keep").eqNullSafe(F.col("salt_keep")))).alias("kept"),
            "text_sha256",
        )
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` whose identifier stays; identifiers are taken to be unique here."""
    stay = exact_groups(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("__stay"))
    return docs.join(stay, docs[id_col].eqNullSafe(F.col("__stay")), "left_semi")
