"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies.  Its whole part is certain; the rest is an inclusion probability p
with which one more copy is drawn: documents are ranked by (u / (1 - u)) / (p / (1 - p)) for a random u that depends on
the identifier and the seed alone, and the lowest ranked are taken until the source's words are used up.  So reruns
agree and each source ends within half a document of its target.

The running sum that finds the end of a draw is cut into ``BUCKETS`` buckets of the ranking variable per source, so no
source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count, written

BUCKETS = 2048
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and a document, is used so many times at most.
REPEATS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Words to take of each source.  sizes: source, source_size (one row each).  Adds target, double.

    The sources, by code point with null last, weigh ``weights`` repeating, and share the sum of all sizes.  A target
    stops at ``repeats`` times its source's size, and the excess is shared by weight among the others, again and
    again.  That is one water level: sources are taken by rising ceiling per weight, and each is full if its share of
    what the fuller ones leave exceeds its ceiling.  Works on a row per source, in one task.
    """
    everything = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(nth, F.lit(len(weights))).cast("int") + 1)
    rising = Window.orderBy(F.col("ceiling") / F.col("weight"), "nth")
    filled = (
        sizes.select("source", "source_size", nth.alias("nth"), weight.cast("long").alias("weight"))
        .withColumn("ceiling", F.col("source_size") * repeats)
        .withColumn("left", F.sum("source_size").over(everything) - F.sum("ceiling").over(rising.rowsBetween(Window.unboundedPreceding, 0)) + F.col("ceiling"))
        .withColumn("level", F.try_divide(F.col("left"), F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))))
        .withColumn("full", F.col("ceiling") <= F.col("level") * F.col("weight"))
        .withColumn("water", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(F.col("water") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def uniform(id_col: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 for each identifier."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    preference: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: id_col, source, size, source_size, target, copies, taken (= copies * size).

    size: words of the whole text (null: 0).  preference: how much likelier a document is than others of its source;
    None means alike.  Expected copies are the source's target over its size, times the preference over the source's
    mean preference by words, at most ``repeats``.  Null or negative preferences count as 0.  A null source is a
    source of its own.  Documents without words take no words.  Repeated rows are drawn like other rows; those with
    equal identifiers rank together.  Columns other than those named are not read.
    """
    prefer = F.lit(1.0) if preference is None else F.greatest(F.coalesce(preference.cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), prefer.alias("prefer")), "mixing")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("prefer")).alias("preferred"))
    goals = targets(by_source.select("source", "source_size"), weights, repeats).withColumnRenamed("source", "of")
    goals = goals.join(by_source.select(F.col("source").alias("also"), "preferred"), F.col("of").eqNullSafe(F.col("also"))).drop("also")
    goals = written(goals, "mixing-goals")  # a row per source, used several times

    if preference is None:
        expected = F.try_divide(F.col("target"), F.col("source_size"))
    else:
        expected = F.try_divide(F.col("target") * F.col("prefer"), F.col("preferred"))
    planned = (
        sized.join(goals, F.col("source").eqNullSafe(F.col("of")), "left")
        .withColumn("expected", F.least(F.coalesce(expected, F.lit(0.0)), F.lit(float(repeats))))
        .withColumn("certain", F.floor("expected"))
        .withColumn("chance", F.col("expected") - F.col("certain"))
        .withColumn("draws", (F.col("chance") > 0) & (F.col("size") > 0))
        .select("id", "source", "size", "source_size", "target", "certain", "chance", "draws")
    )
    if preference is None:
        certain_words = goals.select("of", (F.col("target") - F.floor(expected) * F.col("source_size")).alias("rest"))
    else:
        certain_words = planned.groupBy(F.col("source").alias("of")).agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("rest"))

    u = uniform(F.col("id"), seed)
    odds = F.col("chance") / (1 - F.col("chance"))
    ranked = planned.where("draws").withColumn("rank", u / (1 - u) / odds)
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS), F.lit(BUCKETS - 1)))
    buckets = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), (F.sum("words").over(along) - F.col("words")).alias("before"))
    starts = starts.join(certain_words, F.col("b_source").eqNullSafe(F.col("of"))).drop("of")

    within = Window.partitionBy("source", "bucket").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = (
        ranked.withColumn("upto", F.sum("size").over(within))
        .join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left")
        .withColumn("extra", (F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long"))
    )
    rest = planned.where(~F.col("draws")).withColumn("extra", F.lit(0).cast("long"))
    columns = ["id", "source", "size", "source_size", "target", "certain", "extra"]
    return (
        drawn.select(columns)
        .unionByName(rest.select(columns))
        .select(
            F.col("id").alias(id_col),
            "source",
            "size",
            "source_size",
            "target",
            (F.col("certain") + F.col("extra")).alias("copies"),
            ((F.col("certain") + F.col("extra")) * F.col("size")).alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", preference: Column | None = None, repeats: int = REPEATS, **names) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (not at all, or up to ``repeats`` times), with all their columns.

    Rows that repeat an identifier are drawn one by one; those that also repeat text and source are drawn alike, and which
    of them is taken is left open.  A null identifier or source is a value of its own; texts without words are
    taken as often as is certain.  Texts of any length count whole.  An empty table gives an empty result.
    """
    parts = {"id": F.col(id_col), "content": F.xxhash64(text_col), "source": F.col(source_col)}
    asked = docs.select(F.struct(*[c.alias(n) for n, c in parts.items()]).alias("key"), parts["source"], F.col(text_col).alias("text"), (F.lit(None) if preference is None else preference).cast("double").alias("prefer"))
    draws = mixed(asked, "key", preference=None if preference is None else F.col("prefer"), repeats=repeats, **names).where("copies > 0")
    # Of the rows of a key, so many are taken once at least, twice at least, and so on; that is all that meets the texts, which are dealt out once.
    draws = draws.groupBy(F.col("key").alias("drawn")).agg(*[F.count_if(F.col("copies") >= n).alias(f"taken_{n}") for n in range(1, repeats + 1)])
    key = F.struct(*[c.alias(n) for n, c in parts.items()]).cast(draws.schema["drawn"].dataType)  # of one type, so join and window share an exchange
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    copies = sum((F.when(F.col("nth") <= F.col(f"taken_{n}"), 1).otherwise(0) for n in range(1, repeats + 1)), F.lit(0))
    taken = rows.join(draws, F.col("key") == F.col("drawn")).withColumn("nth", nth).withColumn("copies", copies).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
