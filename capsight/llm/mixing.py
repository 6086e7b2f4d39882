"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source has the same expected number of copies, target / source size. Prefix
sums of expected copies run through a source from its longest document to its shortest, one random
offset is added, and a document is emitted once for each integer boundary that its part of the sum
crosses. In that order what a source gives misses its target by about its longest document at most.

Expected copies are whole multiples of 2**-20, so sums are exact in any order and reruns agree.
The prefix sums come in two levels - cells of a size class (to an eighth) and a salt, in order
within the source, and documents within their cell - so no task holds more than one cell's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm.spark import written

UNIT = 1 << 20
SALTS = 1024
MOST = 3

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text: Column, modulus: int) -> Column:
    """A number below ``modulus`` from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(modulus)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of sizes. A target
    stops at MOST times its source's size and the excess is shared again by weight: with sources in
    order of cap / weight, the first whose share of what is left stays under its cap sets the share
    per weight of all later ones. Works on one row per source.
    """
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shares = weighed.withColumn("share", left / weight_left)
    level = F.min(F.when(F.col("ratio") > F.col("share"), F.struct("ratio", "source", "share"))).over(everything)["share"]
    return shares.withColumn("level", level).select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def mix(docs: DataFrame, seed: int = 1, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and ``carried`` columns) of every row of ``docs``.

    size is the text's number of words (null: 0), target its source's words in the mix, copies how
    often the mix takes the row (0 to MOST). Rows without words are never taken. A null source is a
    source; repeated rows are rows of their own and order among equal (size, doc_id) doesn't show;
    a null doc_id comes first. An empty table gives an empty one; columns not named are not read.
    """
    sized = written(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("_size"), *[F.col(c).alias(f"_carried_{c}") for c in carried]
        ),
        "sized",
    )
    totals = sized.groupBy("source").agg(F.sum("_size").alias("source_size"))
    unit = F.when(F.col("source_size") > 0, F.round(F.col("target") * UNIT / F.col("source_size"))).otherwise(F.lit(0.0))
    aimed = written(targets(totals).withColumn("_unit", unit.cast("long")).withColumnRenamed("source", "_source"), "targets")
    rows = sized.join(aimed, sized["source"].eqNullSafe(aimed["_source"])).drop("_source")
    names = ["doc_id", "source", F.col("_size").alias("size"), "source_size", "target", "copies"]
    names += [F.col(f"_carried_{c}").alias(c) for c in carried]
    return _taken(rows, seed).select(*names)


def _taken(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``copies``: the integer boundaries that each one's part of its source's prefix sum crosses."""
    bits = F.length(F.bin("_size"))
    size_class = bits * 16 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 4, 0))").cast("int")
    offset = _number(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit(""))), UNIT)
    rows = (
        rows.withColumn("_expected", F.when(F.col("_size") > 0, F.col("_unit")).otherwise(F.lit(0)))
        .withColumn("_class", size_class)
        .withColumn("_salt", _number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), SALTS))
        # what joins and windows go by: null sources are a group like any other
        .withColumn("_group", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    )
    cell = ["_group", "_class", "_salt"]
    before = Window.partitionBy("_group").orderBy(F.desc("_class"), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*cell).agg(F.sum("_expected").alias("_sum"))
        .select(*cell, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    )
    in_cell = Window.partitionBy(*cell).orderBy(F.desc("_size"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_start") + F.sum("_expected").over(in_cell) + offset
    crossed = F.floor(F.col("_end") / UNIT) - F.floor((F.col("_end") - F.col("_expected")) / UNIT)
    return rows.join(starts, cell).withColumn("_end", end).withColumn("copies", crossed.cast("long"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, numbered from 1 in ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
