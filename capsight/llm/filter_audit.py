"""Audit of how text filters interact: what each removes in every order, from one histogram of failure masks.

Each document gets a mask of the filters that it fails, one bit each. Whatever the order, what a
filter removes depends on masks alone, so a part's documents shrink to at most 32 cells, and all
orders are read off the cells. DataFrame functions only.

The filters: A, fewer than LEAST_WORDS words; B, distinct words under DISTINCT_PERCENT of the words;
C, capitals A-Z over CAPITAL_PERCENT of the code points; D, any of SIGNS; E, the same text under a
smaller doc_id.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm.spark import written

#: The filters in the order of their bits, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SIGNS = r"[#$%&*|]"
WHITE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(text: Column) -> Column:
    """The bits of A to D for a text that isn't null."""
    # Splitting leaves an empty piece where a text begins or ends with white signs: no word is empty.
    words = F.array_remove(F.split(text, WHITE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failures = {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SIGNS),
    }
    return sum((F.when(fails, _bit(letter)).otherwise(0) for letter, fails in failures.items()), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs``.

    A null text is empty; a null lang is the empty part. E compares texts by their SHA-256. A row
    fails it if a smaller doc_id has its text; a null doc_id is neither smaller nor fails, and rows
    that repeat one doc_id and text don't fail for each other. Other columns are not read.

    Texts are read once and don't leave their task. The smallest doc_id of a text meets its rows by
    (digest, doc_id), so copies of one text, however many, are dealt out like all other rows.
    """
    text = F.coalesce("text", F.lit(""))
    marked = written(
        docs.select(
            "doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("_mask"), F.unhex(F.sha2(text, 256)).alias("_digest")
        ),
        "masks",
    )
    firsts = marked.where("doc_id is not null").groupBy("_digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    copied = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    return marked.join(firsts, ["_digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("_mask") + F.when(copied, _bit("E")).otherwise(0)).alias("mask")
    )


def mask_histogram(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the cells of each part; documents labelled quality 1 and toxic 1 among them.

    A document with several label rows is good, or toxic, if one of them says so.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic")
    )
    return masks.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("good"), F.coalesce(F.sum("_toxic"), F.lit(0)).alias("toxic")
    )


def _steps() -> Column:
    """Every (filter_order, step, letter, its bit, bits of the filters before it) as one constant array."""
    found = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append({"filter_order": order, "step": step, "letter": letter, "bit": _bit(letter), "before": before})
            before |= _bit(letter)
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order:string,step:int,letter:string,bit:int,before:int>>")


def interactions(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of it, zeros included; from the cells of ``mask_histogram``.

    kept: documents that pass the filters up to this step; removed: those that fail its filter first
    here; redundant: those that fail it and were removed before; unique_fails: those that fail it
    alone; good_lost and toxic_lost: labelled ones among the removed; shapley: what the filter
    removes, summed over all orders.
    """
    fails = F.col("mask").bitwiseAND(F.col("s.bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("s.before")) != 0
    count = lambda condition, of="n": F.sum(F.when(condition, F.col(of)).otherwise(0))
    steps = cells.select("*", F.explode(_steps()).alias("s")).groupBy("part", "s.filter_order", "s.step", "s.letter").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == F.col("s.bit")).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"),
        count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # 120 rows of one part and filter, whatever the number of documents
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter")))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of all documents, by lang. An empty table gives an empty one."""
    return interactions(mask_histogram(failure_masks(docs), labels))
