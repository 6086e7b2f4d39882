"""Retrieval quality: rank metrics, groupings, gates, reranker outcomes, judges, coverage assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.functions.texts import states_fact

CUTS = (5, 8, 20)


def _dcg(grade: Column, rank: Column, most: int) -> Column:
    return F.sum(F.when(rank <= most, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)).otherwise(0.0))


def case_metrics(ranking: DataFrame, labels: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per case: recall, hit and NDCG at each cut, reciprocal rank at 20, first relevant rank, counts.

    ``ranking``: keys, item, rank from 1. ``labels``: keys, item, grade above 0. Cases are those with
    labels; a case without a ranking scores 0.
    """
    ideal_order = Window.partitionBy(*keys).orderBy(F.col("grade").desc(), item)
    ideal = labels.withColumn("_ideal", F.row_number().over(ideal_order))
    found = ideal.join(ranking.select(*keys, item, "rank"), [*keys, item], "left")
    rank = F.col("rank")
    out = [F.count("*").alias("n_relevant"), F.min(F.when(rank <= 20, rank)).alias("first_rank")]
    for k in CUTS:
        out += [
            (F.count_if(rank <= k) / F.count("*")).alias(f"recall_{k}"), F.coalesce(F.max((rank <= k).cast("int")), F.lit(0)).alias(f"hit_{k}"),
            (F.coalesce(_dcg(F.col("grade"), rank, k), F.lit(0.0)) / _dcg(F.col("grade"), F.col("_ideal"), k)).alias(f"ndcg_{k}"),
        ]
    out.append(F.count_if(rank <= 20).alias("found_20"))
    return found.groupBy(*keys).agg(*out).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def class_metrics(ranking: DataFrame, cases: DataFrame, items: DataFrame, case: str, item: str, kind: str) -> DataFrame:
    """``case_metrics`` where all items of a case's kind are relevant to it, but for the item of the case's own key.

    ``cases``: case, kind. ``items``: item, kind, grade above 0, one row an item. Counts and best grades come from one row
    a kind, so cases are never paired with all of their items.
    """
    most = max(CUTS)
    by_grade = Window.partitionBy(kind).orderBy(F.col("grade").desc())
    best = items.where(F.col(kind).isNotNull()).withColumn("_place", F.row_number().over(by_grade)).where(F.col("_place") <= most + 1)
    best = best.groupBy(kind).agg(F.reverse(F.array_sort(F.collect_list("grade"))).alias("_best"))
    facts = items.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("_items")).join(best, kind)
    own = items.select(F.col(item).alias(case), F.col(kind).alias("_own"), F.col("grade").alias("_grade"))
    known = cases.join(F.broadcast(facts), kind).join(own, case, "left")
    mine = F.coalesce(F.col("_own") == F.col(kind), F.lit(False))
    at = F.array_position("_best", F.col("_grade"))
    rest = F.when(mine & (at > 0), F.concat(F.expr("slice(_best, 1, int(array_position(_best, _grade)) - 1)"), F.expr(f"slice(_best, int(array_position(_best, _grade)) + 1, {most})"))).otherwise(F.col("_best"))
    ideal = known.select(case, kind, (F.col("_items") - mine.cast("int")).alias("n_relevant"), rest.alias("_ideal")).where("n_relevant > 0")
    hits = ranking.where(F.col("rank") <= most).join(items.select(item, F.col(kind).alias("_kind"), "grade"), item).where(F.col(item) != F.col(case))
    hits = hits.join(cases, case).where(F.col("_kind") == F.col(kind))
    rank = F.col("rank")
    facts_of = [F.min("rank").alias("first_rank"), F.count("*").alias("found_20")]
    for k in CUTS:
        facts_of += [F.count_if(rank <= k).alias(f"_n_{k}"), _dcg(F.col("grade"), rank, k).alias(f"_dcg_{k}")]
    both = ideal.join(hits.groupBy(case).agg(*facts_of), case, "left")
    gain = lambda k: F.aggregate(
        F.transform(F.slice("_ideal", 1, k), lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 2.0)), F.lit(0.0), lambda a, x: a + x
    )
    out: list[Column] = [F.col("n_relevant"), F.col("first_rank")]
    for k in CUTS:
        found = F.coalesce(f"_n_{k}", F.lit(0))
        out += [(found / F.col("n_relevant")).alias(f"recall_{k}"), (found > 0).cast("int").alias(f"hit_{k}"), (F.coalesce(f"_dcg_{k}", F.lit(0.0)) / gain(k)).alias(f"ndcg_{k}")]
    out.append(F.coalesce("found_20", F.lit(0)).alias("found_20"))
    return both.select(case, *out).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def summarised(cases: DataFrame, *groups: str, digits: int = 6) -> DataFrame:
    """Means of the case metrics, recall over all labels, and the share of cases that found nothing."""
    names = [f"{m}_{k}" for k in CUTS for m in ("recall", "hit", "ndcg")] + ["reciprocal_rank"]
    return cases.groupBy(*groups).agg(
        F.count("*").alias("n_cases"), *[F.round(F.avg(n), digits).alias(n) for n in names],
        F.round(F.sum("found_20") / F.sum("n_relevant"), digits).alias("micro_recall_20"),
        F.round(F.avg((F.col("found_20") == 0).cast("int")), digits).alias("no_result_rate"),
    )


def by_each_dimension(rows: DataFrame, dimensions: list[str], *aggregates: Column) -> DataFrame:
    """(dimension, value, aggregates): each dimension grouped on its own, in one pass over the rows."""
    long = rows.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])))
    return long.groupBy(F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*aggregates)


def gates(metrics: DataFrame, policy: DataFrame) -> DataFrame:
    """Each policy row (metric, kind, threshold, blocking) with the metric's value and whether it passes.

    ``metrics``: metric, value, baseline. kind: min, exclusive_min, max, regression (value may fall short of
    the baseline by the threshold). A missing value fails.
    """
    value, limit = F.col("value"), F.col("threshold")
    ok = (
        F.when(F.col("kind") == "min", value >= limit).when(F.col("kind") == "exclusive_min", value > limit)
        .when(F.col("kind") == "max", value <= limit).when(F.col("kind") == "regression", value >= F.col("baseline") - limit)
    )
    return policy.join(metrics, "metric", "left").withColumn("passed", F.coalesce(ok, F.lit(False)))


def verdict(gate_rows: DataFrame) -> DataFrame:
    """One row: whether all blocking gates pass, and how many of all."""
    return gate_rows.agg(
        F.coalesce(F.bool_and(F.col("passed") | ~F.col("blocking")), F.lit(True)).alias("released"),
        F.count_if("passed").alias("n_passed"), F.count("*").alias("n_gates"),
    )


def rerank_outcome(before: Column, after: Column, degraded: Column) -> Column:
    """improved, unchanged, regressed or degraded, from the first relevant ranks; over 20 or none counts as 21."""
    a = F.coalesce(F.when(before <= 20, before), F.lit(21))
    b = F.coalesce(F.when(after <= 20, after), F.lit(21))
    return F.when(degraded, "degraded").when(b < a, "improved").when(b > a, "regressed").otherwise("unchanged")


def merged_judgements(rows: DataFrame, *keys: str) -> DataFrame:
    """Repeated judgements (score, passed, violations, cost) of one answer: least score, all passed, all violations, disagreement."""
    return rows.groupBy(*keys).agg(
        F.min("score").alias("score"), F.bool_and("passed").alias("passed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("violations")))).alias("violations"),
        (F.count_distinct("passed") > 1).alias("uncertain"), F.sum("cost").alias("cost"), F.count("*").alias("n_judgements"),
    )


def agreement(labels: DataFrame, results: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: labelled cases that were judged, and the share of equal values per column."""
    right = results.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return labels.join(right, key).agg(
        F.count("*").alias("n_cases"), *[F.avg(F.col(c).eqNullSafe(F.col(f"_{c}")).cast("int")).alias(f"{c}_agreement") for c in columns]
    )


def uncovered(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """Keys on one side only, with ``missing_from``: empty if two tables cover the same cases."""
    a, b = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("missing_from", F.lit("actual")).union(
        b.join(a, list(keys), "left_anti").withColumn("missing_from", F.lit("expected"))
    )


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: a table with rows here must not be published."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_none(rows: DataFrame, message: str) -> None:
    """Fails if there is a row; looks no further than the first."""
    found = rows.head()
    if found is not None:
        raise ValueError(f"{message}: {found.asDict()}")


# --- answers ----------------------------------------------------------------------------------

def context_retention(final: DataFrame, labels: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One row: relevant items, those of them in the final context, and their share over all cases; 0 without any."""
    shown = final.select(*keys, item).distinct().withColumn("_kept", F.lit(1))
    both = labels.select(*keys, item).distinct().join(shown, [*keys, item], "left")
    facts = both.agg(F.count("*").alias("relevant"), F.count("_kept").alias("retained"))
    return facts.withColumn("retention", F.when(F.col("relevant") > 0, F.col("retained") / F.col("relevant")).otherwise(0.0))


def class_retention(final: DataFrame, cases: DataFrame, items: DataFrame, keys: list[str], item: str, kind: str) -> DataFrame:
    """``context_retention`` where all items of a case's kind are relevant to it: these are counted by kind, not paired with the case.

    ``cases``: keys, kind. ``items``: item, kind.
    """
    asked, known = cases.where(F.col(kind).isNotNull()).distinct(), items.where(F.col(kind).isNotNull()).distinct()
    relevant = asked.join(F.broadcast(known.groupBy(kind).agg(F.count("*").alias("_n"))), kind).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("relevant"))
    kept = final.select(*keys, item).distinct().join(known, item).join(asked, [*keys, kind])
    both = relevant.crossJoin(F.broadcast(kept.agg(F.count("*").alias("retained"))))
    return both.withColumn("retention", F.when(F.col("relevant") > 0, F.col("retained") / F.col("relevant")).otherwise(0.0))


def call_totals(traces: DataFrame, calls: str) -> DataFrame:
    """(provider, calls): the sums of a map of calls by provider, over all traces."""
    return traces.select(F.explode(calls).alias("provider", "n")).groupBy("provider").agg(F.sum("n").cast("long").alias("calls"))


def _plain(values: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))))


def coverage(expected: Column, observed: Column) -> Column:
    """The share of the expected texts, case apart, that were observed; 1 if none is expected."""
    wanted = _plain(expected)
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, _plain(observed))) / F.size(wanted))


def case_rates(cases: DataFrame) -> DataFrame:
    """One row over cases (ranked, relevant, applicable, citations: arrays of ids; expected, baseline, observed, forbidden: arrays of texts):
    citation and applicability accuracy, coverage of causes with and without retrieval, unsupported conclusions.

    Only the first five of ``ranked`` count. Where no applicable ids are given, the relevant ones are.
    """
    hits = F.array_intersect(F.slice("ranked", 1, 5), F.col("relevant"))
    applicable = F.when(F.size(F.coalesce("applicable", F.array().cast(cases.schema["relevant"].dataType))) > 0, F.col("applicable")).otherwise(F.col("relevant"))
    cited = F.filter("citations", lambda x: F.array_contains(F.col("relevant"), x))
    share = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b)).otherwise(0.0)
    rows = cases.select(
        F.size(cited).alias("cited"), F.size("citations").alias("citations"), F.size(F.array_intersect(hits, applicable)).alias("fitting"), F.size(hits).alias("hits"),
        coverage(F.col("expected"), F.col("baseline")).alias("before"), coverage(F.col("expected"), F.col("observed")).alias("after"),
        F.size(F.array_intersect(_plain(F.col("forbidden")), _plain(F.col("observed")))).alias("unsupported"), F.size(_plain(F.col("observed"))).alias("concluded"),
    )
    return rows.agg(
        F.count("*").alias("n_cases"), share("cited", "citations").alias("citation_accuracy"), share("fitting", "hits").alias("applicability_accuracy"),
        F.avg("before").alias("baseline_coverage"), F.avg("after").alias("coverage"), (F.avg("after") - F.avg("before")).alias("coverage_delta"),
        share("unsupported", "concluded").alias("unsupported_rate"),
    )


#: The checks of an answer, in order.
CHECKS = (
    "citations_exist", "citations_in_context", "citations_approved", "facts_covered", "causes_covered", "forbidden_absent", "structure_complete", "claims_consistent",
)


def answer_checks(cases: DataFrame, claim: str) -> DataFrame:
    """``cases`` with a boolean for each of CHECKS, and ``passed``.

    Columns: answer; citations, context, approved (arrays of ids); facts, causes, forbidden, limitations, suggestions
    (arrays of texts). ``claim``: the wording by which an answer says that it rests on retrieved knowledge. A null
    list of citations, limitations or suggestions is an incomplete structure; other null lists are empty.
    """
    ids, words = (F.array().cast(cases.schema[c].dataType) for c in ("context", "facts"))
    cited, shown, approved = (F.coalesce(F.col(c), ids) for c in ("citations", "context", "approved"))
    states = lambda column: F.transform(F.coalesce(F.col(column), words), lambda x: states_fact(F.coalesce("answer", F.lit("")), x))
    has_context = F.size(shown) > 0
    checks = (
        F.when(has_context, F.size(cited) > 0).otherwise(F.size(cited) == 0), F.size(F.array_except(cited, shown)) == 0, F.size(F.array_except(cited, approved)) == 0,
        F.forall(states("facts"), lambda x: x), F.forall(states("causes"), lambda x: x), ~F.exists(states("forbidden"), lambda x: x),
        F.col("citations").isNotNull() & F.col("limitations").isNotNull() & F.col("suggestions").isNotNull(), has_context | ~F.coalesce(F.col("answer").rlike(claim), F.lit(False)),
    )
    marked = cases.select("*", *[check.alias(name) for name, check in zip(CHECKS, checks, strict=True)])
    return marked.withColumn("passed", reduce(Column.__and__, [F.col(c) for c in CHECKS]))
