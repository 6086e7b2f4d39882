"""Ordered operators: gaps, drops, comparisons with the row before, as-of values, capped and sampled lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.sources.storage import kept


def with_gap(rows: DataFrame, key: str | list[str], time: str, *order: str) -> DataFrame:
    """Adds ``gap``: seconds since the row before of the same key, 0 for the first."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("gap", F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0)))


#: Ranges of time that a running maximum is worked out in, side by side.
RANGES = 1024


def running_gaps(rows: DataFrame, key: str, start: str, end: str, least: float) -> DataFrame:
    """Rows that start more than ``least`` after the latest end of all rows of their key before them, with that ``gap``.

    Time is cut into RANGES: the latest end of each (a row for each key and range) is carried into those after
    it, and rows are ordered within their range alone, so no task gets all rows of a key. Rows without a start
    or a key have no gap.
    """
    known = rows.where(F.col(start).isNotNull() & F.col(key).isNotNull())
    bounds = known.agg(F.min(start).alias("_lo"), F.max(start).alias("_hi"))
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col(start) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    placed = known.crossJoin(F.broadcast(bounds)).withColumn("_range", F.floor(share * RANGES).cast("int")).drop("_lo", "_hi")
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(F.col(key).alias("_key"), "_range").agg(F.max(end).alias("_end"))
    carried = ends.select("_key", F.col("_range").alias("_at"), F.max("_end").over(before).alias("_carried"))
    own = Window.partitionBy(key, "_range").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.withColumn("_own", F.max(end).over(own)).join(carried, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_at")))
    found = joined.withColumn("gap", F.col(start) - F.greatest("_own", "_carried")).where(F.col("gap") > least)
    return found.select(*rows.columns, "gap")


def ranked(rows: DataFrame, key: str, value: str, **ranks: Column) -> DataFrame:
    """One row per key, null too: the value at each of the named ranks, from 1 in ascending order, without nulls.

    Ranks are long columns of ``n``, the count of the key's values; null where there is none. Distinct values are
    counted and dealt out by ranges; sums of whole ranges tell the one that holds a rank, and rows are ordered within
    that alone. So no task gets all values of a key.
    """
    filled = rows.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    counts = filled.where("_value is not null").groupBy("_key", "_value").agg(F.count("*").alias("_n"))
    counts = kept(counts.repartitionByRange("_key", "_value").withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = counts.groupBy("_key", "_range").agg(F.sum("_n").alias("_n"))
    before, all_ = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_key")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), rank.alias("_rank")) for name, rank in ranks.items()]))
    at = (
        ranges.select("_key", "_range", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(all_).alias("n"))
        .select("_key", "_range", "_n", "_before", wanted.alias("_w")).select("_key", "_range", "_n", "_w._name", (F.col("_w._rank") - F.col("_before")).alias("_left"))
        .where("_left between 1 and _n")
    )
    at = F.broadcast(at.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), "_name", "_left"))
    near = counts.join(at, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    last = F.sum("_n").over(Window.partitionBy("_key", "_range", "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_last", last).where((F.col("_left") <= F.col("_last")) & (F.col("_left") > F.col("_last") - F.col("_n")))
    # a key without values keeps its row
    both = found.select("_key", "_name", "_value").unionByName(filled.select("_key").distinct(), allowMissingColumns=True)
    return both.groupBy(F.col("_key").alias(key)).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in ranks])


def rank_of(percent: int) -> Column:
    """The nearest rank of a percentile among ``n`` values."""
    return F.greatest(F.expr(f"({percent} * n + 99) div 100"), F.lit(1).cast("long"))


def drops(rows: DataFrame, key: str, value: str, share: float = 0.35) -> DataFrame:
    """Rows whose value is under ``share`` of the median of their key's positive values, with that ``baseline``."""
    base = rows.where(F.col(value) > 0).groupBy(key).agg(F.median(value).alias("baseline"))
    return rows.join(base, key).where(F.col(value) < F.col("baseline") * share)


def relative_anomaly(rows: DataFrame, key: str, order: str, falling: tuple[str, ...], rising: tuple[str, ...]) -> DataFrame:
    """Adds ``anomalous``: a falling value under half, or a rising one over twice, that of the key's median or of the row before."""
    medians = rows.groupBy(key).agg(*[F.median(v).alias(f"_median_{v}") for v in (*falling, *rising)])
    w = Window.partitionBy(key).orderBy(order)
    found = F.lit(False)
    for value in (*falling, *rising):
        for base in (F.col(f"_median_{value}"), F.lag(value).over(w)):
            worse = F.col(value) < base * 0.5 if value in falling else F.col(value) > base * 2
            found = found | F.coalesce((base > 0) & worse, F.lit(False))
    return rows.join(medians, key).withColumn("anomalous", found).drop(*[f"_median_{v}" for v in (*falling, *rising)])


def as_of(rows: DataFrame, key: str | list[str], value: Column, name: str, *order: str) -> DataFrame:
    """Adds the latest value that isn't null up to and with each row."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def capped(rows: DataFrame, kind: str, most_of_kind: int, most: int, *order: str) -> DataFrame:
    """The first ``most_of_kind`` rows of each kind, and of these the first ``most``.

    The second cap sees at most ``most_of_kind`` rows per kind.
    """
    per_kind = Window.partitionBy(kind).orderBy(*order)
    kept = rows.withColumn("_n", F.row_number().over(per_kind)).where(F.col("_n") <= most_of_kind).drop("_n")
    return kept.orderBy(*order).limit(most)


def _end_rows(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], most: int, last: bool) -> DataFrame:
    """The first, or last, ``most`` rows of each group with their place from that end; tasks drop the others before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() if last else F.col(o).asc() for o in order])
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)


def _joined_by(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    same = [rows[k].eqNullSafe(facts[k]) for k in keys]
    return rows.join(facts, reduce(Column.__and__, same) if same else F.lit(True)).drop(*[facts[k] for k in keys])


def head_tail(rows: DataFrame, n: int, keys: tuple[str, ...], *order: str) -> DataFrame:
    """The first ceil(n / 2) and last floor(n / 2) rows of each group, or all if there are no more than n."""
    head, tail = -(-n // 2), n // 2
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    last = _joined_by(_end_rows(rows, keys, order, tail, True), counts, keys).where(F.col("_place") <= F.col("_n") - head)
    return _end_rows(rows, keys, order, head, False).drop("_place").unionByName(last.drop("_place", "_n"))


def bounded_series(rows: DataFrame, anomalous: str, most: int, *order: str) -> DataFrame:
    """At most ``most`` rows of a series: anomalous ones first, a tenth kept for normal ones if both crowd in; ends before middles."""
    counts = rows.agg(F.count_if(anomalous).alias("_a"), F.count_if(~F.col(anomalous)).alias("_n"))
    reserve = F.when(
        (F.col("_a") > 0) & (F.col("_n") > 0) & (F.col("_a") >= most), F.least(F.col("_n"), F.lit(max(1, most // 10)))
    ).otherwise(0)
    budgets = counts.withColumn("_for_a", F.least(F.col("_a"), most - reserve)).withColumn("_for_n", F.least(F.col("_n"), most - F.col("_for_a")))
    budget, total = F.when(F.col(anomalous), F.col("_for_a")).otherwise(F.col("_for_n")), F.when(F.col(anomalous), F.col("_a")).otherwise(F.col("_n"))

    def ends(last: bool) -> DataFrame:
        found = _end_rows(rows, (anomalous,), order, most, last).crossJoin(F.broadcast(budgets))
        half = F.least(F.floor(budget / 2), total - F.ceil(budget / 2)) if last else F.ceil(budget / 2)
        return found.where(F.col("_place") <= half).select(*rows.columns)

    return ends(False).unionByName(ends(True))


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """The last row of each key: the state behind an event log, or an upsert by key."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_n(rows: DataFrame, key: str, n: int, order: str) -> DataFrame:
    """The last ``n`` rows of each key, and ``earlier``, how many came before them."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    total = Window.partitionBy(key)
    return (
        rows.withColumn("_n", F.row_number().over(w)).withColumn("earlier", F.greatest(F.count("*").over(total) - n, F.lit(0)))
        .where(F.col("_n") <= n).drop("_n")
    )


def tiered_match(left: DataFrame, right: DataFrame, order: str, tiers: list[list[str]], nullable: set[str], name: str) -> DataFrame:
    """``left`` with the number of the first tier that an earlier ``right`` row meets, or null.

    A tier is a list of columns that both have and that must be equal; nulls are equal in ``nullable``
    ones only. Any earlier row will do, so each tier joins the first row of its combination: an
    equi-join with at most one partner, however many rows share a key.
    """
    met = F.lit(None).cast("int")
    out = left
    for k, keys in reversed(list(enumerate(tiers, 1))):
        needed = [c for c in keys if c not in nullable]
        first = right.dropna(subset=needed).groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min(order).alias(f"_first{k}"))
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
        out = out.join(first, same, "left").drop(*[f"_{c}" for c in keys])
        met = F.when(F.col(f"_first{k}") < F.col(order), k).otherwise(met)
    return out.select(*left.columns, met.alias(name))
