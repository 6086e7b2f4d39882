"""Evidence queries: whitelisted predicates and projections compiled to columns, total orders, pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.functions.network import parse_flow_id

#: Public field names and their columns.
EVENT_COLUMNS = {
    "evidence_id": "evidence_id", "event_type": "event_type", "frame.number": "frame_number",
    "frame.time_relative": "time_relative", "flow_id": "flow_id", "direction": "direction", "tcp.seq": "tcp_seq",
    "tcp.ack": "tcp_ack", "tcp.window_size": "tcp_window_size", "tcp.len": "tcp_len", "tcp.analysis.ack_rtt": "ack_rtt",
}
#: Requested types that stand for stored ones.
TYPE_ALIASES = {
    "retransmissions": ("retransmission", "fast_retransmission"), "duplicate_acks": ("duplicate_ack",),
    "window_changes": ("zero_window", "window_full"), "out_of_order_segments": ("out_of_order",),
}
MAX_PREDICATES, MAX_VALUES, MAX_FLOWS, MAX_LIMIT = 16, 32, 32, 500
_COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}


class InvalidQuery(ValueError):
    """A query outside the whitelist or the bounds."""


@dataclass(frozen=True)
class Predicate:
    field: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class EvidenceQuery:
    """A validated request. ``null_safe``: ``ne`` keeps rows whose field is null, as packet scans do."""

    fields: Sequence[str] = tuple(EVENT_COLUMNS)
    predicates: Sequence[Predicate] = ()
    types: Sequence[str] = ()
    flow_ids: Sequence[str] = ()
    start: float | None = None
    end: float | None = None
    offset: int = 0
    limit: int = 100
    null_safe: bool = False
    columns: Mapping[str, str] = field(default_factory=lambda: EVENT_COLUMNS)

    def __post_init__(self) -> None:
        unknown = [f for f in [*self.fields, *(p.field for p in self.predicates)] if f not in self.columns]
        if unknown:
            raise InvalidQuery(f"unknown field {unknown[0]!r}")
        if not self.fields or len(set(self.fields)) != len(self.fields):
            raise InvalidQuery("fields must be given once each")
        if len(self.predicates) > MAX_PREDICATES or len(self.flow_ids) > MAX_FLOWS:
            raise InvalidQuery("too many predicates or flows")
        for p in self.predicates:
            if p.operator not in {*_COMPARE, "in", "exists"}:
                raise InvalidQuery(f"unknown operator {p.operator!r}")
            if p.operator == "in" and not (isinstance(p.value, list | tuple) and 0 < len(p.value) <= MAX_VALUES):
                raise InvalidQuery("in needs a list of 1 to 32 values")
            if p.operator == "exists" and not isinstance(p.value, bool):
                raise InvalidQuery("exists needs true or false")
        if self.start is not None and self.end is not None and self.start > self.end:
            raise InvalidQuery("start is after end")
        if not 1 <= self.limit <= MAX_LIMIT or self.offset < 0:
            raise InvalidQuery("limit must be 1 to 500 and offset 0 or more")


def compiled(p: Predicate, columns: Mapping[str, str], null_safe: bool = False) -> Column:
    """The condition of one predicate."""
    column = F.col(f"`{columns[p.field]}`")
    if p.operator == "in":
        return column.isin(list(p.value))
    if p.operator == "exists":
        return column.isNotNull() if p.value else column.isNull()
    if p.operator == "ne" and null_safe:
        return ~column.eqNullSafe(p.value)
    return _COMPARE[p.operator](column, p.value)


def stored_types(types: Sequence[str]) -> list[str]:
    """Requested types with aliases put in place, each once, in order."""
    return list(dict.fromkeys(t for name in types for t in TYPE_ALIASES.get(name, (name,))))


def matching(events: DataFrame, query: EvidenceQuery) -> DataFrame:
    """The rows that a query asks for; conditions reach the scan."""
    out = events
    for p in query.predicates:
        out = out.where(compiled(p, query.columns, query.null_safe))
    if query.types:
        out = out.where(F.col(query.columns["event_type"]).isin(stored_types(query.types)))
    if query.flow_ids:
        out = out.where(F.col(query.columns["flow_id"]).isin(list(query.flow_ids)))
    time = F.col(query.columns["frame.time_relative"]) if "frame.time_relative" in query.columns else None
    if query.start is not None:
        out = out.where(time >= query.start)
    if query.end is not None:
        out = out.where(time <= query.end)
    return out


def evidence_order(query: EvidenceQuery) -> list[Column]:
    """Time, then frame, nulls last, then id: a total order."""
    c = query.columns
    return [F.col(c["frame.time_relative"]).asc_nulls_last(), F.col(c["frame.number"]).asc_nulls_last(), F.col(c["evidence_id"]).asc()]


def page(events: DataFrame, query: EvidenceQuery) -> tuple[DataFrame, DataFrame]:
    """(rows of the page, one row of total, next_offset and truncated)."""
    found = matching(events, query)
    rows = found.orderBy(*evidence_order(query)).offset(query.offset).limit(query.limit)
    shown = rows.select(*[F.col(f"`{query.columns[f]}`").alias(f) for f in query.fields])
    end = query.offset + query.limit
    facts = found.agg(F.count("*").alias("total")).select(
        "total", F.when(F.col("total") > end, end).alias("next_offset"), (F.col("total") > end).alias("truncated")
    )
    return shown, facts


def lower_bound_page(events: DataFrame, query: EvidenceQuery) -> tuple[DataFrame, DataFrame]:
    """As ``page`` without counting all: total is what was needed to fill the page, exact only if no further row came."""
    end = query.offset + query.limit
    first = matching(events, query).orderBy(*evidence_order(query)).limit(end + 1)
    shown = first.orderBy(*evidence_order(query)).offset(query.offset).limit(query.limit)
    facts = first.agg(F.count("*").alias("n")).select(
        F.least("n", F.lit(end)).alias("total"), (F.col("n") <= end).alias("total_exact"), F.when(F.col("n") > end, end).alias("next_offset")
    )
    return shown.select(*[F.col(f"`{query.columns[f]}`").alias(f) for f in query.fields]), facts


def sorted_page(rows: DataFrame, allowed: Sequence[str], by: str, descending: bool, key: str, offset: int, limit: int) -> DataFrame:
    """A page by one of the allowed columns, ties by key."""
    if by not in allowed:
        raise InvalidQuery(f"cannot sort by {by!r}")
    column = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return rows.orderBy(column, key).offset(offset).limit(limit)


#: Parts of map keys whose values never leave the engine.
SENSITIVE = ("password", "secret", "token", "api_key", "authorization", "path")


def without_sensitive(values: Column) -> Column:
    """A map without keys that name something sensitive."""
    pattern = "(?i)" + "|".join(SENSITIVE)
    return F.map_filter(values, lambda k, _: ~k.rlike(pattern))


def evidence_layers(items: DataFrame, session: str, kind: str, page: str, place: str, layers: int = 8, most: int = 80) -> DataFrame:
    """The items of the ``layers`` types whose pages came last, and of these the last ``most``, for each session; with ``layer``, 1 for the newest type.

    ``page`` orders pages, ``place`` the items of one.
    """
    newest = items.groupBy(session, kind).agg(F.max(page).alias("_last"))
    rank = Window.partitionBy(session).orderBy(F.desc("_last"), kind)
    kept = newest.withColumn("layer", F.row_number().over(rank)).where(F.col("layer") <= layers).drop("_last")
    late = Window.partitionBy(session).orderBy(F.desc(page), F.desc(place))
    return items.join(kept, [session, kind]).withColumn("_n", F.row_number().over(late)).where(F.col("_n") <= most).drop("_n")


def distinct_requests(requests: DataFrame, session: str, seq: str, *asked: str) -> DataFrame:
    """The first of the requests of a session that ask the same, paging apart, with ``query_key``: the digest of what is asked."""
    marked = requests.withColumn("query_key", F.sha2(F.to_json(F.struct(*sorted(asked))), 256))
    w = Window.partitionBy(session, "query_key").orderBy(seq)
    return marked.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def filtered(rows: DataFrame, **allowed: Sequence[Any] | None) -> DataFrame:
    """Rows whose columns have one of the allowed values; None allows all, an empty list nothing."""
    for column, values in allowed.items():
        if values is not None:
            rows = rows.where(F.col(column).isin(list(values)))
    return rows


def sane_histogram(histogram: Column) -> Column:
    """The buckets of a histogram with a bound and a count that isn't negative."""
    return F.filter(histogram, lambda b: b["upper_bound_ms"].isNotNull() & (b["count"] >= 0))


def sane_flows(flows: DataFrame, *counts: str) -> DataFrame:
    """Flows with a printed id that parses; counts under 0 are null."""
    kept = flows.where(parse_flow_id(F.col("flow_id")).isNotNull())
    return kept.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in counts})
