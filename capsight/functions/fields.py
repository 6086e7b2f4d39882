"""Column expressions for text fields: parsing, cleaning, flags, buckets, hosts, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds in milliseconds of the round-trip-time histogram; the last one is open.
RTT_BOUNDS_MS = (1.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, float("inf"))
#: Second-level labels under which a two-letter country domain sells names.
SHARED_SECOND_LEVELS = ("com", "net", "org", "co")


def blank_to_null(text: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def strict_long(text: Column) -> Column:
    """A whole number; a malformed one fails the job."""
    return F.trim(text).cast("long")


def lenient_long(text: Column) -> Column:
    """A whole number, or null."""
    return F.trim(text).try_cast("long")


def clamped_long(text: Column) -> Column:
    """A whole number from 0 up; 0 for anything else."""
    return F.greatest(F.lit(0).cast("long"), F.coalesce(lenient_long(text), F.lit(0)))


def finite_double(text: Column) -> Column:
    """A finite number, or null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def clamped_double(text: Column) -> Column:
    """A number from 0 up, infinity included; 0 for what is no number."""
    return F.greatest(F.lit(0.0), F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0)))


def is_marked(text: Column) -> Column:
    """Analysis marker: set unless empty, 0, false or no."""
    return ~F.lower(F.trim(F.coalesce(text, F.lit("")))).isin("", "0", "false", "no")


def is_present(text: Column) -> Column:
    """Presence marker: set if there is any text."""
    return F.coalesce(text, F.lit("")) != ""


def is_nonzero(text: Column) -> Column:
    """Loose marker: set unless empty or 0."""
    return ~F.coalesce(text, F.lit("")).isin("", "0")


def first_filled(*texts: Column) -> Column:
    """The first text that isn't empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def comma_list(text: Column) -> Column:
    """The trimmed, non-empty parts of a comma-separated list."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def bounded(text: Column, n: int) -> Column:
    """Trimmed text of at most ``n`` characters."""
    return F.substring(F.trim(text), 1, n)


def hostname(text: Column) -> Column:
    """A host name in lower case without closing dots; empty if it has other signs than names may have."""
    name = F.lower(F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 253))
    name = F.regexp_replace(name, r"\.+$", "")
    return F.when(name.rlike("^[a-z0-9._-]+$"), name).otherwise("")


def domain_family(host: Column) -> Column:
    """The registrable part of a host: two labels, or three under shared second levels of country domains."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    country = (F.length(F.get(labels, n - 1)) == 2) & F.get(labels, n - 2).isin(*SHARED_SECOND_LEVELS)
    keep = F.when((n >= 3) & country, 3).otherwise(2)
    return F.when(n <= 2, host).otherwise(F.array_join(F.slice(labels, n - keep + 1, keep), "."))


def host_matches(host: Column, suffix: Column) -> Column:
    """The host is the suffix, or ends with it after a dot."""
    return (host == suffix) | F.endswith(host, F.concat(F.lit("."), suffix))


def interval_start(seconds: Column, width: float) -> Column:
    """The start of the interval that holds a time."""
    return F.floor(seconds / width) * width


def megabits_per_second(n_bytes: Column, seconds: Column) -> Column:
    """Throughput; 0 without duration."""
    return F.when(seconds > 0, n_bytes * 8.0 / (seconds * 1e6)).otherwise(0.0)


def bucket_index(value: Column, bounds: Sequence[float] = RTT_BOUNDS_MS) -> Column:
    """The 1-based place of the first bound that is not below the value; null for negatives and non-numbers."""
    place = F.lit(None).cast("int")
    for k in range(len(bounds), 0, -1):
        place = F.when(value <= F.lit(float(bounds[k - 1])), k).otherwise(place)
    return F.when((value >= 0) & ~F.isnan(value) & (value < float("inf")), place)


def histogram(value: Column, bounds: Sequence[float] = RTT_BOUNDS_MS) -> Column:
    """Aggregate: an array of (upper bound as text, count) for all bounds, empty buckets included."""
    at = bucket_index(value, bounds)
    return F.array(
        *[
            F.struct(F.lit("inf" if b == float("inf") else f"{b:g}").alias("upper_bound_ms"), F.count_if(at == k).alias("count"))
            for k, b in enumerate(bounds, 1)
        ]
    )


def ratio_percent(part: Column, whole: Column, digits: int = 3) -> Column:
    """Part of a positive whole in percent; null otherwise."""
    return F.when(whole > 0, F.round(part / whole * 100.0, digits))


#: Upper ends of the shares of a promised rate, and of round-trip times in milliseconds.
RATIO_BINS = ((10, "0-10pct"), (30, "10-30pct"), (60, "30-60pct"), (90, "60-90pct"), (None, "90pct-plus"))
RTT_BINS = ((20, "low"), (80, "medium"), (None, "high"))


def binned(value: Column, bins: Sequence[tuple[float | None, str]]) -> Column:
    """The name of the first bin whose end the value stays under; null for null."""
    out = F.lit(bins[-1][1])
    for end, name in reversed(bins[:-1]):
        out = F.when(value < end, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either is zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def unit_score(similarity: Column) -> Column:
    """A cosine on the scale 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1.0) / 2.0))


def normalised(vector: Column) -> Column:
    """The vector at length 1; null if it has a non-number or length 0."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = norm(vector)
    return F.when(finite & (length > 0), F.transform(vector, lambda x: x.cast("double") / length))
