"""Document fingerprints of closed syncmers over words, in DataFrame operations only.

A k-mer is ``K`` neighbouring words, its inner substrings are runs of ``S`` words. It is a closed
syncmer, and becomes an anchor, if the least hash of its inner substrings is that of the first or
the last one. Whether a k-mer is chosen depends on its own words only, so equal passages have equal
anchors wherever they stand. The fingerprint is the anchors' hashes in order of position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capsight.llm.spark import written

K, S = 6, 2
INNER = K - S + 1

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column) -> Column:
    """Anchors of a text as an array of (position of the first word, hash), in order.

    A text of fewer than K words, or in which no k-mer is chosen, has one anchor, the hash of all its
    words; one without words, or null, has none.
    """
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")
    pair = "struct<at:int,hash:int>"

    def chosen(inner: Column, i: Column) -> Column:
        first, last = F.get(inner, i), F.get(inner, i + (INNER - 1))
        least = F.least(*[F.get(inner, i + j) for j in range(INNER)])
        return (first == least) | (last == least)

    def of_inner(inner: Column) -> Column:
        n = F.size(inner) - (INNER - 1)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: chosen(inner, i))
        return F.transform(
            starts,
            lambda i: F.struct(
                i.alias("at"),
                F.hash(*[F.get(inner, i + j) for j in range(0, INNER, S)]).alias("hash"),
            ),
        ).cast(f"array<{pair}>")

    def of_words(words: Column) -> Column:
        n = F.size(words)
        whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(F.array_join(words, " ")).alias("hash"))).cast(f"array<{pair}>")
        inner = F.zip_with(
            F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b),
        )
        return F.when(n == 0, F.array().cast(f"array<{pair}>")).when(n < K, whole).otherwise(
            _let(_let(inner, of_inner), lambda found: F.when(F.size(found) == 0, whole).otherwise(found))
        )

    return _let(split, of_words)


def hashes(found: Column) -> Column:
    """The anchors' hashes, in order."""
    return F.transform(found, lambda a: a["hash"])


def as_text(found: Column) -> Column:
    """Hashes as comma-joined hexadecimal numbers."""
    return F.array_join(F.transform(found, lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Twice the common distinct hashes over the sum of both: 0 to 1; 1 if both have none."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, anchors) of every row of ``docs`` (doc_id, text)."""
    return docs.select("doc_id", anchors(F.col("text")).alias("anchors"))


def positional_matches(found: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, shift, n): documents a < b with ``least`` or more common anchors on one diagonal.

    ``found`` is of ``fingerprints``. Only anchors that exactly two documents share are paired, so
    no common passage is expanded into all pairs; use near-duplicate operators for those.
    """
    one = found.select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.at", "x.hash")
    rare = (
        one.groupBy("hash")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("p"), F.max(F.struct("doc_id", "at")).alias("q"))
        .where("n = 2 and p.doc_id <> q.doc_id")
    )
    return (
        rare.groupBy(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"), (F.col("q.at") - F.col("p.at")).alias("shift"))
        .agg(F.count("*").alias("n")).where(F.col("n") >= least)
    )


def _next_ids(keys: DataFrame) -> DataFrame:
    """(key, next_key): each distinct key's successor in order, after the last the first.

    Keys are dealt by range and the part of each is written down with it, so the few parts' first
    keys, and each part's own order, come from the same dealing.
    """
    dealt = written(
        keys.distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ordered_keys"
    )
    everything = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first")).select(
        "part",
        F.coalesce(F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("part")), F.min("first").over(everything)).alias("after"),
    )
    inside = dealt.withColumn("lead", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    return inside.join(F.broadcast(firsts), "part").select("key", F.coalesce("lead", "after").alias("next_key"))


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    The edited text has its last floor(n / share) code points replaced by the first as many (or all)
    of the next document, in order of doc_id, after the last the first. Returns doc_id, n_chars,
    edited_sha256, hashes, edited_hashes, next_hashes. A null text is empty. A null doc_id comes
    first; rows of one doc_id each have their own result, and as a next document the least of their
    texts counts. Other columns are not read.

    Texts are shuffled once, by doc_id; of the next document only the replacement and the hashes
    travel on.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.coalesce("doc_id", lowest).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    links = _next_ids(base.select("key"))
    need = base.groupBy("key").agg(F.max(F.floor(F.length("text") / share)).cast("int").alias("need"))
    asked = links.join(need, "key").select(F.col("next_key").alias("key"), F.col("key").alias("asking"), "need")
    least = Window.partitionBy("key").orderBy("text")
    heads = (
        # the first row of each key, by lag and not by rank: so both uses of ``base`` share one shuffle
        base.withColumn("earlier", F.lag("key").over(least)).where("earlier is null").join(asked.hint("merge"), "key")
        .select(
            F.col("asking").alias("key"), F.expr("substring(text, 1, need)").alias("head"),
            hashes(anchors(F.col("text"))).alias("next_hashes"),
        )
    )
    quarter = F.floor(F.col("n_chars") / share).cast("int")
    return (
        base.join(heads.hint("merge"), "key")
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.expr(f"substring(text, 1, cast(n_chars - floor(n_chars / {share}) as int))"), F.substring(F.col("head"), F.lit(1), quarter)))
        .select(
            F.when(F.col("key") != lowest, F.col("key")).alias("doc_id"), "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            hashes(anchors(F.col("text"))).alias("hashes"),
            hashes(anchors(F.col("edited"))).alias("edited_hashes"),
            "next_hashes",
        )
    )
