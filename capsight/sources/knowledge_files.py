"""Knowledge files: texts with checks of type, size and encoding, and the images that Markdown refers to.

Files are rows of (path, length, content), as ``binaryFile`` reads them. Nothing raises: what can't be
taken in is a row with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions.texts import redacted

#: Kinds of files by suffix, the largest text and image, image types by suffix and by leading bytes.
KINDS = {"md": "markdown", "markdown": "markdown", "txt": "text", "json": "json"}
MOST_TEXT, MOST_IMAGE = 5 << 20, 5 << 20
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "webp": "image/webp"}
SIGNATURES = (("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"))
#: Fixed value: an image in Markdown: its text and its reference, an optional title left out.
IMAGE = r"""!\[([^\]]*)\]\(([^)\s]+)(?:\s+['"][^)]*['"])?\)"""
#: What stands for an image that was taken in, and for one that wasn't.
SHOWN, NAMED = ("[图片：", "；来源：", "]"), ("[图片引用：", "]")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all files below a folder; Spark's reader leaves out those of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def texts(found: DataFrame) -> DataFrame:
    """(path, kind, text, fault) of files: fault is type, size, encoding or null; text only of good ones."""
    kind = F.lit(None).cast("string")
    for suffix, name in KINDS.items():
        kind = F.when(_suffix(F.col("path")) == suffix, name).otherwise(kind)
    text = F.col("content").cast("string")
    fault = (
        F.when(F.col("kind").isNull(), "type").when(~F.col("length").between(1, MOST_TEXT), "size").when(~F.is_valid_utf8(text), "encoding")
    )
    return found.withColumn("kind", kind).withColumn("fault", fault).select("path", "kind", F.when(F.col("fault").isNull(), text).alias("text"), "fault")


def resolved(folder: Column, reference: Column) -> Column:
    """The path that a reference means from a folder; null if it isn't below that folder."""
    base = F.split(folder, "/")

    def step(at: Column, part: Column) -> Column:
        return F.when(part.isin("", "."), at).when(part == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(1)))).otherwise(F.concat(at, F.array(part)))

    start = F.when(F.startswith(reference, F.lit("/")), F.slice(base, 1, 1)).otherwise(base)
    parts = F.aggregate(F.split(reference, "/"), start, step)
    inside = (F.size(parts) > F.size(base)) & (F.slice(parts, 1, F.size(base)) == base)
    return F.when(inside, F.array_join(parts, "/"))


def references(docs: DataFrame) -> DataFrame:
    """(path, place, alt, reference, target) of the images in Markdown texts, in order; target null where it leads out of the folder."""
    both = F.arrays_zip(
        F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2)).alias("reference")
    )
    rows = docs.where("text is not null").select("path", F.posexplode(both).alias("place", "_image"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return rows.select("path", "place", "_image.alt", "_image.reference", resolved(folder, F.col("_image.reference")).alias("target"))


def images(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``references`` with (mime, data_url, sha256, fault): fault is remote, outside, missing, format, size, content or null.

    One join on the path; only files that are referred to, and that have an image's suffix, are sent.
    """
    asked = references(docs)
    wanted = found.select(F.col("path").alias("target"), "length", "content").join(asked.select("target").distinct(), "target", "left_semi")
    mime, real = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, name in IMAGE_TYPES.items():
        mime = F.when(_suffix(F.col("target")) == suffix, name).otherwise(mime)
    head = F.hex(F.substring("content", 1, 12))
    for name, signature in SIGNATURES:
        real = F.when(F.startswith(head, F.lit(signature)), name).otherwise(real)
    real = F.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise(real)
    fault = (
        F.when(F.col("reference").rlike("^(?:https?://|data:)"), "remote").when(F.col("target").isNull(), "outside").when(F.col("length").isNull(), "missing")
        .when(F.col("mime").isNull(), "format").when(~F.col("length").between(1, MOST_IMAGE), "size").when(~F.col("mime").eqNullSafe(real), "content")
    )
    joined = asked.join(wanted, "target", "left").withColumn("mime", mime).withColumn("fault", fault)
    good = F.col("fault").isNull()
    url = F.concat(F.lit("data:"), F.col("mime"), F.lit(";base64,"), F.base64("content"))
    return joined.select(
        "path", "place", "alt", "reference", "target", F.when(good, F.col("mime")).alias("mime"), F.when(good, F.regexp_replace(url, r"\s", "")).alias("data_url"),
        F.when(good, F.sha2("content", 256)).alias("sha256"), "fault",
    )


def rendered(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """(path, text): Markdown with redacted wording, and each image replaced by what names it. ``shown``: rows of ``images``."""
    alt = redacted(F.col("alt"))
    inside = F.substring(F.col("target"), F.length(F.regexp_extract("path", "^(.*/)", 1)) + 1, F.length("target"))
    named = F.when(F.col("fault").isNull(), F.concat(F.lit(SHOWN[0]), F.coalesce(F.nullif(alt, F.lit("")), inside), F.lit(SHOWN[1]), inside, F.lit(SHOWN[2])))
    marks = shown.select("path", F.struct("place", named.otherwise(F.concat(F.lit(NAMED[0]), alt, F.lit(NAMED[1]))).alias("mark")).alias("_m"))
    marks = marks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list("_m")), lambda m: m["mark"]).alias("_marks"))
    pieces = F.transform(F.split("text", IMAGE, -1), redacted)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.coalesce("_marks", F.array().cast("array<string>")), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return docs.where("text is not null").select("path", "text").join(marks, "path", "left").select("path", joined.alias("text"))
