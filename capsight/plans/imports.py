"""Queries of what comes in and goes out: nested JSON, paths in texts, published runs, knowledge files with images, vectors as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import nested, paths, vectors
from capsight.plans.packets import k_of
from capsight.plans.tables import table
from capsight.sources import knowledge_files, published
from capsight.sources.storage import shared_folder

BASE = "/work/here"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = k_of()
    body = F.struct(
        F.col("event_type").alias("kind"), F.lit("10.0.0.1").alias("client_ip"), F.struct((F.col("value") * 100).cast("long").alias("cents"), F.lit("t").alias("token"), k.alias("k")).alias("metrics"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((k + i).alias("at"))).alias("tags"), F.concat(F.lit("/home/u"), F.col("user_id").cast("string")).alias("file"), (k % 2 == 0).alias("flag"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.when(k % 10 != 9, F.to_json(body)).otherwise("{broken").alias("body"))


def nested_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaves of each event's nested JSON, without its sensitive and local parts."""
    return nested.all_leaves(_features(spark, sf_dir), "event_id", "body")


def nested_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of each last key of an event's nested JSON."""
    leaves = _features(spark, sf_dir).select("event_id", nested.flattened(F.col("body")).alias("leaves"))
    found = leaves.select("event_id", nested.short_features(F.col("leaves")).alias("m"))
    return found.where("m is not null").select("event_id", F.array_join(F.transform(F.map_keys("m"), lambda x: F.concat(x, F.lit("="), F.col("m")[x])), ",").alias("features"))


def nested_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with masked strings and without sensitive keys, at any depth."""
    k, user = k_of().cast("string"), F.col("user_id").cast("string")
    inner = F.struct(F.lit("p").alias("password"), F.concat(F.lit("10.0.0."), k).alias("ip"), F.array(F.struct(F.lit("x").alias("api_key"), user.alias("id"))).alias("more"))
    body = F.to_json(F.struct(F.concat(F.lit("mail u"), user, F.lit("@x.org now")).alias("note"), F.lit("abc").alias("token"), F.array(inner).alias("deep"), k_of().alias("n")))
    return table(spark, sf_dir, "events").select("event_id", nested.redacted_json(body).alias("body"))


def _mentions() -> Column:
    k = k_of().cast("string")
    return F.concat(
        F.lit('look at "/data/cap '), F.col("event_id").cast("string"), F.lit('.pcapng" and C:\\cap\\'), k, F.lit(".pcap, then ../up"), k, F.lit(".PCAP; b"), F.col("user_id").cast("string"), F.lit(".pcapng!")
    )


def path_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name captures, with placeholders for their paths, and with the whole paths put back."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, _mentions()).otherwise("no capture here").alias("text"))
    found = paths.with_placeholders(rows, "event_id", "text", BASE)
    return found.select("event_id", "text", F.size("references").cast("long").alias("n_references"), paths.restored(F.col("text"), F.col("references")).alias("restored"))


def published_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by event type of the newest published run; a run that stopped between its tables doesn't show."""
    base = shared_folder(spark, "published")
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    totals = lambda rows, key: rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    published.publish(base, {"types": totals(events.where("user_id < 0"), "event_type"), "users": totals(events, "user_id")})
    run = published.publish(base, {"types": totals(events, "event_type"), "users": totals(events, "user_id")})
    published.write_tables(base, "half", {"types": totals(events.where("user_id % 2 = 0"), "event_type")})  # and no manifest
    users = published.read(spark, base, "users", run).agg(F.count("*").alias("n_users"))
    return published.read(spark, base, "types").crossJoin(F.broadcast(users))


def _knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of a folder for each source; some are too short, of other types, or not UTF-8."""
    n = F.col("doc_id")
    suffix = F.when(n % 7 == 0, ".bin").when(n % 7 == 1, ".TXT").when(n % 7 == 2, ".json").otherwise(".md")
    images = F.concat(
        F.lit("# Part\n\n![first]("), F.lit("img/"), (n % 50).cast("string"), F.lit(".png)\n\n## More\n\n"), F.when(n % 3 == 0, F.lit("see ![](./img/../img/1.jpg 'title') and ![far](https://x.org/y.png)\n")).otherwise(F.lit("![out](../../up.png) ![](img/9.gif)\n")),
    )
    text = F.when(n % 11 == 0, "").otherwise(F.concat(images, F.coalesce("text", F.lit(""))))
    content = F.when(n % 13 == 0, F.concat(F.to_binary(text, F.lit("utf-8")), F.unhex(F.lit("FF")))).otherwise(F.to_binary(text, F.lit("utf-8")))
    path = F.concat(F.lit("kb/"), F.col("source"), F.lit("/"), n.cast("string"), suffix)
    return table(spark, sf_dir, "documents").where("source is not null").select(path.alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images beside them: some missing, empty, or of another type than their name says."""
    n = F.col("n")
    sources = table(spark, sf_dir, "documents").where("source is not null").select("source").distinct().select("source", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n"))
    png, jpg = F.lit("89504E470D0A1A0A"), F.lit("FFD8FF")
    head = F.when(n == 1, jpg).when(n % 5 == 0, jpg).otherwise(png)
    content = F.when((n % 7 == 0) & (n > 0), F.unhex(F.lit(""))).otherwise(F.unhex(F.concat(head, F.lpad(F.hex(n), 2, "0"))))
    suffix = F.when(n == 1, ".jpg").when(n == 9, ".gif").otherwise(".png")
    return sources.select(F.concat(F.lit("kb/"), F.col("source"), F.lit("/img/"), n.cast("string"), suffix).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


def knowledge_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the knowledge files can be taken in, and why the rest can't."""
    found = knowledge_files.texts(_knowledge(spark, sf_dir))
    return found.select("path", "kind", F.length("text").cast("long").alias("n_chars"), "fault")


def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that Markdown files refer to, or why they can't be had."""
    docs = knowledge_files.texts(_knowledge(spark, sf_dir)).where("kind = 'markdown' and fault is null")
    found = knowledge_files.images(docs, _images(spark, sf_dir))
    return found.select("path", F.col("place").cast("long").alias("place"), "alt", "target", "data_url", "sha256", "fault")


def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored artifacts, held against what a list says of them."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    content = F.to_binary(F.col("text"), F.lit("utf-8"))
    path = F.concat(F.lit("a/"), F.col("doc_id").cast("string"))
    files = rows.where("doc_id % 9 <> 0").select(path.alias("path"), F.octet_length("text").cast("long").alias("length"), content.alias("content"))
    expected = rows.select(
        path.alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("size"),
        F.upper(F.sha2(F.when(F.col("doc_id") % 4 == 0, F.reverse("text")).otherwise(F.col("text")), 256)).alias("sha256"),
    )
    return published.verified(files, expected).select("path", "fault", F.octet_length("content").cast("long").alias("n_bytes"))


def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes and back; bytes that are no vector of 64 components give none."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", vectors.encoded(F.col("embedding")).alias("blob"))
    cut = F.when(F.col("vec_id") % 5 == 0, F.substring(F.col("blob"), 1, 255)).when(F.col("vec_id") % 5 == 1, F.substring(F.col("blob"), 1, 252)).otherwise(F.col("blob"))
    found = rows.withColumn("back", vectors.decoded(cut, 64)).withColumn("first", F.get(vectors.decoded(F.substring(F.col("blob"), 1, 4)), F.lit(0)))
    same = F.when(F.col("back").isNotNull(), F.col("back") == F.col("embedding"))
    return found.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), same.alias("same"), F.round(F.col("first").cast("double"), 6).alias("first"))


QUERIES = {
    f.__name__: f
    for f in (nested_features, nested_short, nested_redaction, path_placeholders, published_totals, knowledge_texts, markdown_images, artifact_check, vector_codec)
}

_K = "e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, CAST(trunc(value * 100) AS BIGINT) AS cents FROM events)"
_LEAVES = f"""{_K},
    x AS (SELECT event_id, k, cents, unnest([
            {{'n': 1, 'path': 'flag', 'kind': 'boolean', 'value': CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END}}, {{'n': 2, 'path': 'kind', 'kind': 'string', 'value': event_type}},
            {{'n': 3, 'path': 'metrics.cents', 'kind': 'number', 'value': cents::VARCHAR}}, {{'n': 4, 'path': 'metrics.k', 'kind': 'number', 'value': k::VARCHAR}}]) AS leaf FROM e WHERE k % 10 <> 9
          UNION ALL SELECT event_id, k, cents, {{'n': 5 + i, 'path': 'tags[' || i || '].at', 'kind': 'number', 'value': (k + i)::VARCHAR}} FROM e, (SELECT unnest(range(10)) AS i) WHERE k % 10 <> 9)"""
_PLACE = lambda path: f"'capture_' || left(sha256({path}), 8)"
_QUOTED, _DRIVE, _UP, _BARE = "'/data/cap ' || event_id || '.pcapng'", r"'C:\cap\' || k || '.pcap'", "'/work/up' || k || '.PCAP'", f"'{BASE}/b' || user_id || '.pcapng'"
_FILES = r"""n AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN '.bin' WHEN 1 THEN '.TXT' WHEN 2 THEN '.json' ELSE '.md' END AS suffix,
        CASE WHEN doc_id % 11 = 0 THEN '' ELSE '# Part' || chr(10) || chr(10) || '![first](img/' || (doc_id % 50) || '.png)' || chr(10) || chr(10) || '## More' || chr(10) || chr(10)
            || CASE WHEN doc_id % 3 = 0 THEN 'see ![](./img/../img/1.jpg ''title'') and ![far](https://x.org/y.png)' ELSE '![out](../../up.png) ![](img/9.gif)' END || chr(10) || coalesce(text, '') END AS body
        FROM documents WHERE source IS NOT NULL),
    f AS (SELECT *, 'kb/' || source || '/' || doc_id || suffix AS path, CASE suffix WHEN '.TXT' THEN 'text' WHEN '.json' THEN 'json' WHEN '.md' THEN 'markdown' END AS kind,
        CASE WHEN suffix = '.bin' THEN 'type' WHEN body = '' AND doc_id % 13 <> 0 OR strlen(body) > 5242880 THEN 'size' WHEN doc_id % 13 = 0 THEN 'encoding' END AS fault FROM n)"""

ORACLE_SQL = {
    "nested_features": f"WITH {_LEAVES} SELECT event_id, leaf.path AS path, leaf.kind AS kind, leaf.value AS value FROM x",
    "nested_short": f"""WITH {_K} SELECT event_id, 'flag=' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',kind=' || event_type || ',cents=' || cents || ',k=' || k || ',at=' || k AS features
        FROM e WHERE k % 10 <> 9""",
    "nested_redaction": f"""WITH {_K} SELECT event_id, '{{"note":"mail <EMAIL:' || left(sha256('u' || user_id || '@x.org'), 8) || '> now","deep":[{{"ip":"<IP:' || left(sha256('10.0.0.' || k), 8)
        || '>","more":[{{"id":"' || user_id || '"}}]}}],"n":' || k || '}}' AS body FROM e""",
    "path_placeholders": f"""WITH {_K} SELECT event_id,
        CASE WHEN event_id % 10 = 0 THEN 'no capture here' ELSE 'look at "' || {_PLACE(_QUOTED)} || '" and ' || {_PLACE(_DRIVE)} || ', then ' || {_PLACE(_UP)} || '; ' || {_PLACE(_BARE)} || '!' END AS text,
        CASE WHEN event_id % 10 = 0 THEN 0 ELSE 4 END::BIGINT AS n_references,
        CASE WHEN event_id % 10 = 0 THEN 'no capture here' ELSE 'look at "' || {_QUOTED} || '" and ' || {_DRIVE} || ', then ' || {_UP} || '; ' || {_BARE} || '!' END AS restored FROM e""",
    "published_totals": """SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, (SELECT count(DISTINCT user_id) FROM events) AS n_users
        FROM events GROUP BY 1""",
    "knowledge_texts": f"WITH {_FILES} SELECT path, kind, CASE WHEN fault IS NULL THEN length(body) END AS n_chars, fault FROM f",
    "markdown_images": f"""WITH {_FILES},
        r AS (SELECT path, source, 0 AS place, 'first' AS alt, 'img/' || (doc_id % 50) || '.png' AS ref, doc_id % 50 AS i FROM f WHERE kind = 'markdown' AND fault IS NULL
              UNION ALL SELECT path, source, 1, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'out' END, CASE WHEN doc_id % 3 = 0 THEN 'img/1.jpg' END, 1 FROM f WHERE kind = 'markdown' AND fault IS NULL
              UNION ALL SELECT path, source, 2, CASE WHEN doc_id % 3 = 0 THEN 'far' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'https:/x.org/y.png' ELSE 'img/9.gif' END, 9 FROM f WHERE kind = 'markdown' AND fault IS NULL),
        g AS (SELECT *, CASE WHEN ref LIKE 'https%' THEN 'remote' WHEN ref IS NULL THEN 'outside' WHEN ref = 'img/1.png' OR ref = 'img/9.png' OR i >= 40 THEN 'missing' WHEN ref = 'img/9.gif' THEN 'format'
                             WHEN i % 7 = 0 AND i > 0 THEN 'size' WHEN i % 5 = 0 THEN 'content' END AS fault,
                     unhex(CASE WHEN i = 1 THEN 'FFD8FF' ELSE '89504E470D0A1A0A' END || printf('%02X', i)) AS content FROM r)
        SELECT path, place::BIGINT AS place, alt, 'kb/' || source || '/' || ref AS target, CASE WHEN fault IS NULL THEN CASE WHEN i = 1 THEN 'data:image/jpeg;base64,' ELSE 'data:image/png;base64,' END || to_base64(content) END AS data_url,
               CASE WHEN fault IS NULL THEN sha256(content) END AS sha256, fault FROM g""",
    "artifact_check": """WITH f AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 5 = 0 OR strlen(text) > 10485760 THEN 'size' WHEN doc_id % 4 = 0 AND reverse(text) <> text THEN 'hash' END AS fault
        FROM documents WHERE text IS NOT NULL)
        SELECT 'a/' || doc_id AS path, fault, CASE WHEN fault IS NULL THEN strlen(text) END::BIGINT AS n_bytes FROM f""",
    "vector_codec": """SELECT vec_id, 4 * len(embedding) AS n_bytes, CASE WHEN vec_id % 5 >= 2 THEN true END AS same, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings""",
}
