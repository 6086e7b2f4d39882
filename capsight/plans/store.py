"""Queries of the knowledge store's life, of chats, of requests and of what is handed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import texts
from capsight.operators import capture, evidence, knowledge
from capsight.plans import packets
from capsight.plans.packets import k_of
from capsight.plans.tables import table
from capsight.sources import published

CAPACITY = 120


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, versions, documents): sources are documents, every seventh row of a source one version, rows chunks."""
    d = F.col("doc_id")
    chunks = table(spark, sf_dir, "documents").where("source is not null").select(
        d.alias("chunk_id"), F.col("source").alias("knowledge_id"), F.concat("source", F.lit("-"), (d % 7).cast("string")).alias("version_id"),
        F.when(d % 9 == 0, "draft").otherwise("approved").alias("status"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
    )
    versions = chunks.select("knowledge_id", "version_id").distinct().withColumn("status", F.when(F.endswith("version_id", F.lit("3")), "draft").otherwise("approved"))
    number = F.regexp_extract("knowledge_id", "[0-9]+", 0).cast("int")
    documents = chunks.select("knowledge_id").distinct().select(
        "knowledge_id", F.when(number % 5 == 4, "disabled").otherwise("approved").alias("status"), F.concat("knowledge_id", F.lit("-"), (number % 7).cast("string")).alias("current_version_id"),
        F.when(number % 2 == 0, "case").otherwise("guide").alias("knowledge_type"), F.lit("high").alias("authority"), F.lit(None).cast("string").alias("applicability"),
    )
    return chunks, versions, documents


def searchable_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that a search may find."""
    return knowledge.searchable(*_store(spark, sf_dir)).select("chunk_id", "version_id", "knowledge_type")


def active_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks among the labelled ones that may be shown."""
    wanted = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return knowledge.active_candidates(*_store(spark, sf_dir), wanted).select("chunk_id", "version_id")


def publish_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why draft versions can't be published."""
    chunks, versions, documents = _store(spark, sf_dir)
    empty = documents.select(F.concat("knowledge_id", F.lit("-none")).alias("version_id"), "knowledge_id")
    drafts = versions.select("version_id", "knowledge_id").unionByName(empty)
    embeddings = chunks.where("chunk_id % 31 <> 5").select("chunk_id", F.when(F.col("chunk_id") % 37 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    live = documents.where("status = 'approved'").select("knowledge_id", F.col("current_version_id").alias("version_id"))
    return knowledge.publish_faults(drafts, chunks, embeddings, live, CAPACITY)


def saved_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after drafts: new ones, and new titles of known ones, whose version stays."""
    rows = table(spark, sf_dir, "documents").where("source is not null")
    documents = rows.where("doc_id % 3 <> 0").groupBy(F.col("source").alias("knowledge_id")).agg(F.concat(F.lit("old "), F.max("lang")).alias("title"), F.max("doc_id").alias("current_version_id"))
    documents = documents.where("current_version_id % 2 = 0")
    drafts = rows.where("doc_id % 5 = 0").select(F.col("source").alias("knowledge_id"), F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("title"), F.lit(-1).cast("long").alias("current_version_id"), F.col("doc_id").alias("seq"))
    return knowledge.saved_drafts(documents, drafts, "knowledge_id", ("current_version_id",))


def approved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (runs) of a segment that have an order (decision) of status F."""
    runs = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    decisions = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return runs.join(decisions, "c_custkey", "left_semi")


def case_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as cases, in titled sections."""
    d = F.col("doc_id")
    body = F.to_json(F.struct(
        F.array(F.concat(F.lit("a"), d.cast("string"))).alias("anomaly_summaries"), F.when(d % 2 == 0, F.struct((d % 5).alias("loss"))).alias("tcp_features"), F.when(d % 3 != 0, F.concat(F.lit("cause "), d.cast("string"))).otherwise("").alias("confirmed_primary_cause"),
        F.array().cast("array<string>").alias("candidate_causes"), F.when(d % 7 == 0, "done").alias("resolution"),
    ))
    rows = table(spark, sf_dir, "labels").where("doc_id is not null").select("doc_id", F.concat(F.lit("case "), d.cast("string")).alias("title"), body.alias("body"))
    found = knowledge.case_sections(rows, "doc_id", "title", "body")
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.array_join("heading_path", " / ").alias("heading"), "content")


def query_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the benchmark's items as questions."""
    question = texts.hidden(F.col("text")).alias("question")
    return table(spark, sf_dir, "benchmark").select("item_id", knowledge.query_identity(question, F.lit("general_chat").alias("scope")).alias("query_id"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each source's texts."""
    rows = table(spark, sf_dir, "documents").where("text is not null and source is not null").select("source", "doc_id", F.sha2("text", 256).alias("d"))
    return knowledge.corpus_fingerprint(rows, "source", "doc_id", "d")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    lead = F.when(c % 6 == 0, "/help ").when(c % 6 == 1, "/Analyze  x ").when(c % 6 == 2, "/nothing").when(c % 6 == 3, "诊断 ").when(c % 6 == 4, "为什么 ").otherwise("")
    said = F.when(c % 13 == 0, "  ").when(c % 13 == 1, " 50 Mbps ").otherwise(F.concat(lead, F.substring(F.coalesce("text", F.lit("")), 1, 30)))
    return table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", said.alias("said"))


def slash_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands among chat lines."""
    rows = _said(spark, sf_dir).select("conv_id", "turn", texts.command(F.col("said")).alias("c"))
    return rows.select("conv_id", "turn", "c.name", "c.argument")


def route_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where chat lines go."""
    c = F.col("conv_id")
    return _said(spark, sf_dir).select("conv_id", "turn", texts.route(F.col("said"), c % 2 == 0, c % 3 == 0).alias("route"), texts.is_english(F.col("said")).alias("english"))


def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects out of answers with fences and words around them, and the ends of these answers by bytes."""
    k = F.col("event_id") % 5
    body = F.to_json(F.struct("event_type", F.struct(k_of().alias("k")).alias("in")))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), body, F.lit(" é漢."))).when(k == 2, F.concat(body, F.lit("}"))).when(k == 3, "none").otherwise(body)
    return table(spark, sf_dir, "events").select("event_id", texts.embedded_object(raw).alias("found"), texts.utf8_tail(raw, 6).alias("tail"))


def evidence_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last evidence of each user, of the types whose pages came last."""
    items = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("event_id") / 10).alias("page"), "event_id")
    found = evidence.evidence_layers(items, "user_id", "event_type", "page", "event_id", layers=2, most=7)
    return found.select("user_id", "event_type", "event_id", F.col("layer").cast("long").alias("layer"))


def distinct_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the requests of each user that ask the same."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (k_of() % 4).alias("k"))
    return evidence.distinct_requests(rows, "user_id", "event_id", "event_type", "k")


def null_safe_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet evidence by lists of values and flows, where "not equal" keeps what is unknown."""
    p = evidence.Predicate
    query = evidence.EvidenceQuery(
        fields=("evidence_id",), null_safe=True, types=("retransmissions", "window_changes"), flow_ids=[f"u{n}" for n in range(0, 20)],
        predicates=(p("frame.time_relative", "ne", 5.0), p("direction", "in", ["upload", "download"]), p("tcp.ack", "ne", 8), p("tcp.window_size", "in", [512 * n for n in range(0, 60, 2)][:32])),
    )
    found = evidence.matching(capture.events(packets.packets(spark, sf_dir)), query)
    return found.select("evidence_id", "event_type", "flow_id", "tcp_window_size")


def filtered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by optional lists: of two statuses, of all priorities."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return evidence.filtered(rows, o_orderstatus=["F", "P"], o_orderpriority=None).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def sane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as they may be handed on: ids that parse, counts and histograms without nonsense."""
    k, e = k_of(), F.col("event_id")
    flow = F.concat(F.lit("10.0.0."), (e % 250).cast("string"), F.lit(":"), F.when(e % 4 == 0, 99999).otherwise(e % 1000).cast("string"), F.lit("<->10.0.1.1:443"))
    buckets = F.array(*[F.struct(F.when(k % 3 != n, F.lit(str(n))).alias("upper_bound_ms"), (k - 50 * n).alias("count")) for n in range(3)])
    rows = table(spark, sf_dir, "events").select("event_id", flow.alias("flow_id"), (k - 10).alias("packets"), evidence.sane_histogram(buckets).alias("h"))
    found = evidence.sane_flows(rows, "packets")
    return found.select("event_id", "packets", F.array_join(F.transform("h", lambda b: F.concat_ws("=", b["upper_bound_ms"], b["count"].cast("string"))), ",").alias("histogram"))


def json_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON artifacts, and why some can't be taken in."""
    e = F.col("event_id")
    text = F.when(e % 7 == 0, "").when(e % 7 == 1, "{").when(e % 7 == 2, "[1]").when(e % 7 == 3, "5").otherwise(F.to_json(F.struct("event_type", F.struct(k_of().alias("k")).alias("m"))))
    content = F.to_binary(text, F.lit("utf-8"))
    files = table(spark, sf_dir, "events").select(e.cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return published.json_objects(files, "event_type string, m struct<k: long>").select("path", "fault", "value.event_type", "value.m.k")


QUERIES = {
    f.__name__: f
    for f in (
        searchable_chunks, active_candidates, publish_faults, saved_drafts, approved_runs, case_sections, query_identity, corpus_fingerprint, slash_commands, route_turns,
        json_recovery, evidence_layers, distinct_requests, null_safe_evidence, filtered_orders, sane_output, json_artifacts,
    )
}

_K = "e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"
_STORE = """c AS (SELECT doc_id AS chunk_id, source AS knowledge_id, source || '-' || (doc_id % 7) AS version_id, doc_id % 9 <> 0 AS ok, regexp_extract(source, '[0-9]+')::INT AS n FROM documents WHERE source IS NOT NULL),
    a AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'case' ELSE 'guide' END AS knowledge_type FROM c WHERE ok AND n % 5 <> 4 AND version_id = knowledge_id || '-' || (n % 7) AND NOT ends_with(version_id, '3'))"""
_SAID = """s AS (SELECT conv_id, turn, CASE conv_id % 13 WHEN 0 THEN '  ' WHEN 1 THEN ' 50 Mbps ' ELSE
        CASE conv_id % 6 WHEN 0 THEN '/help ' WHEN 1 THEN '/Analyze  x ' WHEN 2 THEN '/nothing' WHEN 3 THEN '诊断 ' WHEN 4 THEN '为什么 ' ELSE '' END || left(coalesce(text, ''), 30) END AS said FROM conversations WHERE conv_id IS NOT NULL)"""
_HAS = lambda terms: " OR ".join(f"contains(t, '{t}')" for t in terms)

ORACLE_SQL = {
    "searchable_chunks": f"WITH {_STORE} SELECT chunk_id, version_id, knowledge_type FROM a",
    "active_candidates": f"WITH {_STORE} SELECT chunk_id, version_id FROM a WHERE chunk_id IN (SELECT doc_id FROM labels)",
    "publish_faults": f"""WITH {_STORE}, v AS (SELECT knowledge_id, version_id, count(*) AS chunks, count(*) FILTER (chunk_id % 31 = 5 OR chunk_id % 37 = 1) AS missing, n FROM c GROUP BY ALL),
        l AS (SELECT knowledge_id, chunks AS held FROM v WHERE n % 5 <> 4 AND version_id = knowledge_id || '-' || (n % 7)),
        d AS (SELECT knowledge_id, version_id, chunks, missing FROM v UNION ALL SELECT DISTINCT knowledge_id, knowledge_id || '-none', NULL, NULL FROM c)
        SELECT version_id, CASE WHEN chunks IS NULL THEN 'no_chunks' WHEN missing > 0 THEN 'incomplete' WHEN (SELECT sum(held) FROM l) - coalesce(held, 0) + chunks > {CAPACITY} THEN 'capacity' END AS fault
        FROM d LEFT JOIN l USING (knowledge_id)""",
    "saved_drafts": """WITH d AS (SELECT source AS knowledge_id, 'old ' || max(lang) AS title, max(doc_id) AS v FROM documents WHERE source IS NOT NULL AND doc_id % 3 <> 0 GROUP BY 1 HAVING max(doc_id) % 2 = 0),
        n AS (SELECT source AS knowledge_id, 'new ' || max(doc_id) AS title FROM documents WHERE source IS NOT NULL AND doc_id % 5 = 0 GROUP BY 1)
        SELECT coalesce(d.knowledge_id, n.knowledge_id) AS knowledge_id, coalesce(n.title, d.title) AS title, coalesce(v, -1) AS current_version_id FROM d FULL JOIN n USING (knowledge_id)""",
    "approved_runs": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "case_sections": """WITH p AS (SELECT doc_id, unnest([{'p': 0, 'h': '现象', 'c': '["a' || doc_id || '"]'}, {'p': 1, 'h': 'TCP 特征', 'c': CASE WHEN doc_id % 2 = 0 THEN '{"loss":' || (doc_id % 5) || '}' END},
            {'p': 2, 'h': '已确认主因', 'c': CASE WHEN doc_id % 3 <> 0 THEN 'cause ' || doc_id END}, {'p': 7, 'h': '处置结果', 'c': CASE WHEN doc_id % 7 = 0 THEN 'done' END}]) AS s FROM labels WHERE doc_id IS NOT NULL)
        SELECT doc_id, s.p::BIGINT AS place, 'case ' || doc_id || ' / ' || s.h AS heading, s.c AS content FROM p WHERE s.c IS NOT NULL""",
    "query_identity": f"""SELECT item_id, 'ragq-' || left(sha256('{{"question":' || to_json(regexp_replace(regexp_replace(text, '(?i)(?:sk-[a-z0-9_-]{{12,}}|(?:api[_-]?key|authorization)\\s*[:=]\\s*\\S+)', '{texts.SECRET_MARK}', 'g'),
        '(?i)(^|\\W)((?:[a-z]:[\\\\/]|/users/|/home/|/private/|/tmp/|~[/\\\\])[^\\n，。；,;!?]*)', '\\1{texts.PATH_MARK}', 'g'))::VARCHAR || ',"scope":"general_chat"}}'), 16) AS query_id FROM benchmark""",
    "corpus_fingerprint": """WITH p AS (SELECT source, left(sha256(doc_id::VARCHAR), 2) AS part, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS d FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
        SELECT source, sha256(string_agg(part || ':' || d, ',' ORDER BY part)) AS fingerprint FROM p GROUP BY 1""",
    "slash_commands": rf"""WITH {_SAID}, t AS (SELECT *, trim(said, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM s), n AS (SELECT *, lower(regexp_extract(t, '^/\s*(\S*)\s*((?s).*)$', 1)) AS name FROM t)
        SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN NOT starts_with(t, '/') THEN NULL WHEN name IN {texts.COMMANDS} THEN name ELSE 'unknown' END AS name,
               CASE WHEN t = '' THEN '' WHEN starts_with(t, '/') THEN regexp_extract(t, '^/\s*(\S*)\s*((?s).*)$', 2) END AS argument FROM n""",
    "route_turns": rf"""WITH {_SAID}, l AS (SELECT *, lower(trim(said)) AS t, regexp_extract_all(said, '[A-Za-z]+') AS w FROM s)
        SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN CASE WHEN {_HAS(texts.RESULT_TERMS)} THEN 'analysis_question' ELSE 'general' END
            WHEN contains(t, '.pcap') OR {_HAS(texts.PARAMETER_TERMS + texts.DIAGNOSIS_TERMS)} OR (conv_id % 3 = 0 AND regexp_matches(t, '{texts.SHORT_PARAMETER}')) THEN 'diagnosis' ELSE 'general' END AS route,
            NOT regexp_matches(said, '[一-鿿]') AND len(w) > 0 AND len(list_filter(w, lambda x: NOT (upper(x) = x AND length(x) <= 8))) > 0 AND (len(w) >= 2 OR length(array_to_string(w, '')) >= 10) AS english FROM l""",
    "json_recovery": f"""WITH {_K}, b AS (SELECT event_id, event_id % 5 AS n, '{{"event_type":"' || event_type || '","in":{{"k":' || k || '}}}}' AS body FROM e)
        SELECT event_id, CASE WHEN n IN (0, 1, 4) THEN body END AS found, CASE n WHEN 0 THEN right(body, 2) || chr(10) || '```' WHEN 1 THEN 'é漢.' WHEN 2 THEN right(body, 5) || '}}' WHEN 3 THEN 'none' ELSE right(body, 6) END AS tail FROM b""",
    "evidence_layers": """WITH i AS (SELECT user_id, event_type, event_id, event_id // 10 AS page FROM events),
        l AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(page) DESC, event_type) AS layer FROM i GROUP BY 1, 2 QUALIFY layer <= 2)
        SELECT user_id, event_type, event_id, layer FROM i JOIN l USING (user_id, event_type) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY page DESC, event_id DESC) <= 7""",
    "distinct_requests": f"""WITH {_K} SELECT user_id, event_id, event_type, k % 4 AS k, sha256('{{"event_type":"' || event_type || '","k":' || (k % 4) || '}}') AS query_key FROM e
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type, k % 4 ORDER BY event_id) = 1""",
    "null_safe_evidence": f"""WITH {packets.PACKETS},
        v AS (SELECT *, unnest(list_filter([CASE WHEN retransmission THEN 'retransmission' END, CASE WHEN fast_retransmission THEN 'fast_retransmission' END, CASE WHEN zero_window THEN 'zero_window' END,
                      CASE WHEN window_full THEN 'window_full' END], lambda x: x IS NOT NULL)) AS event_type FROM p WHERE is_tcp AND frame > 0)
        SELECT frame || ':' || event_type || ':' || direction || ':' || flow_id AS evidence_id, event_type, flow_id, window_size AS tcp_window_size FROM v
        WHERE (time IS NULL OR time <> 5.0) AND tcp_ack <> 8 AND window_size % 1024 = 0 AND window_size < 30720 AND flow_id IN ({", ".join(f"'u{n}'" for n in range(20))})""",
    "filtered_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL",
    "sane_output": f"""WITH {_K} SELECT event_id, CASE WHEN k >= 10 THEN k - 10 END AS packets,
        concat_ws(',', CASE WHEN k % 3 <> 0 THEN '0=' || k END, CASE WHEN k % 3 <> 1 AND k >= 50 THEN '1=' || (k - 50) END, CASE WHEN k % 3 <> 2 AND k >= 100 THEN '2=' || (k - 100) END) AS histogram FROM e WHERE event_id % 4 <> 0""",
    "json_artifacts": f"""WITH {_K} SELECT event_id::VARCHAR AS path, CASE event_id % 7 WHEN 0 THEN 'size' WHEN 1 THEN 'json' WHEN 2 THEN 'object' WHEN 3 THEN 'object' END AS fault,
        CASE WHEN event_id % 7 > 3 THEN event_type END AS event_type, CASE WHEN event_id % 7 > 3 THEN k END AS k FROM e""",
}
