"""Queries of retrieval decisions, answer checks, symptoms and causes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import fields, network, symptoms, texts
from capsight.operators import capture, evaluation, knowledge, rules
from capsight.plans import packets, retrieval
from capsight.plans.packets import k_of
from capsight.plans.tables import table

KEPT, POOL = 10, 12
COLUMNS = ("source", "lang", "text")


def bm25_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each item best by source, lang and text; items that four divides have no keywords and ask for their whole text."""
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.when(F.col("item_id") % 4 != 0, F.split("text", " ")).otherwise(F.array().cast("array<string>")).alias("keywords")
    )
    return knowledge.keyword_top(table(spark, sf_dir, "documents"), "doc_id", COLUMNS, knowledge.match_phrases(items, "keywords", "text"), KEPT)


def overfetch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten vectors of a fitting label among the thirty nearest to every twentieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    nearest = knowledge.nearest(vectors, "vec_id", "embedding", asked, 3 * KEPT).drop("rank")
    scored = nearest.join(vectors.select("vec_id", "label"), "vec_id")
    return knowledge.top_that_fit(scored, "vec_id", KEPT, True, F.col("label") % 3 != 0).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _pool(fused: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates of each item, and made-up scores of them: of each fifth item's one is missing, of each fifth and first one is negative."""
    pool = knowledge.candidate_pool(fused, "doc_id", POOL, with_reranker=True)
    score = ((F.col("doc_id") * 37 + F.col("query_id") * 11) % 101 / 100.0).cast("double")
    given = pool.select("query_id", "doc_id", "pool_rank", F.when((F.col("query_id") % 5 == 1) & (F.col("pool_rank") == 2), -1.0).otherwise(score).alias("rerank_score"))
    return pool, given.where("query_id % 5 <> 0 or pool_rank <> 1").drop("pool_rank")


def rerank_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an item's outside scores can't be used, if they can't."""
    pool, scores = _pool(retrieval.rrf_fusion(spark, sf_dir))
    return knowledge.score_faults(pool, scores, "doc_id")


def variant_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword, vector, fused and reranked rankings of each item in one table."""
    fused = retrieval.rrf_fusion(spark, sf_dir)
    keyword = fused.where("keyword_rank is not null").withColumn("none", F.lit(None).cast("double"))
    vector = fused.where("vector_rank is not null").withColumn("none", F.lit(None).cast("double"))
    pool, scores = _pool(fused)
    merged = knowledge.candidate_pool(fused, "doc_id", 100, with_reranker=False)
    return knowledge.variant_trace({
        "bm25": (keyword, "keyword_rank", "none"), "vector": (vector, "vector_rank", "none"), "rrf": (merged, "pool_rank", "fusion_score"),
        "reranked": (knowledge.reranked(pool, scores, "doc_id"), "final_rank", "rerank_score"),
    }, "doc_id")


def context_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the vectors of a query's label that its eight nearest hold, over all queries."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0")
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    cases = asked.select(F.col("vec_id").alias("query_id"), "label")
    items = vectors.select("vec_id", "label")
    found = evaluation.class_retention(knowledge.nearest(vectors, "vec_id", "embedding", queries, 8), cases, items, ["query_id"], "vec_id", "label")
    return found.withColumn("retention", F.round("retention", 9))


def call_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by provider over all events."""
    k = k_of()
    calls = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("embedding").alias("p"), F.lit(1).cast("long").alias("n")), F.when(k % 3 != 0, F.struct(F.col("event_type").alias("p"), (k % 3).alias("n"))))))
    return evaluation.call_totals(table(spark, sf_dir, "events").select(calls.alias("calls")), "calls")


def case_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of citations, coverage of causes and unsupported conclusions, over vectors as cases."""
    v, n = F.col("vec_id"), F.col("vec_id") % 3
    ids = lambda *offsets: F.array(*[v + o for o in offsets])
    rows = table(spark, sf_dir, "embeddings").select(
        ids(0, 1, 2, 3, 4, 5).alias("ranked"), F.when(n == 1, ids(1, 3, 5)).otherwise(ids(2, 9)).alias("relevant"), F.when(n == 0, ids(2, 3)).alias("applicable"),
        F.when(n == 2, ids(2, 7)).otherwise(ids(1, 3, 8)).alias("citations"), F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Loss "), F.lit("delay"))).alias("expected"),
        F.array(F.lit("DELAY")).alias("baseline"), F.when(v % 2 == 0, F.array(F.lit("loss"), F.lit("delay"))).otherwise(F.array(F.lit("other"))).alias("observed"), F.array(F.lit("Other")).alias("forbidden"),
    )
    found = evaluation.case_rates(rows)
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in found.dtypes])


CLAIM, LOWER = "(?i)according to", "abcdefghijklmnopqrstuvwxyz"


def answer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight checks of documents as answers."""
    d, none = F.col("doc_id"), F.array().cast("array<bigint>")
    head = F.substring(F.coalesce("text", F.lit("")), 1, 24)
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 6 == 5, F.concat(F.lit("According to it, "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("answer"),
        F.when(d % 10 == 9, F.lit(None)).when(d % 4 == 0, none).otherwise(F.array(d % 5, d % 7)).alias("citations"), F.when(d % 3 == 0, none).otherwise(F.array(d % 5, d % 7, d % 2)).alias("context"),
        F.array(d % 5, d % 2, F.lit(3).cast("long")).alias("approved"), F.array(F.translate(head, LOWER, LOWER.upper()), F.lit("a")).alias("facts"), F.when(d % 2 == 0, F.array("source")).otherwise(F.array(F.lit("e"))).alias("causes"),
        F.array(F.lit("zzz"), F.col("lang"), F.lit("--")).alias("forbidden"), F.array(F.lit("l")).alias("limitations"), F.array().cast("array<string>").alias("suggestions"),
    )
    return evaluation.answer_checks(rows, CLAIM).select("doc_id", *evaluation.CHECKS, "passed")


def symptom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say, as tags, hosts, time and action."""
    c = F.col("conv_id")
    said = F.concat(
        F.when(c % 5 == 0, "PS5 登录  慢 ").when(c % 5 == 1, "Video 卡顿 ").when(c % 5 == 2, "下载 ").otherwise(""), F.coalesce("text", F.lit("")),
        F.when(c % 3 == 0, F.concat(F.lit(" at "), F.col("turn").cast("string"), F.lit(".5 min on https://WWW.site"), (c % 9).cast("string"), F.lit(".example.com/x and a.org."))).otherwise(""),
    )
    rows = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id", "turn", symptoms.parsed(F.when(c % 11 == 0, symptoms.BLANK[0]).otherwise(said)).alias("s"))
    return rows.select(
        "conv_id", "turn", "s.provided", F.array_join("s.tags", ",").alias("tags"), "s.specificity", "s.time_offset_seconds", F.array_join("s.hosts", ",").alias("hosts"),
        F.array_join("s.profiles", ",").alias("profiles"), "s.action",
    )


def named_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that a name of one of three protocols belongs to."""
    events, k = table(spark, sf_dir, "events"), k_of()
    seen = lambda kind, name: events.where(F.col("event_type") == kind).select(name.alias("host"), F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), k.cast("string")).alias("ip"))
    dns, tls = seen("view", F.concat(F.lit("h"), (k % 4).cast("string"))), seen("click", F.when(k % 2 == 0, F.lit("tls")))
    http = seen("error", F.when(k % 3 == 0, "None").otherwise("web"))
    endpoints = events.groupBy(F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), k.cast("string")).alias("ip")).agg(F.count("*").alias("packets"))
    return symptoms.endpoints_of(endpoints, symptoms.observed_names(dns, tls, http))


def asked_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 users one of whose names was asked for."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit("Host"), (k_of() % 5).cast("string"))).alias("names"))
    asked = F.array(F.lit("host1"), F.lit("host3"), F.lit("other"))
    return symptoms.asked_endpoints(rows, "user_id", F.col("names"), asked).select("user_id", F.array_join("matched", ",").alias("matched"))


def primary_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cause of each user's case: proven, of the business, or the first candidate."""
    events, user = table(spark, sf_dir, "events"), F.col("user_id")
    cases = events.select("user_id").distinct().select("user_id", (user % 2 == 0).alias("targeted"), F.when(user % 4 != 0, F.concat(F.lit("business "), user.cast("string"))).alias("conclusion"))
    found = events.where("event_type in ('error', 'signup') and user_id % 5 <> 0").select(
        "user_id", F.col("event_id").alias("place"), F.concat("event_type", F.lit(" "), k_of().cast("string")).alias("cause"), F.col("value").alias("confidence"),
        F.when((k_of() % 40 == 0) & (user % 3 == 0), 1).otherwise(0).alias("n_evidence"),
    )
    return rules.primary(cases, found, "user_id").withColumn("confidence", F.round("confidence", 4))


def stage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dns, transport and tls stages of each user, and how sure a fault of each is."""
    n = lambda condition: F.count_if(condition)
    kind, k = F.col("event_type"), k_of()
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        n((kind == "error") & (k < 5)).alias("failures"), n((kind == "error") & (k > 96)).alias("unanswered"), n((kind == "signup") & (k > 95)).alias("resets"), n(kind == "view").alias("syn"),
        n(kind == "click").alias("syn_ack"), n((kind == "click") & (k % 20 == 0)).alias("retransmissions"), n((kind == "purchase") & (k > 97)).alias("alerts"), n(kind == "purchase").alias("client_hellos"),
        n(kind == "signup").alias("server_hellos"),
    )
    out = counts
    for stage in ("dns", "transport", "tls"):
        out = out.withColumn(stage, rules.stage_status(stage)).withColumn(f"{stage}_confidence", rules.stage_confidence(F.col(stage), F.col("user_id") % 7 == 0))
    return out.select("user_id", *[c for stage in ("dns", "transport", "tls") for c in (stage, f"{stage}_confidence")])


def bandwidths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promised, measured and bare bandwidths that texts name, in megabits per second."""
    k = k_of().cast("string")
    unit = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 == 1, "M").when(F.col("event_id") % 5 == 2, " gbps").when(F.col("event_id") % 5 == 3, "千兆").otherwise("KB/s")
    said = F.concat(F.lit("标准带宽： "), k, unit, F.lit("，实测 = "), k, F.lit(".5"), unit)
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said"), F.concat(F.lit(" "), k, unit, F.lit(" ")).alias("bare"))
    return rows.select("event_id", texts.standard_bandwidth(F.col("said")).alias("standard"), texts.actual_bandwidth(F.col("said")).alias("actual"), texts.bare_bandwidth(F.col("bare")).alias("bare"))


def address_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes of addresses, and the ends of printed flows."""
    k, e = k_of(), F.col("event_id")
    four = F.concat_ws(".", F.when(e % 4 == 0, 10).when(e % 4 == 1, 127).when(e % 4 == 2, 8).otherwise(230), k, e % 256, e % 300)
    six = F.when(e % 4 == 0, "::1").when(e % 4 == 1, "fe80::5").when(e % 4 == 2, "2001:4860::8888").otherwise("ff02::1")
    flow = network.parse_flow_id(F.concat(four, F.lit(":"), e, F.lit("<->["), six, F.lit("]:443")))
    return table(spark, sf_dir, "events").select("event_id", network.ipv4_scope(four).alias("four"), network.ipv6_scope(six).alias("six"), flow.alias("f")).select("event_id", "four", "six", "f.a_port", F.col("f.b").alias("b"))


def case_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What likeness to a case adds to vectors, by direction, ratio and shared features; and their boosted unit score."""
    v = F.col("vec_id")
    features = lambda a, b: F.create_map(F.lit("loss"), (v % a).cast("double"), F.lit("rtt"), (v % b).cast("double"))
    asked = F.create_map(F.lit("loss"), F.lit(3.0), F.lit("other"), F.lit(1.0))
    boost = knowledge.case_similarity(F.col("label") % 2 == 0, (v % 100).cast("double"), F.when(v % 3 != 0, F.lit(40.0)), features(7, 50), asked)
    score = fields.unit_score(F.get("embedding", F.lit(0)).cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(boost, 9).alias("boost"), F.round(score + boost, 6).alias("score"))


def personal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of users, more certain where what they complained of is in the rule's text."""
    k = k_of()
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.col("value").alias("confidence"), F.when(k % 2 == 0, F.array(F.lit("DNS"), F.lit("login"))).otherwise(F.array(F.lit("video"))).alias("tags"),
        F.when(k % 3 == 0, "dns failure").when(k % 3 == 1, "slow Video").otherwise("loss").alias("said"),
    )
    return rules.personalised(rows, F.col("tags"), F.col("said")).select("event_id", F.round("confidence", 4).alias("confidence"))


def target_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type that a case is about: by score, asked for, or of a profile."""
    scored = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("score"))
    found = [("score", rules.resolve_target(scored)), ("asked", rules.resolve_target(scored, asked="x.org", profile="y")), ("profile", rules.resolve_target(scored, profile="y"))]
    parts = [frame.select(F.lit(by).alias("chosen_by"), "family", "confidence", "ambiguous") for by, frame in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def stall_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of wanted hosts, and how severe a stall is."""
    host = fields.hostname(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", F.array(host, F.concat(F.lit("p"), (F.col("page_id") % 9).cast("string"), F.lit(".example.org"))).alias("hosts"))
    return rules.host_filter(rows, "hosts", ["p3.example.org", "p4.example.org", "ample.org"]).select("page_id", rules.anomaly_severity(F.col("page_id") % 5).alias("severity"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of packets from the least of the directions' first ones."""
    rows = packets.packets(spark, sf_dir)
    return capture.relative_to(rows, capture.timebase(rows)).select("frame", F.round("time", 6).alias("time"))


def bounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of texts that hold anything."""
    k, e = k_of(), F.col("event_id") % 8
    text = F.when(e == 0, "").when(e == 1, " -5 ").when(e == 2, "x").when(e == 3, "Infinity").when(e == 4, "0").when(e == 5, "1.5").when(e == 6, "NaN").when(e == 7, F.concat(F.lit(" "), k.cast("string"))).otherwise("x")
    known = text.isNotNull()
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(known, fields.clamped_long(text)).alias("whole"), F.when(known & (F.coalesce(e, F.lit(0)) != 6), fields.clamped_double(text)).alias("number"),
        fields.finite_double(text).alias("finite"), F.when(e.isNotNull(), ~known | fields.is_nonzero(text)).alias("marked"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        case_boost, personal_rules, target_family, stall_evidence, relative_times, bounded_numbers,
        bm25_columns, overfetch_topk, rerank_faults, variant_trace, context_retention, call_totals, case_rates, answer_checks, symptom_parse, named_endpoints,
        asked_endpoints, primary_cause, stage_states, bandwidths, address_scopes,
    )
}

_COSINE = "list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[])"
_NEAREST = f"""s AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id, b.label, round({_COSINE}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)"""
_K = "e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"
_POOL = f"""{retrieval._FUSION},
    bo AS (SELECT fu.*, round(fusion_score + CASE lang WHEN 'en' THEN 0.08 WHEN 'fr' THEN 0.03 ELSE 0 END, 9) AS boosted FROM fu LEFT JOIN documents USING (doc_id)),
    po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS pr FROM bo QUALIFY pr <= {POOL}),
    fa AS (SELECT query_id, CASE WHEN count(*) < 2 THEN 'few' WHEN query_id % 5 = 0 THEN 'missing' WHEN query_id % 5 = 1 THEN 'value' END AS fault FROM po GROUP BY 1),
    rr AS (SELECT po.*, fault, CASE WHEN fault IS NULL THEN ((doc_id * 37 + query_id * 11) % 101 / 100.0)::DOUBLE END AS given FROM po JOIN fa USING (query_id))"""
_TERMS = "[" + ", ".join(f"{{'tag': '{tag}', 'terms': [{', '.join(repr(t) for t in terms)}]}}" for tag, terms in symptoms.TAG_TERMS.items()) + "]"
_SIGNS = lambda x: f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+', '', 'g'))"
_HOLDS = lambda fact: f"({_SIGNS(fact)} <> '' AND contains({_SIGNS('answer')}, {_SIGNS(fact)}))"
_MBPS = """CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1000.0 WHEN 3 THEN 1000.0 ELSE 0.001 END"""

ORACLE_SQL = {
    "case_boost": """WITH b AS (SELECT vec_id, embedding, CASE WHEN label % 2 = 0 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN vec_id % 3 <> 0 THEN greatest(0.0, 0.08::DOUBLE * (1 - abs(vec_id % 100 - 40)::DOUBLE / 100)) ELSE 0 END
            + 0.08::DOUBLE * greatest(0.0, 1 - abs(vec_id % 7 - 3)::DOUBLE / greatest(vec_id % 7, 3, 1)) AS boost FROM embeddings)
        SELECT vec_id, round(boost, 9) AS boost, round(greatest(0, least(1, (embedding[1]::DOUBLE * 3 + 1) / 2)) + boost, 6) AS score FROM b""",
    "personal_rules": f"""WITH {_K} SELECT event_id, round(least(100.0, value + CASE WHEN (k % 2 = 0 AND k % 3 = 0) OR (k % 2 = 1 AND k % 3 = 1) THEN 8 ELSE 0 END), 4) AS confidence FROM e""",
    "target_family": """WITH s AS (SELECT event_type, sum(CAST(round(value * 100) AS BIGINT)) AS score FROM events GROUP BY 1),
        t AS (SELECT event_type, score - coalesce(lead(score) OVER (ORDER BY score DESC, event_type), score - 1000000) AS gap, row_number() OVER (ORDER BY score DESC, event_type) AS n FROM s)
        SELECT 'score' AS chosen_by, event_type AS family, CASE WHEN gap < 3 THEN 45.0::DOUBLE ELSE 72.0::DOUBLE END AS confidence, gap < 3 AS ambiguous FROM t WHERE n = 1
        UNION ALL SELECT 'asked', 'x.org', 100.0, false UNION ALL SELECT 'profile', 'y', 95.0, false""",
    "stall_evidence": """SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'high' ELSE 'medium' END AS severity FROM pages
        WHERE page_id % 9 IN (3, 4) OR regexp_matches(rtrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.'), '(^|[.])(p3[.]example[.]org|p4[.]example[.]org|ample[.]org)$')""",
    "relative_times": f"""WITH {packets.PACKETS}, f AS (SELECT direction, arg_min(epoch, frame) AS first FROM p GROUP BY 1)
        SELECT frame, round(epoch - (SELECT min(first) FROM f), 6) AS time FROM p""",
    "bounded_numbers": f"""WITH {_K} SELECT event_id, CASE event_id % 8 WHEN 7 THEN k ELSE 0 END AS whole, CASE event_id % 8 WHEN 3 THEN 'inf'::DOUBLE WHEN 5 THEN 1.5 WHEN 6 THEN NULL WHEN 7 THEN k::DOUBLE ELSE 0.0 END AS number,
        CASE event_id % 8 WHEN 1 THEN -5.0 WHEN 4 THEN 0.0 WHEN 5 THEN 1.5 WHEN 7 THEN k::DOUBLE END AS finite, event_id % 8 NOT IN (0, 4) AS marked FROM e""",
    "bm25_columns": f"""WITH
        ph AS (SELECT DISTINCT item_id AS query_id, trim(p) AS phrase FROM (SELECT item_id, unnest(CASE WHEN item_id % 4 <> 0 THEN string_split(lower(text), ' ') ELSE [lower(text)] END) AS p FROM benchmark)
               WHERE length(trim(p)) >= 3),
        co AS (SELECT doc_id, unnest([{{'c': 1, 't': lower(coalesce(source, ''))}}, {{'c': 2, 't': lower(coalesce(lang, ''))}}, {{'c': 3, 't': lower(coalesce(text, ''))}}], recursive := true) FROM documents),
        dl AS (SELECT doc_id, sum(greatest(length(t) - 2, 0)) AS len FROM co GROUP BY 1),
        st AS (SELECT count(*) AS total, avg(len) AS mean FROM dl),
        ch AS (SELECT doc_id, c, unnest(regexp_extract_all(t, '(?s).')) AS s, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS i FROM co),
        ah AS (SELECT doc_id, string_agg(s, '') OVER (PARTITION BY doc_id, c ORDER BY i ROWS BETWEEN CURRENT ROW AND 40 FOLLOWING) AS ahead FROM ch),
        short AS (SELECT DISTINCT phrase FROM ph WHERE length(phrase) <= 41), long AS (SELECT DISTINCT phrase FROM ph WHERE length(phrase) > 41),
        hits AS (SELECT doc_id, phrase, count(*) AS f FROM ah JOIN short ON left(ahead, 3) = left(phrase, 3) AND starts_with(ahead, phrase) GROUP BY 1, 2
                 UNION ALL SELECT doc_id, phrase, sum((length(t) - length(replace(t, phrase, ''))) // length(phrase)) FROM co JOIN long ON contains(t, phrase) GROUP BY 1, 2),
        idf AS (SELECT phrase, CASE WHEN count(*) * 2 >= total THEN 1e-6 ELSE ln((total - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM hits, st GROUP BY phrase, total),
        bm AS (SELECT query_id, doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
               FROM ph JOIN hits USING (phrase) JOIN idf USING (phrase) JOIN dl USING (doc_id), st GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS INT) AS rank FROM bm QUALIFY rank <= {KEPT}""",
    "overfetch_topk": f"""WITH {_NEAREST}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM n WHERE rank <= 3 * {KEPT} AND label % 3 <> 0)
        SELECT query_id, vec_id, round(score, 6) AS score, rank FROM f WHERE place <= {KEPT}""",
    "rerank_faults": f"WITH {_POOL} SELECT query_id, fault FROM fa",
    "variant_trace": f"""WITH {_POOL}
        SELECT query_id, 'bm25' AS variant, keyword_rank::INT AS rank, doc_id, NULL::DOUBLE AS score FROM fu WHERE keyword_rank IS NOT NULL
        UNION ALL SELECT query_id, 'vector', vector_rank::INT, doc_id, NULL FROM fu WHERE vector_rank IS NOT NULL
        UNION ALL SELECT query_id, 'rrf', row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id)::INT, doc_id, fusion_score FROM bo
        UNION ALL SELECT query_id, 'reranked', row_number() OVER (PARTITION BY query_id ORDER BY given DESC NULLS LAST, pr)::INT, doc_id, given FROM rr""",
    "context_retention": f"""WITH {_NEAREST} SELECT count(*) FILTER (label = query_label) AS relevant, count(*) FILTER (label = query_label AND rank <= 8) AS retained,
        round(count(*) FILTER (label = query_label AND rank <= 8) / count(*) FILTER (label = query_label), 9) AS retention FROM n""",
    "call_totals": f"""WITH {_K} SELECT 'embedding' AS provider, count(*) AS calls FROM e UNION ALL SELECT event_type, CAST(sum(k % 3) AS BIGINT) FROM e WHERE k % 3 <> 0 GROUP BY 1""",
    "case_rates": """WITH v AS (SELECT vec_id, vec_id % 3 AS n, vec_id % 2 = 0 AS even FROM embeddings),
        c AS (SELECT *, CASE n WHEN 1 THEN 2 ELSE 1 END AS cited, CASE n WHEN 2 THEN 2 ELSE 3 END AS cites, CASE n WHEN 1 THEN 2 ELSE 1 END AS hits FROM v),
        d AS (SELECT *, CASE n WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS good FROM c)
        SELECT count(*) AS n_cases, round(sum(good) / sum(cites), 9) AS citation_accuracy, round(sum(hits) / sum(hits), 9) AS applicability_accuracy,
               round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.5 END), 9) AS baseline_coverage, round(avg(CASE WHEN n = 0 OR even THEN 1.0 ELSE 0.0 END), 9) AS coverage,
               round(avg(CASE WHEN n = 0 OR even THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.5 END), 9) AS coverage_delta,
               round(sum(CASE WHEN even THEN 0 ELSE 1 END) / sum(CASE WHEN even THEN 2 ELSE 1 END), 9) AS unsupported_rate FROM d""",
    "answer_checks": f"""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'According to it, ' || coalesce(text, '') ELSE coalesce(text, '') END AS answer, source, lang, left(coalesce(text, ''), 24) AS head,
            doc_id % 10 = 9 AS broken, CASE WHEN doc_id % 10 = 9 OR doc_id % 4 = 0 THEN [] ELSE [doc_id % 5, doc_id % 7] END AS citations,
            CASE WHEN doc_id % 3 = 0 THEN [] ELSE [doc_id % 5, doc_id % 7, doc_id % 2] END AS context, [doc_id % 5, doc_id % 2, 3] AS approved FROM documents),
        b AS (SELECT doc_id, CASE WHEN len(context) > 0 THEN len(citations) > 0 ELSE len(citations) = 0 END AS citations_exist, list_has_all(context, citations) AS citations_in_context,
            list_has_all(approved, citations) AS citations_approved, {_HOLDS(f"translate(head, '{LOWER}', '{LOWER.upper()}')")} AND {_HOLDS("'a'")} AS facts_covered,
            CASE WHEN doc_id % 2 = 0 THEN {_HOLDS("coalesce(source, '')")} ELSE {_HOLDS("'e'")} END AS causes_covered,
            NOT ({_HOLDS("'zzz'")} OR {_HOLDS("coalesce(lang, '')")}) AS forbidden_absent, NOT broken AS structure_complete,
            len(context) > 0 OR NOT regexp_matches(answer, '{CLAIM}') AS claims_consistent FROM a)
        SELECT *, citations_exist AND citations_in_context AND citations_approved AND facts_covered AND causes_covered AND forbidden_absent AND structure_complete AND claims_consistent AS passed FROM b""",
    "symptom_parse": rf"""WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN '' ELSE lower(left(trim(regexp_replace(CASE conv_id % 5 WHEN 0 THEN 'PS5 登录  慢 ' WHEN 1 THEN 'Video 卡顿 ' WHEN 2 THEN '下载 ' ELSE '' END
            || coalesce(text, '') || CASE WHEN conv_id % 3 = 0 THEN ' at ' || turn || '.5 min on https://WWW.site' || (conv_id % 9) || '.example.com/x and a.org.' ELSE '' END, '\s+', ' ', 'g')), 500)) END AS t
            FROM conversations WHERE conv_id IS NOT NULL),
        g AS (SELECT *, list_transform(list_filter({_TERMS}, lambda x: len(list_filter(x.terms, lambda y: contains(t, y))) > 0), lambda x: x.tag) AS tags,
            list_sort(list_distinct(regexp_extract_all(t, '(?:https?://)?\b((?:[a-z0-9-]+\.)+[a-z]{{2,63}})\b', 1)))[:8] AS hosts,
            regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)\s*(秒|s|分钟|min)(?:左右|附近|后)?', 1) AS num, regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)\s*(秒|s|分钟|min)(?:左右|附近|后)?', 2) AS unit FROM s),
        w AS (SELECT *, CASE WHEN len(hosts) > 0 AND NOT list_contains(tags, 'web') THEN list_append(tags, 'web') ELSE tags END AS whole FROM g)
        SELECT conv_id, turn, t <> '' AS provided, array_to_string(whole, ',') AS tags, CASE WHEN len(whole) > 0 THEN 'specific' ELSE 'generic' END AS specificity,
            CASE WHEN num <> '' THEN num::DOUBLE * CASE WHEN unit IN ('分钟', 'min') THEN 60 ELSE 1 END END AS time_offset_seconds, array_to_string(hosts, ',') AS hosts,
            CASE WHEN contains(t, 'ps5') OR contains(t, 'ps4') OR contains(t, 'playstation') OR contains(t, 'psn') THEN 'playstation' ELSE '' END AS profiles,
            CASE WHEN list_contains(tags, 'login') THEN 'login' WHEN list_contains(tags, 'video') THEN 'play' WHEN list_contains(tags, 'download') THEN 'download' WHEN list_contains(tags, 'connect') THEN 'connect' ELSE 'general' END AS action
        FROM w""",
    "named_endpoints": f"""WITH {_K}, p AS (SELECT *, '10.0.' || (user_id % 7) || '.' || k AS ip FROM e)
        SELECT ip, count(*) AS packets FROM p GROUP BY 1
        HAVING count(*) FILTER (event_type = 'view' OR (event_type = 'click' AND k % 2 = 0) OR (event_type = 'error' AND k % 3 <> 0)) > 0""",
    "asked_endpoints": f"""WITH {_K}, u AS (SELECT user_id, max(CASE WHEN k % 5 = 1 THEN 1 END) AS one, max(CASE WHEN k % 5 = 3 THEN 1 END) AS three FROM e GROUP BY 1)
        SELECT user_id, concat_ws(',', CASE WHEN one = 1 THEN 'host1' END, CASE WHEN three = 1 THEN 'host3' END) AS matched FROM u WHERE one = 1 OR three = 1 ORDER BY 1 LIMIT {symptoms.MOST_ENDPOINTS}""",
    "primary_cause": f"""WITH {_K}, c AS (SELECT DISTINCT user_id FROM e),
        f AS (SELECT user_id, event_id, event_type || ' ' || k AS cause, value, k % 40 = 0 AND user_id % 3 = 0 AS proven FROM e WHERE event_type IN ('error', 'signup') AND user_id % 5 <> 0),
        g AS (SELECT user_id, arg_min(cause, event_id) AS first, arg_min(value, event_id) AS first_value, arg_min(cause, event_id) FILTER (proven) AS good, arg_min(value, event_id) FILTER (proven) AS good_value FROM f GROUP BY 1)
        SELECT user_id, CASE WHEN good IS NOT NULL THEN good WHEN user_id % 2 = 0 AND user_id % 4 <> 0 THEN 'business ' || user_id ELSE coalesce(first, '{rules.NO_CAUSE}') END AS cause,
            round(coalesce(good_value, first_value, 30.0), 4) AS confidence,
            CASE WHEN good IS NOT NULL THEN 'evidence' WHEN user_id % 2 = 0 AND user_id % 4 <> 0 THEN 'business' WHEN first IS NOT NULL THEN 'candidate' ELSE 'none' END AS basis FROM c LEFT JOIN g USING (user_id)""",
    "stage_states": f"""WITH {_K}, n AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND (k < 5 OR k > 96)) AS bad, count(*) FILTER (event_type = 'signup' AND k > 95) AS resets, count(*) FILTER (event_type = 'view') AS syn,
            count(*) FILTER (event_type = 'click') AS syn_ack, count(*) FILTER (event_type = 'click' AND k % 20 = 0) AS again, count(*) FILTER (event_type = 'purchase' AND k > 97) AS alerts,
            count(*) FILTER (event_type = 'purchase') AS hello, count(*) FILTER (event_type = 'signup') AS answer FROM e GROUP BY 1),
        s AS (SELECT user_id, CASE WHEN bad > 0 THEN 'failed' ELSE 'ok' END AS dns, CASE WHEN resets > 0 OR syn > syn_ack + 2 THEN 'failed' WHEN again > 0 THEN 'degraded' ELSE 'ok' END AS transport,
            CASE WHEN alerts > 0 OR hello > answer + 1 THEN 'failed' ELSE 'ok' END AS tls FROM n)
        SELECT user_id, {", ".join(f"{s}, CASE WHEN user_id % 7 <> 0 THEN CASE {s} WHEN 'failed' THEN 96.0::DOUBLE WHEN 'degraded' THEN 84.0::DOUBLE END END AS {s}_confidence" for s in ("dns", "transport", "tls"))} FROM s""",
    "bandwidths": f"WITH {_K} SELECT event_id, k * {_MBPS}::DOUBLE AS standard, (k || '.5')::DOUBLE * {_MBPS}::DOUBLE AS actual, k * {_MBPS}::DOUBLE AS bare FROM e",
    "address_scopes": f"""WITH {_K} SELECT event_id, CASE WHEN event_id % 300 > 255 THEN 'unknown' ELSE CASE event_id % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'loopback' WHEN 2 THEN 'public' ELSE 'multicast' END END AS four,
        CASE event_id % 4 WHEN 0 THEN 'loopback' WHEN 1 THEN 'private' WHEN 2 THEN 'public' ELSE 'multicast' END AS six,
        CASE WHEN event_id <= 65535 THEN event_id::INT END AS a_port, CASE WHEN event_id <= 65535 THEN CASE event_id % 4 WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::5' WHEN 2 THEN '2001:4860::8888' ELSE 'ff02::1' END END AS b FROM e""",
}
