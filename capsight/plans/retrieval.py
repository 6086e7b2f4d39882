"""Knowledge queries over ``documents``, ``benchmark``, ``embeddings`` and ``labels``: chunks, keyword and vector search, fusion, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capsight.functions import fields, texts
from capsight.operators import knowledge
from capsight.plans.tables import table
from capsight.sources.storage import kept

KEPT = 10
MODEL = "m"


def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with wording that tries to steer a reader model."""
    flags = F.array_join(texts.risk_flags(F.col("text")), ",")
    return table(spark, sf_dir, "documents").select("doc_id", flags.alias("flags"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their sensitive spans replaced."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.redacted(F.col("text")).alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs per document, and the length of the longest."""
    parts = texts.paragraphs(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(parts).cast("long").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform(parts, lambda p: F.length(p))), F.lit(0)).cast("long").alias("longest")
    )


def clean_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, bounded texts and byte counts of pages."""
    return table(spark, sf_dir, "pages").select(
        "page_id", fields.hostname(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)).alias("host"), fields.bounded(F.col("url"), 20).alias("short_url"),
        F.octet_length("html").cast("long").alias("n_bytes"),
    )


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in chunks."""
    return knowledge.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


def version_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each source's texts in order."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("source", F.col("doc_id").alias("chunk_index"), F.sha2("text", 256).alias("content_hash"))
    return knowledge.version_hash(rows, "source")


def applicability_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose constraint, made of lang and source, holds for French."""
    rows = table(spark, sf_dir, "documents").withColumn(
        "constraint", F.when(F.col("source") < "src15", F.array(F.upper("lang"), "source")).otherwise(F.array().cast("array<string>"))
    )
    return rows.where(knowledge.applies("constraint", F.lit("fr"))).select("doc_id", "lang", "source")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, phrase): the distinct words of each item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), " ")).alias("phrase")).distinct()


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.keyword_top(table(spark, sf_dir, "documents"), "doc_id", "text", _phrases(spark, sf_dir), KEPT)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each item's phrases best."""
    return _keyword(spark, sf_dir)


def _vector(spark: SparkSession, sf_dir: str, n: int, every: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return knowledge.nearest(vectors, "vec_id", "embedding", asked, n)


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors nearest to every twentieth one: the query set, in blocks of about QUERY_BOUND, against all rows."""
    return _vector(spark, sf_dir, KEPT, 20).withColumn("score", F.round("score", 6))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rankings for the benchmark's items; an item's vector is that of its id. The result, a few rows an item, is written: callers read it several times."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.join(items, "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = knowledge.nearest(vectors, "vec_id", "embedding", asked, KEPT).withColumnRenamed("vec_id", "doc_id")
    fused = knowledge.fused(_keyword(spark, sf_dir), found, "doc_id")
    return kept(fused.withColumn("fusion_score", F.round("fusion_score", 9)), "fused")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of keyword and vector rankings, with a boost by authority."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang") == "en", "high").when(F.col("lang") == "fr", "medium").otherwise("low").alias("authority"))
    out = _fused(spark, sf_dir).join(docs, "doc_id", "left")
    return out.withColumn("boosted_score", F.round(F.col("fusion_score") + knowledge.authority_boost(F.col("authority")), 9)).drop("authority")


def diversify_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each fused ranking fits eight results and 12 kB, the first of each language ahead."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes"))
    pool = knowledge.top(_fused(spark, sf_dir).withColumnRenamed("fusion_score", "score"), "doc_id", 100, True, "pool_rank").join(docs, "doc_id")
    return knowledge.selected(pool, "doc_id", "lang", "pool_rank", "n_bytes", budget=12_000)


def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit mean of each label's vectors, one row per position."""
    found = knowledge.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", F.posexplode("vector").alias("position", "x")).withColumn("x", F.round("x", 5))


def embedding_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source, and those of them that have a label row."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = table(spark, sf_dir, "documents").join(labels.distinct(), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("labelled").alias("n_labelled"))


def pending_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose even-numbered embeddings don't cover their present text."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    done = rows.where("chunk_id % 2 = 0").select("chunk_id", F.when(F.col("chunk_id") % 6 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.lit(MODEL).alias("model_name"), F.lit(64).alias("dimension"))
    return knowledge.pending_index(rows, done, MODEL, 64).select("chunk_id")


def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as knowledge ids: each document is saved, and published or disabled by its id."""
    log = table(spark, sf_dir, "documents").select(
        F.col("source").alias("knowledge_id"), F.col("doc_id").alias("version_id"), F.col("doc_id").alias("seq"),
        F.when(F.col("doc_id") % 5 == 0, "save").when(F.col("doc_id") % 17 == 0, "disable").otherwise("publish").alias("action"),
    )
    return knowledge.version_states(log)


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of benchmark items from the documents of the same id, and why they fail."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("chunk_id"), F.substring("text", 1, 10).alias("quote"))
    bundle = items.where("chunk_id % 3 <> 0").select("query_id", "chunk_id")
    active = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return knowledge.checked_citations(items, bundle, active).select("query_id", "chunk_id", "reason")


QUERIES = {
    f.__name__: f
    for f in (
        risk_flags, redact_text, paragraphs, clean_fields, chunk_documents, version_hash, applicability_filter, bm25_topk, vector_topk, rrf_fusion,
        diversify_select, mean_vector, embedding_coverage, pending_index, version_states, citation_check,
    )
}

_FLAGS = " || ".join(f"CASE WHEN regexp_matches(text, '{pattern}') THEN '{name},' ELSE '' END" for name, pattern in texts.RISKS)
_KEYWORD = f"""
    ph AS (SELECT DISTINCT query_id, phrase FROM (SELECT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS phrase FROM benchmark) WHERE length(phrase) >= 3),
    dl AS (SELECT doc_id, t, greatest(length(t) - 2, 0) AS len FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)),
    st AS (SELECT count(*) AS total, avg(len) AS mean FROM dl),
    ch AS (SELECT doc_id, len, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) AS i FROM dl),
    ah AS (SELECT doc_id, len, string_agg(c, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 40 FOLLOWING) AS ahead FROM ch),
    hits AS (SELECT doc_id, phrase, len, count(*) AS f
             FROM ah JOIN (SELECT DISTINCT phrase FROM ph) ON left(ahead, 3) = left(phrase, 3) AND starts_with(ahead, phrase) GROUP BY 1, 2, 3),
    idf AS (SELECT phrase, CASE WHEN count(*) * 2 >= total THEN 1e-6 ELSE ln((total - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM hits, st GROUP BY phrase, total),
    bm AS (SELECT query_id, doc_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 9) AS score
           FROM ph JOIN hits USING (phrase) JOIN idf USING (phrase), st GROUP BY 1, 2),
    kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS INT) AS rank FROM bm QUALIFY rank <= {KEPT})"""
_COSINE = "list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[])"
_FUSION = f"""{_KEYWORD},
    vs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COSINE}, 9) AS score FROM embeddings a JOIN benchmark ON a.vec_id = item_id, embeddings b),
    vk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM vs QUALIFY rank <= {KEPT}),
    fu AS (SELECT coalesce(kw.query_id, vk.query_id) AS query_id, coalesce(kw.doc_id, vk.doc_id) AS doc_id, kw.rank AS keyword_rank, vk.rank AS vector_rank,
                  round(coalesce(1.0 / (60 + kw.rank), 0) + coalesce(1.0 / (60 + vk.rank), 0), 9)::DOUBLE AS fusion_score
           FROM kw FULL JOIN vk ON kw.query_id = vk.query_id AND kw.doc_id = vk.doc_id)"""

ORACLE_SQL = {
    "risk_flags": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN rtrim({_FLAGS}, ',') ELSE '' END AS flags FROM documents",
    "paragraphs": r"""WITH p AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n\s*\n')) AS x FROM documents),
        q AS (SELECT doc_id, trim(x, ' ') AS x FROM p)
        SELECT doc_id, count(*) FILTER (x <> '') AS n_paragraphs, coalesce(max(length(x)), 0) AS longest FROM q GROUP BY doc_id""",
    "clean_fields": """WITH p AS (SELECT *, rtrim(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '.') AS h FROM pages)
        SELECT page_id, CASE WHEN regexp_full_match(h, '[a-z0-9._-]+') THEN h ELSE '' END AS host, left(trim(url), 20) AS short_url, strlen(html) AS n_bytes FROM p""",
    "version_hash": r"""SELECT source, sha256(string_agg(sha256(text), chr(10) || chr(10) ORDER BY doc_id)) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "applicability_filter": "SELECT doc_id, lang, source FROM documents WHERE NOT coalesce(source < 'src15', false) OR lower(lang) = 'fr' OR lower(source) = 'fr'",
    "bm25_topk": f"WITH {_KEYWORD} SELECT query_id, doc_id, score, rank FROM kw",
    "vector_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COSINE}, 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= {KEPT})
        SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r""",
    "rrf_fusion": f"""WITH {_FUSION} SELECT fu.*, round(fusion_score + CASE lang WHEN 'en' THEN 0.08 WHEN 'fr' THEN 0.03 ELSE 0 END, 9) AS boosted_score
        FROM fu LEFT JOIN documents USING (doc_id)""",
    "diversify_select": f"""WITH RECURSIVE {_FUSION},
        po AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS r FROM fu),
        ld AS (SELECT po.*, coalesce(strlen(text), 0) AS b, row_number() OVER (PARTITION BY query_id, lang ORDER BY r) > 1 AS later FROM po JOIN documents USING (doc_id)),
        od AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, r) AS n FROM ld),
        w AS (SELECT query_id, doc_id, n, CASE WHEN b <= 12000 THEN b ELSE 0 END AS used, CASE WHEN b <= 12000 THEN 1 ELSE 0 END AS taken,
                     CASE WHEN b <= 12000 THEN NULL ELSE 'context_budget' END AS reason FROM od WHERE n = 1
              UNION ALL SELECT od.query_id, od.doc_id, od.n, CASE WHEN taken < 8 AND used + b <= 12000 THEN used + b ELSE used END,
                     CASE WHEN taken < 8 AND used + b <= 12000 THEN taken + 1 ELSE taken END,
                     CASE WHEN taken >= 8 THEN 'final_top_k' WHEN used + b > 12000 THEN 'context_budget' END
              FROM w JOIN od ON od.query_id = w.query_id AND od.n = w.n + 1)
        SELECT query_id, doc_id, CASE WHEN reason IS NULL THEN CAST(taken AS INT) END AS place, reason FROM w""",
    "mean_vector": """WITH f AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS n FROM embeddings),
        m AS (SELECT label, n, avg(x) AS x FROM f GROUP BY 1, 2)
        SELECT label, CAST(n AS INT) AS position, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""",
    "embedding_coverage": """SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled
        FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""",
    "pending_index": "SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 2 <> 0 OR doc_id % 6 = 0 OR text IS NULL",
    "version_states": """WITH g AS (SELECT source, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'save' WHEN doc_id % 17 = 0 THEN 'disable' ELSE 'publish' END AS a FROM documents),
        c AS (SELECT source, max(doc_id) AS doc_id FROM g WHERE a = 'publish' GROUP BY 1)
        SELECT g.doc_id AS version_id, CASE a WHEN 'disable' THEN 'disabled' WHEN 'save' THEN 'draft' ELSE CASE WHEN c.doc_id IS NULL THEN 'superseded' ELSE 'approved' END END AS status
        FROM g LEFT JOIN c USING (doc_id)""",
    "citation_check": r"""SELECT item_id AS query_id, item_id AS chunk_id, CASE WHEN item_id % 3 = 0 THEN 'not_in_bundle' WHEN d.text IS NULL THEN 'not_active'
        WHEN NOT contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(left(b.text, 10), '\s+', ' ', 'g'))) THEN 'quote_missing' END AS reason
        FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id AND d.lang = 'en'""",
}
