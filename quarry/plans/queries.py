"""Named queries over the driver's tables, each with its SQL.

The tables have no departments, uploaders or chunks, so a registry is derived from
``documents`` by fixed rules (see ``registry_of``); everything runs on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import access, answers, chunking, facts, passages, reports, retrieval, tables, vector_index
from ..session import spread, table
from ..streaming import streams
from .registry import register

ME = access.Policy(user_id="user3", role="analyst", department_id="dept1")
FOCUS = {"primary": ["the and", "license"], "support": ["ing"], "penalty": ["copyright"]}
SECTIONS = {"license": "(license|copyright|apache)", "contact": "(mail|example)", "loud": "(!!|###)"}
PRIORITY = {"license": 3, "contact": 2, "loud": 1}


def registry_of(docs: DataFrame) -> DataFrame:
    """Documents as a registry: department, uploader, visibility, universe, status and time by the id."""
    i = F.col("doc_id")
    return docs.select(
        i.cast("string").alias("id"),
        F.concat("source", F.lit("-"), (i % 50).cast("string")).alias("filename"),
        F.sha2("text", 256).alias("file_hash"),
        F.concat(F.lit("dept"), (i % 4).cast("string")).alias("department_id"),
        F.concat(F.lit("user"), (i % 7).cast("string")).alias("uploaded_by"),
        F.when(i % 5 == 0, "private").when(i % 11 == 0, "restricted").otherwise("department").alias("visibility"),
        F.when(i % 3 != 0, F.concat(F.lit("u"), (i % 6).cast("string"))).alias("universe_id"),
        F.when(i % 13 == 0, "queued").otherwise("indexed").alias("status"),
        (i % 9).cast("int").alias("chunk_count"),
        F.timestamp_seconds(i * 3600).alias("created_at"),
    )


REGISTRY = """
registry AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source || '-' || (doc_id % 50) AS filename, sha256(text) AS file_hash,
         'dept' || (doc_id % 4) AS department_id, 'user' || (doc_id % 7) AS uploaded_by,
         CASE WHEN doc_id % 5 = 0 THEN 'private' WHEN doc_id % 11 = 0 THEN 'restricted' ELSE 'department' END AS visibility,
         CASE WHEN doc_id % 3 <> 0 THEN 'u' || (doc_id % 6) END AS universe_id,
         CASE WHEN doc_id % 13 = 0 THEN 'queued' ELSE 'indexed' END AS status,
         CAST(doc_id % 9 AS INTEGER) AS chunk_count, doc_id * 3600 AS created
  FROM documents)"""
SEEN = "((visibility = 'department' AND department_id = 'dept1') OR (visibility = 'private' AND uploaded_by = 'user3'))"


def _query_vector(items: DataFrame, key: int = 0) -> list[float]:
    row = items.where(F.col("vec_id") == key).select("embedding").head()
    return [float(x) for x in row[0]] if row else [0.0]


def _said(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


@register("topk_cosine", f"""
SELECT e.vec_id, e.label, {_COSINE.format(a='e.embedding', b='q.embedding')} AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
ORDER BY score DESC, e.vec_id LIMIT 25""")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(items, _query_vector(items), 25).select("vec_id", "label", "score")


@register("filtered_topk", f"""
SELECT e.vec_id, e.label, {_COSINE.format(a='e.embedding', b='q.embedding')} AS score
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
WHERE e.label IN (1, 3, 5) ORDER BY score DESC, e.vec_id LIMIT 10""")
def filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(items, _query_vector(items), 10, F.col("label").isin(1, 3, 5)).select("vec_id", "label", "score")


@register("multi_query_topk", f"""
SELECT query_id, vec_id, score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.format(a='e.embedding', b='q.embedding')} AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id) AS INTEGER) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)
WHERE rank <= 6""")
def multi_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    queries = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k_many(items, queries, 6)


@register("indexed_topk")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As multi_query_topk, ten for each, from the cells of an index that the query fits and assigns itself."""
    items = table(spark, sf_dir, "embeddings")
    queries = items.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    centroids = vector_index.fit(items)
    return vector_index.search(vector_index.assigned(items, centroids), centroids, queries, 10, vector_index.probes_for(items, centroids))


_PROBES = f"""
p AS (SELECT e.vec_id, e.label, {_COSINE.format(a='e.embedding', b='q.embedding')} AS score
      FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
u AS ((SELECT *, 0 AS probe FROM p WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 10)
      UNION ALL (SELECT *, 1 AS probe FROM p WHERE label = 2 ORDER BY score DESC, vec_id LIMIT 10)
      UNION ALL (SELECT *, 2 AS probe FROM p ORDER BY score DESC, vec_id LIMIT 25)),
d AS (SELECT vec_id, label, score, CAST(probe AS INTEGER) AS probe FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY probe) = 1)"""


def _probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings")
    probes = [(F.col("label") == 1, 10), (F.col("label") == 2, 10), (None, 25)]
    return retrieval.multi_probe(items, _query_vector(items), probes).select("vec_id", "label", "score", "probe")


@register("multiprobe_dedupe", f"WITH {_PROBES} SELECT * FROM d")
def multiprobe_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir)


@register("boosted_hits", f"""
WITH {_PROBES} SELECT *, round(score + CASE WHEN label = 1 THEN 0.22 WHEN label = 7 THEN -0.25 ELSE 0 END, 6) AS boosted FROM d
ORDER BY boosted DESC, probe, score DESC, vec_id LIMIT 6""")
def boosted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bonus = F.when(F.col("label") == 1, 0.22).when(F.col("label") == 7, -0.25).otherwise(0.0)
    return retrieval.boosted(_probed(spark, sf_dir), 6, bonus)


@register("reranked_hits", f"""
WITH {_PROBES}, r AS (SELECT *, CAST(label AS DOUBLE) / 10 AS rerank, CASE WHEN label = 1 THEN 0.22 ELSE 0.0 END AS bonus FROM d)
SELECT vec_id, label, probe, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY probe ORDER BY CASE WHEN most < 0.01 THEN score ELSE rerank + bonus END DESC, bonus DESC, score DESC, vec_id) AS INTEGER) AS rank
  FROM (SELECT *, max(rerank) OVER (PARTITION BY probe) AS most FROM r))
WHERE rank <= 4""")
def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _probed(spark, sf_dir).withColumns({"rerank": F.col("label").cast("double") / 10, "bonus": F.when(F.col("label") == 1, 0.22).otherwise(0.0)})
    return retrieval.reranked(hits, 4, True, ["probe"], ["vec_id"]).select("vec_id", "label", "probe", "rank")


@register("focus_bonus", """
WITH n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\\w\\s'']', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, round(CAST((CASE WHEN contains(t, 'the and') THEN 0.22 ELSE 0 END) + (CASE WHEN contains(t, 'license') THEN 0.22 ELSE 0 END)
  + (CASE WHEN contains(t, 'ing') THEN 0.08 ELSE 0 END) - (CASE WHEN contains(t, 'copyright') THEN 0.25 ELSE 0 END) AS DOUBLE), 4) AS bonus FROM n""")
def focus_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.focus(spread(table(spark, sf_dir, "documents")), "text", **FOCUS).select("doc_id", "bonus")


@register("section_detect", """
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a >= b AND a >= c THEN 'license' WHEN b >= c THEN 'contact' ELSE 'loud' END AS section
FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '(license|copyright|apache)')) AS a,
             len(regexp_extract_all(lower(text), '(mail|example)')) AS b, len(regexp_extract_all(lower(text), '(!!|###)')) AS c FROM documents)""")
def section_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.detect_section(F.col("text"), SECTIONS, PRIORITY).alias("section"))


@register("char_ratios", r"""
SELECT doc_id, round(CASE WHEN n > 0 THEN readable / n ELSE 0 END, 4) AS readable_ratio, CAST(0 AS DOUBLE) AS arabic_ratio,
       CAST(CASE WHEN length(t) = 0 THEN -1000 ELSE least(length(t) // 80, 40) + least(digits, 30) END AS INTEGER) AS quality
FROM (SELECT doc_id, length(regexp_replace(text, '[\s]+', '', 'g')) AS n, length(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS readable,
             regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t,
             length(regexp_replace(text, '[^0-9]+', '', 'g')) AS digits FROM documents)""")
def char_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.round(T.readable_ratio(text), 4).alias("readable_ratio"), F.round(T.arabic_ratio(text), 4).alias("arabic_ratio"), T.quality_score(text).alias("quality")
    )


@register("short_fragments", r"""
SELECT doc_id, round(CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda x: length(x) <= 6 AND regexp_matches(x, '[A-Za-zÀ-ÖØ-öø-ÿ]'))) / len(l) END, 6) AS ratio
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)""")
def short_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.round(T.short_fragment_ratio(F.col("text")), 6).alias("ratio"))


@register("noise_filter", r"""
SELECT conv_id, turn FROM conversations
WHERE NOT (trim(text) = '' OR regexp_full_match(trim(text), '[\d\s/().,:;-]+') OR regexp_full_match(lower(trim(text)), '[-–—\s]*page\s+\d+[-–—\s]*')
  OR (contains(lower(text), 'signature et cachet du soumissionnaire') AND length(trim(text)) < 180) OR (starts_with(lower(trim(text)), 'tunis, le') AND length(trim(text)) < 80))""")
def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(~T.is_noise(F.col("text"))).select("conv_id", "turn")


@register("clean_text", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_text(F.col("text")), 256).alias("digest"))


@register("fold_text", r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[`’]', '''', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("digest"))


@register("hard_slices", r"""
SELECT doc_id, place, length(piece) AS n, sha256(piece) AS digest FROM (
  SELECT doc_id, CAST(k AS INTEGER) AS place, regexp_replace(substring(t, k * 1200 + 1, 1200), '^\s+|\s+$', '', 'g') AS piece
  FROM (SELECT doc_id, text AS t, unnest(range(0, (length(text) + 1199) // 1200)) AS k FROM documents))
WHERE piece <> ''""")
def hard_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.hard_slices(F.col("text"), 1200)).alias("place", "piece"))
    return pieces.select("doc_id", "place", F.char_length("piece").cast("long").alias("n"), F.sha2("piece", 256).alias("digest"))


@register("chunk_documents")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spread(table(spark, sf_dir, "documents")).select("doc_id", F.lit(0).alias("page_seq"), F.lit("1").alias("page"), "text")
    return chunking.chunks(entries).select("doc_id", "chunk_index", "id", F.char_length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@register("exact_dedupe", "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@register("visible_documents", f"WITH {REGISTRY} SELECT id, filename, department_id, visibility FROM registry WHERE {SEEN}")
def visible_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.visible(registry_of(table(spark, sf_dir, "documents")), ME).select("id", "filename", "department_id", "visibility")


@register("count_visible", f"WITH {REGISTRY} SELECT count(*) AS n FROM registry WHERE {SEEN} AND universe_id = 'u1'")
def count_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.count_visible(registry_of(table(spark, sf_dir, "documents")), ME, "u1")


@register("viewable_duplicates", f"""
WITH {REGISTRY} SELECT u.id FROM registry u WHERE u.status = 'queued' AND EXISTS (
  SELECT 1 FROM registry d WHERE d.status = 'indexed' AND d.file_hash = u.file_hash
  AND CASE WHEN d.visibility = 'private' THEN d.uploaded_by = 'user3' ELSE d.department_id = 'dept1' END)""")
def viewable_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry_of(table(spark, sf_dir, "documents"))
    return access.visible_duplicates(rows.where("status = 'queued'"), rows.where("status = 'indexed'"), ME).select("id")


@register("latest_by_source", f"""
WITH {REGISTRY} SELECT filename, arg_max(id, created) AS id FROM registry
WHERE status = 'indexed' AND universe_id IS NULL AND {SEEN} GROUP BY filename""")
def latest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.latest_by_source(registry_of(table(spark, sf_dir, "documents")), ME).select("filename", "id")


@register("search_scope", f"""
WITH {REGISTRY} SELECT visibility, count(*) AS n FROM registry
WHERE universe_id = 'u2' AND ((visibility = 'department' AND department_id IN ('dept1', 'dept2')) OR (visibility = 'private' AND uploaded_by = 'user3')) GROUP BY visibility""")
def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry_of(table(spark, sf_dir, "documents")).withColumnRenamed("department_id", "department")
    where = access.search_filter(departments=["dept1", "dept2"], universe="u2", user_id="user3", is_admin=False)
    return rows.where(where).groupBy("visibility").agg(F.count("*").alias("n"))


@register("universe_counts", f"""
WITH {REGISTRY}, u AS (SELECT DISTINCT universe_id AS id FROM registry WHERE universe_id IS NOT NULL),
c AS (SELECT 'u' || (conv_id % 6) AS universe_id, count(*) AS conversations FROM conversations GROUP BY 1),
d AS (SELECT universe_id, count(*) AS documents FROM registry WHERE {SEEN} GROUP BY 1)
SELECT u.id, coalesce(documents, 0) AS documents, coalesce(conversations, 0) AS conversations
FROM u LEFT JOIN d ON u.id = d.universe_id LEFT JOIN c ON u.id = c.universe_id""")
def universe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry_of(table(spark, sf_dir, "documents"))
    universes = docs.where("universe_id is not null").select(F.col("universe_id").alias("id")).distinct()
    talks = table(spark, sf_dir, "conversations").select(F.concat(F.lit("u"), (F.col("conv_id") % 6).cast("string")).alias("universe_id"))
    return access.universe_counts(universes, docs, talks, ME).select("id", "documents", "conversations")


_CHUNKS = "chunks AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM (SELECT doc_id, unnest(range(0, quality + toxic + 1)) FROM labels) UNION ALL SELECT CAST(-1 - item_id AS VARCHAR) FROM benchmark)"


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a registry of the documents only partly knows."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("quality") + F.col("toxic"))).alias("_k"))
    strange = table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).cast("string").alias("doc_id"))
    return own.select("doc_id").unionByName(strange)


@register("reconcile", f"""
WITH {REGISTRY}, {_CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT coalesce(id, doc_id) AS id, coalesce(n, 0) AS n_chunks,
  CASE WHEN id IS NULL THEN 'orphan' WHEN doc_id IS NULL AND chunk_count > 0 THEN 'missing' WHEN doc_id IS NOT NULL AND status <> 'indexed' THEN 'status_mismatch'
       WHEN coalesce(n, 0) <> chunk_count THEN 'count_mismatch' ELSE 'ok' END AS state
FROM registry FULL OUTER JOIN c ON id = doc_id""")
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reconciliation(registry_of(table(spark, sf_dir, "documents")), _chunk_rows(spark, sf_dir))


@register("repairs", f"""
WITH {REGISTRY}, {_CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
j AS (SELECT id, status, chunk_count, coalesce(n, 0) AS new_count, CASE WHEN n > 0 THEN 'indexed' WHEN status = 'indexed' THEN 'failed' ELSE status END AS new_status
      FROM registry LEFT JOIN c ON id = doc_id)
SELECT id, new_status, new_count FROM j WHERE new_status <> status OR (new_count <> chunk_count AND new_count > 0)""")
def repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repairs(registry_of(table(spark, sf_dir, "documents")), _chunk_rows(spark, sf_dir), missing_failed=True)


@register("apply_repairs", f"""
WITH {REGISTRY}, {_CHUNKS}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id),
j AS (SELECT id, status, chunk_count, coalesce(n, 0) AS m, CASE WHEN n > 0 THEN 'indexed' WHEN status = 'indexed' THEN 'failed' ELSE status END AS s FROM registry LEFT JOIN c ON id = doc_id)
SELECT id, CASE WHEN s <> status OR (m <> chunk_count AND m > 0) THEN s ELSE status END AS status,
       CAST(CASE WHEN s <> status OR (m <> chunk_count AND m > 0) THEN m ELSE chunk_count END AS BIGINT) AS chunk_count FROM j""")
def apply_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry_of(table(spark, sf_dir, "documents"))
    changes = reports.repairs(docs, _chunk_rows(spark, sf_dir), missing_failed=True).toDF("id", "status", "chunk_count")
    return tables.update(docs, changes, "id").select("id", "status", F.col("chunk_count").cast("long").alias("chunk_count"))


@register("orphan_lineitems", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def orphan_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return reports.orphans(table(spark, sf_dir, "lineitem"), closed, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("page_gaps", """
WITH m AS (SELECT DISTINCT o_custkey, CAST(month(o_orderdate) AS INTEGER) AS p FROM orders), l AS (SELECT o_custkey, max(p) AS last FROM m GROUP BY 1),
g AS (SELECT o_custkey, unnest(range(1, last + 1)) AS p FROM l),
x AS (SELECT g.* FROM g ANTI JOIN m USING (o_custkey, p)),
i AS (SELECT o_custkey, p, p - row_number() OVER (PARTITION BY o_custkey ORDER BY p) AS island FROM x),
r AS (SELECT o_custkey, min(p) AS a, max(p) AS b FROM i GROUP BY o_custkey, island)
SELECT l.o_custkey, coalesce(string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a), '') AS missing, CAST(coalesce(sum(b - a + 1), 0) AS INTEGER) AS n_missing
FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey GROUP BY l.o_custkey""")
def page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.page_gaps(table(spark, sf_dir, "orders").select("o_custkey", F.month("o_orderdate").alias("month")), "o_custkey", "month")


@register("paginated_orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 40")
def paginated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 3, 20, "o_orderdate", "o_orderkey")


@register("audit_tail", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def audit_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "user_id", "event_type", "ts")
    return tables.newest(rows, "ts", 100, "event_id").drop("ts")


@register("passage_search", r"""
WITH n AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\w\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, round(CAST(CASE WHEN contains(t, 'license') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'apache') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'version') THEN 1.0 ELSE 0 END
   + CASE WHEN regexp_matches(t, '\b2\b') THEN 0.8 ELSE 0 END - CASE WHEN length(text) > 2600 THEN 1.0 ELSE 0 END AS DOUBLE), 4) AS score FROM n""")
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.round(passages.score(F.col("text"), ["license", "apache", "version", "2"]), 4).alias("score"))


#: The passages of all documents as SQL: articles, long ones packed by sentences step by step. (doc_id, place, passage)
PASSAGES_SQL = r"""
WITH RECURSIVE art AS (
  SELECT doc_id, unnest(parts) AS x, unnest(range(0, len(parts))) AS a
  FROM (SELECT doc_id, list_filter(list_transform(
          string_split(regexp_replace(text, '(?i)\b(ARTICLE\s+\d{1,3}\b)', chr(1) || '\1', 'g'), chr(1)),
          lambda y: trim(y, e' \t\n\x0b\f\r')), lambda y: y <> '') AS parts FROM documents WHERE text IS NOT NULL)),
long AS (
  SELECT doc_id, a, list_filter(list_transform(string_split(regexp_replace(x, '([.!?:;])\s+', '\1' || chr(1), 'g'), chr(1)),
         lambda y: trim(y, e' \t\n\x0b\f\r')), lambda y: y <> '') AS blocks FROM art WHERE length(x) > 1800),
pack AS (
  SELECT doc_id, a, blocks, 0 AS i, '' AS held, CAST([] AS VARCHAR[]) AS done FROM long
  UNION ALL
  SELECT doc_id, a, blocks, i + 1,
         CASE WHEN i = len(blocks) THEN '' WHEN joins THEN held || ' ' || b WHEN length(b) <= 1600 THEN b ELSE '' END,
         CASE WHEN i = len(blocks) THEN list_filter([held], lambda y: y <> '') WHEN joins THEN []
              ELSE list_filter([held], lambda y: y <> '') || CASE WHEN length(b) <= 1600 THEN [] ELSE list_filter(list_transform(
                range(0, (length(b) + 1599) // 1600), lambda k: trim(substr(b, k * 1600 + 1, 1600), e' \t\n\x0b\f\r')), lambda y: y <> '') END END
  FROM (SELECT *, blocks[i + 1] AS b, held <> '' AND length(held) + 1 + length(blocks[i + 1]) <= 1600 AS joins FROM pack) WHERE i <= len(blocks)),
piece AS (
  SELECT doc_id, a, 0 AS i, 0 AS j, x AS passage FROM art WHERE length(x) <= 1800
  UNION ALL
  SELECT doc_id, a, i, unnest(range(0, len(done))), unnest(done) FROM pack WHERE len(done) > 0),
own AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, i, j) - 1 AS place, passage,
         trim(regexp_replace(regexp_replace(strip_accents(lower(passage)), '[^\p{L}\p{N}_\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM piece)
"""


@register("best_passages", PASSAGES_SQL + r""",
scored AS (
  SELECT *, round(CAST(CASE WHEN contains(t, 'license') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'apache') THEN 1.0 ELSE 0 END + CASE WHEN contains(t, 'version') THEN 1.0 ELSE 0 END
    + CASE WHEN regexp_matches(t, '\b2\b') THEN 0.8 ELSE 0 END - CASE WHEN length(passage) > 2600 THEN 1.0 ELSE 0 END AS DOUBLE), 4) AS score FROM own)
SELECT doc_id, score, CAST(place AS INT) AS place, CAST(length(passage) AS INT) AS n FROM scored WHERE score >= 2
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1""")
def best_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.search(spread(table(spark, sf_dir, "documents")), ["license", "apache", "version", "2"]).select("doc_id", "score", "place", F.char_length("passage").alias("n"))


@register("question_passages", PASSAGES_SQL + rf""",
word AS (SELECT DISTINCT doc_id, place, unnest(string_split(t, ' ')) AS term FROM own),
q AS (SELECT item_id AS query_id, string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
plain AS (SELECT query_id, term FROM (SELECT query_id, unnest(w) AS term FROM q) WHERE term NOT IN ({", ".join(map(_said, rules.STOPWORDS))}) AND (length(term) > 2 OR regexp_matches(term, '^[0-9]+$'))),
syn(term, more) AS (VALUES {", ".join(f"({_said(k)}, {_said(m)})" for k, own in rules.SYNONYMS.items() for m in own)}),
asked AS (SELECT query_id, term FROM plain UNION SELECT query_id, more FROM plain JOIN syn USING (term)),
scored AS (
  SELECT query_id, doc_id, place, round(sum(CASE WHEN regexp_matches(term, '^[0-9]+$') THEN 0.8::DOUBLE ELSE 1 END), 4) AS score
  FROM word JOIN asked USING (term) WHERE term <> '' GROUP BY ALL)
SELECT query_id, doc_id, CAST(place AS INT) AS place, score FROM scored WHERE score >= 2
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, place) = 1""")
def question_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return passages.search_many(spread(table(spark, sf_dir, "documents")), asked)


@register("term_grep", """
SELECT doc_id, term, number, line FROM (
  SELECT doc_id, term, number, left(line, 240) AS line, row_number() OVER (PARTITION BY doc_id, term ORDER BY number) AS r
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS number FROM documents), (VALUES ('license'), ('mail')) AS v(term)
  WHERE contains(lower(line), term)) WHERE r <= 8""")
def term_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.grep(table(spark, sf_dir, "documents"), ["license", "mail"])


@register("evaluate_golden", """
SELECT doc_id, count(*) FILTER (quality = 1) AS matched, CAST(0 AS BIGINT) AS missing, count(*) FILTER (quality <> 1) AS mismatched, count_if(quality = 1) >= 1 AS passed FROM labels GROUP BY doc_id""")
def evaluate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels")
    golden = rows.select("doc_id", F.lit("quality").alias("field"), F.lit("1").alias("expected"), F.lit(1).alias("least"))
    return reports.evaluated(golden, rows.select("doc_id", F.lit("quality").alias("field"), F.col("quality").cast("string").alias("text")))


@register("quote_overlap", r"""
WITH c AS (SELECT conv_id, turn, text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS page FROM conversations),
w AS (SELECT *, list_filter(list_distinct(string_split_regex(lower(text), '[^a-z0-9]+')), lambda x: x <> '') AS q,
  list_filter(list_distinct(string_split_regex(lower(page), '[^a-z0-9]+')), lambda x: x <> '') AS p FROM c),
j AS (SELECT conv_id, turn, contains(lower(page), lower(text)) AS exact, CASE WHEN len(q) = 0 THEN 0.0 ELSE round(len(list_intersect(q, p)) / len(q), 3) END AS share FROM w)
SELECT conv_id, turn, CASE WHEN exact THEN 'exact' WHEN share >= 0.55 THEN 'approximate' ELSE 'missing' END AS state, CAST(share AS DOUBLE) AS share FROM j""")
def quote_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn held against the one before it."""
    before = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("page", F.coalesce(F.lag("text").over(before), F.lit("")))
    return turns.select("conv_id", "turn", reports.quote_check(F.col("text"), F.col("page")).alias("c")).select("conv_id", "turn", "c.state", "c.share")


@register("best_fact", "SELECT user_id, event_type, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS event_id, max(value) AS value FROM events GROUP BY user_id, event_type")
def best_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("value"), -F.col("event_id")], ["event_id", "value"])


@register("conversation_text", "SELECT conv_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.grouped_pages(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], joiner="\n\n---\n\n")


@register("page_offsets", """
SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.offsets(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@register("json_fields", "SELECT event_id, len(json_keys(props)) AS n FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.size(F.json_object_keys(T.json_object(F.col("props")))), F.lit(0)).cast("long").alias("n"))


@register("html_lines", r"""
SELECT page_id, len(list_filter(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\S'))) AS n FROM pages""")
def html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"\S"))).cast("long").alias("n"))


@register("tumbling_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tumbling(table(spark, sf_dir, "events"), "1 hour", by=["event_type"])


@register("session_windows", """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes", "user_id")


@register("upsert_parts", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' ELSE p_brand END AS p_brand, p_size FROM part UNION ALL SELECT -1 - r_regionkey, r_name, 0 FROM region""")
def upsert_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    changed = parts.where("p_size > 40").withColumn("p_brand", F.lit("large"))
    fresh = table(spark, sf_dir, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("p_partkey"), F.col("r_name").alias("p_brand"), F.lit(0).alias("p_size"))
    return tables.upsert(parts, changed.unionByName(fresh), "p_partkey")


@register("cascade_delete", f"WITH {REGISTRY}, gone AS (SELECT id, filename FROM registry WHERE universe_id = 'u1') SELECT id FROM registry WHERE id NOT IN (SELECT id FROM gone) AND filename NOT IN (SELECT filename FROM gone)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = registry_of(table(spark, sf_dir, "documents"))
    chunks = docs.select(F.col("id").alias("doc_id"), F.col("filename").alias("source"))
    universes = docs.select(F.col("universe_id").alias("id")).distinct()
    return tables.delete_universe("u1", universes, docs, chunks)[2].select(F.col("doc_id").alias("id"))


@register("stored_names", f"""
WITH {REGISTRY}, o AS (SELECT id, filename, file_hash, row_number() OVER (PARTITION BY filename ORDER BY file_hash, id) AS n,
  row_number() OVER (PARTITION BY filename, left(file_hash, 8) ORDER BY file_hash, id) AS m, first_value(left(file_hash, 8)) OVER (PARTITION BY filename ORDER BY file_hash, id) AS f FROM registry),
k AS (SELECT *, m - CASE WHEN f = left(file_hash, 8) THEN 1 ELSE 0 END AS k FROM o)
SELECT id, CASE WHEN n = 1 THEN filename WHEN k <= 1 THEN left(file_hash, 8) || '_' || filename ELSE left(file_hash, 8) || '_' || k || '_' || filename END AS stored_name FROM k""")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.unique_names(registry_of(table(spark, sf_dir, "documents"))).select("id", "stored_name")


@register("mined_facts", r"""
SELECT DISTINCT ON (doc_id, label, value) doc_id, 'mail' AS type, label, value FROM (
  SELECT doc_id, m[1] AS label, m[2] AS value FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '(\d{2})@(mail\d)'), lambda x: string_split(x, '@'))) AS m FROM documents))""")
def mined_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_seq"), F.lit("1").alias("page"), "text")
    return facts.mined_facts(pages, [facts.MinedRule("mail", r"(\d{2})@(mail\d)")]).select("doc_id", "type", "label", "value")


@register("field_facts", r"""
SELECT doc_id, field, text FROM (
  SELECT doc_id, 'phone' AS field, regexp_extract(text, '(\+1 \(\d{3}\) \d{3}-\d{4})', 1) AS text FROM documents
  UNION ALL SELECT doc_id, 'license', regexp_extract(text, '(Licensed under the [A-Z][a-z]+)', 1) FROM documents) WHERE text <> ''""")
def field_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_seq"), F.lit("1").alias("page"), "text")
    rules = [facts.FieldRule("phone", r"(\+1 \(\d{3}\) \d{3}-\d{4})"), facts.FieldRule("license", r"(Licensed under the [A-Z][a-z]+)")]
    return facts.field_facts(pages, rules).select("doc_id", "field", "text")


@register("profile_coverage", """
SELECT user_id AS doc_id, CAST(count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) AS INTEGER) AS core_present,
  round(count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) / 2, 3) AS core_ratio,
  concat_ws(',', CASE WHEN count_if(event_type = 'click') = 0 THEN 'click' END, CASE WHEN count_if(event_type = 'view') = 0 THEN 'view' END) AS missing_core FROM events GROUP BY user_id""")
def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("field"))
    return facts.profile(rows, ["click", "view"])


@register("agreement", r"""
WITH a AS (SELECT doc_id, CASE WHEN contains(text, '!!') OR contains(text, '##') THEN 'loud' ELSE 'calm' END AS a FROM documents),
b AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'calm' ELSE 'loud' END AS b FROM labels)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, 'tone' AS field, a IS NOT NULL AS in_first, b IS NOT NULL AS in_second, coalesce(a = b OR contains(a, b) OR contains(b, a), false) AS agree
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's finding for every document against the labels."""
    loud = F.contains("text", F.lit("!!")) | F.contains("text", F.lit("##"))
    first = table(spark, sf_dir, "documents").select("doc_id", F.lit("tone").alias("field"), F.when(loud, "loud").otherwise("calm").alias("text"))
    second = table(spark, sf_dir, "labels").select("doc_id", F.lit("tone").alias("field"), F.when(F.col("quality") == 1, "calm").otherwise("loud").alias("text"))
    return reports.compared(first, second)


_QUESTIONS = ["Who are you?", "Quel est l'objet ?", "What is the deadline?", "Quelle garantie ?", "Peut-on livrer ?"]


@register("answer_cascade", rf"""
WITH q AS (SELECT doc_id, source, k, regexp_extract(text, 'Licensed under the [A-Z][a-z]+') AS o, regexp_extract(text, '\+1 \(\d{{3}}\) \d{{3}}-\d{{4}}') AS d FROM documents, range({len(_QUESTIONS)}) r(k))
SELECT doc_id || '-' || k AS query_id,
  CASE WHEN k = 0 THEN {_said(answers.WHO["en"])} WHEN k = 1 AND o <> '' THEN o || ' (page 1)' WHEN k = 2 AND d <> '' THEN d || ' (page 1)' WHEN k = 3 AND doc_id % 2 = 0 THEN source
  WHEN k = 2 THEN {_said(answers.NOT_FOUND["en"])} ELSE {_said(answers.NOT_FOUND["fr"])} END AS answer,
  CASE WHEN k = 0 THEN 'identity' WHEN (k = 1 AND o <> '') OR (k = 2 AND d <> '') THEN 'fact' WHEN k = 3 AND doc_id % 2 = 0 THEN 'passage' ELSE 'missing' END AS stage FROM q""")
def answer_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five questions about every document, which reach every stage; a passage that is guesswork gives no answer."""
    docs = spread(table(spark, sf_dir, "documents"))
    asked = docs.select("doc_id", "source", F.posexplode(F.array(*map(F.lit, _QUESTIONS))).alias("k", "question")).withColumn("query_id", F.concat_ws("-", "doc_id", "k"))
    pages = docs.select("doc_id", F.lit(1).alias("page_seq"), F.lit("1").alias("page"), "text")
    known = facts.field_facts(pages, [facts.FieldRule("subject", r"(Licensed under the [A-Z][a-z]+)"), facts.FieldRule("deadline", r"(\+1 \(\d{3}\) \d{3}-\d{4})")])
    passage = F.when((F.col("k") == 3) & (F.col("doc_id") % 2 == 0), F.col("source")).when(F.col("k") == 4, "Il est probable que oui")
    return answers.answered(asked, known, asked.select("query_id", passage.alias("passage")).where("passage is not null"))
