"""Further named queries with their SQL: access, registry, caches, pages and text functions on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..operators import access, chunking, facts, pages, registry, reports, tables
from ..session import table
from ..sources import readers
from .queries import ME, REGISTRY, registry_of
from .registry import register


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry_of(table(spark, sf_dir, "documents"))


# access and registry --------------------------------------------------------


@register("facts_scope", f"WITH {REGISTRY} SELECT id FROM registry WHERE (visibility = 'private' AND uploaded_by = 'user3') OR (visibility = 'department' AND department_id IN ('dept1'))")
def facts_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where(access.facts_filter(ME)).select("id")


@register("document_rights", f"""
WITH {REGISTRY} SELECT id, CASE WHEN visibility = 'private' THEN uploaded_by = 'user3' ELSE department_id = 'dept1' END AS may_view, uploaded_by = 'user3' AS may_delete,
  uploaded_by = 'user3' AS may_change, department_id = 'dept1' AS may_enter, true AS may_upload, false AS may_manage FROM registry""")
def document_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "id", access.can_view(ME).alias("may_view"), access.can_delete(ME).alias("may_delete"), access.can_change_visibility(ME).alias("may_change"),
        access.can_access_universe(ME).alias("may_enter"), F.lit(access.can_upload(ME)).alias("may_upload"), F.lit(access.can_manage_users(ME)).alias("may_manage"),
    )


@register("document_by_id", f"WITH {REGISTRY} SELECT id, filename FROM registry WHERE id = '17' AND ((visibility = 'department' AND department_id = 'dept1') OR (visibility = 'private' AND uploaded_by = 'user3'))")
def document_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.document_by_id(_documents(spark, sf_dir), "17", ME).select("id", "filename")


@register("documents_by_hash", f"WITH {REGISTRY} SELECT id FROM registry WHERE file_hash = (SELECT max(file_hash) FROM (SELECT file_hash FROM registry GROUP BY 1 HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM registry GROUP BY file_hash))))")
def documents_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the content that occurs most often."""
    docs = _documents(spark, sf_dir)
    most = docs.groupBy("file_hash").count().orderBy(F.col("count").desc(), F.col("file_hash").desc()).head()
    return registry.documents_by_hash(docs, most["file_hash"] if most else "").select("id")


@register("user_by_name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name = (SELECT min(c_name) FROM customer)")
def user_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return registry.lookup(people, "name", people.agg(F.min("name")).head()[0])


@register("users_of_department", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
def users_of_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("department_id"))
    return registry.users(people, "BUILDING").select("id", "name")


@register("departments_by_name", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def departments_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.departments(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@register("universes_allowed", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey IN (1, 2)")
def universes_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("department_id"))
    return registry.universes(rows, ["1", "2"]).select("id", "name")


@register("audit_of_manager", "SELECT event_id AS id, event_type AS action FROM events WHERE user_id % 5 = 2 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def audit_of_manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("action"), F.concat(F.lit("dept"), (F.col("user_id") % 5).cast("string")).alias("department_id"), F.col("ts").alias("created_at"))
    return registry.audit_log(rows, 100, "click", "dept1", "dept2").select("id", "action")


@register("documents_without_facts", f"WITH {REGISTRY}, f AS (SELECT *, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN '{{}}' WHEN 1 THEN NULL WHEN 2 THEN '[]' ELSE '{{\"a\": 1}}' END AS extracted_facts FROM registry) SELECT id FROM f WHERE status = 'indexed' AND coalesce(extracted_facts, '') IN ('', '{{}}', '[]')")
def documents_without_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("id").cast("long") % 4
    known = F.when(kind == 0, "{}").when(kind == 1, F.lit(None)).when(kind == 2, "[]").otherwise('{"a": 1}')
    return registry.selected(_documents(spark, sf_dir).withColumn("extracted_facts", known), status=["indexed"], missing_facts=True)


@register("found_documents", "SELECT conv_id AS doc_id, count(*) AS chunks, min(turn) AS first_page FROM conversations WHERE contains(lower(role || ' ' || text), 'the') GROUP BY conv_id")
def found_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("turn").alias("chunk_index"), "role", "text")
    return reports.found_documents(chunks, "The", ["role", "text"])


@register("named_like", "SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(coalesce(p_type, '')), 'a')")
def named_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return reports.named_like(rows, "A").select("p_partkey", "name")


@register("claimed_documents", f"""
WITH {REGISTRY}, t AS (SELECT id FROM registry WHERE status = 'queued' ORDER BY created, id LIMIT 3)
SELECT id, CASE WHEN id IN (SELECT id FROM t) THEN 'processing' ELSE status END AS status FROM registry""")
def claimed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.claimed(_documents(spark, sf_dir), 3).select("id", "status")


@register("worker_claims", f"""
WITH {REGISTRY}, t AS (SELECT id, row_number() OVER (ORDER BY created, id) - 1 AS p FROM registry WHERE status = 'queued')
SELECT CASE p % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS worker, id, CAST(p // 3 AS INT) AS place FROM t WHERE p < 12""")
def worker_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four oldest queued documents for each of three workers."""
    return registry.claims(_documents(spark, sf_dir), ["a", "b", "c"], 4)


@register("processed_documents", f"""
WITH {REGISTRY} SELECT id, CASE WHEN status = 'queued' THEN CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'indexed' ELSE 'failed' END ELSE status END AS status,
  CASE WHEN status = 'queued' AND CAST(id AS BIGINT) % 2 = 0 THEN 5 ELSE chunk_count END AS chunk_count FROM registry""")
def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All queued documents taken up and ended, those with odd ids by an error."""
    docs = _documents(spark, sf_dir)
    running = docs.withColumn("status", F.when(F.col("status") == "queued", "processing").otherwise(F.col("status")))
    ended = docs.select("id", F.lit(5).alias("chunks"), F.when(F.col("id").cast("long") % 2 == 1, "broken").alias("error"))
    return registry.processed(running, ended).select("id", "status", "chunk_count")


# chunks and tables ----------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat_ws("_c", "conv_id", "turn").alias("id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("source"), "text")


@register("all_chunks", "SELECT conv_id || '_c' || turn AS id, text, conv_id AS doc_id, role AS source FROM conversations")
def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.all_chunks(_chunks(spark, sf_dir)).select("id", "text", "metadata.doc_id", "metadata.source")


@register("count_chunks", "SELECT count(*) AS n FROM conversations")
def count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.count_chunks(_chunks(spark, sf_dir))


@register("all_sources", "SELECT DISTINCT source FROM documents WHERE source <> ''")
def all_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.sources(table(spark, sf_dir, "documents"))


@register("document_chunks", "SELECT conv_id || '_c' || turn AS id, turn AS chunk_index FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return registry.document_chunks(chunks, chunks.agg(F.max("doc_id")).head()[0]).select("id", "chunk_index")


@register("stamped_departments", f"WITH {REGISTRY} SELECT conv_id AS doc_id, turn, coalesce(department_id, 'shared') AS department FROM conversations LEFT JOIN registry ON CAST(conv_id AS VARCHAR) = id")
def stamped_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), "turn", F.lit("shared").alias("department"))
    return tables.stamp_departments(chunks, _documents(spark, sf_dir)).select(F.col("doc_id").cast("long").alias("doc_id"), "turn", "department")


@register("inserted_nations", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 20 AS n_nationkey, r_name FROM region WHERE r_regionkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def inserted_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 20).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return tables.insert_if_absent(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), new, "n_nationkey")


@register("updated_suppliers", "SELECT s_suppkey, coalesce(upper(n_name), s_name) AS s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey")
def updated_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("s_suppkey"), F.upper("n_name").alias("s_name"))
    return tables.update(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), changes, "s_suppkey")


@register("parts_never_ordered", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)")
def parts_never_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.not_in(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@register("fresh_cache", "SELECT CAST(doc_id AS VARCHAR) AS filename FROM documents WHERE length(text) >= 40 AND doc_id % 10 + 1 >= doc_id % 7")
def fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("filename", F.col("doc_id").cast("string"))
    cache = docs.select("filename", F.timestamp_seconds(F.col("doc_id") % 10).alias("cached_at"), F.col("text").alias("content"))
    return readers.fresh(cache, docs.select("filename", F.timestamp_seconds(F.col("doc_id") % 7).alias("modificationTime"))).select("filename")


@register("cached_pages", r"""
SELECT conv_id, count(*) AS pages, max(length(trim(text, ' ' || chr(10) || chr(9) || chr(13)))) AS longest FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY conv_id""")
def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as texts with page lines, and read again."""
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.concat(F.lit("[Page "), F.col("turn") + 1, F.lit("]\n"), "text"))
    cache = chunking.grouped_pages(turns, ["conv_id"], ["turn"], "line").select(F.col("conv_id").cast("string").alias("filename"), F.col("line").alias("content"))
    read = readers.cached_pages(cache).groupBy("filename").agg(F.count("*").alias("pages"), F.max(F.char_length("text")).cast("long").alias("longest"))
    return read.select(F.col("filename").cast("long").alias("conv_id"), "pages", "longest")


# pages and facts ------------------------------------------------------------


@register("combined_pages", r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations)
SELECT conv_id, sha256(coalesce(string_agg(t, chr(10) ORDER BY turn, t) FILTER (t <> ''), '')) AS digest FROM t GROUP BY conv_id""")
def combined_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.combined(table(spark, sf_dir, "conversations").withColumnRenamed("turn", "page_seq"), ["conv_id"]).select("conv_id", F.sha2("text", 256).alias("digest"))


@register("worst_modes", """
SELECT source AS doc_id, ['clean', 'partial_pages', 'noisy_ocr', 'arabic_noisy'][max(CASE WHEN n_chars < 200 THEN 3 WHEN n_chars < 1000 THEN 2 WHEN n_chars > 50000 THEN 4 ELSE 1 END)] AS mode FROM documents GROUP BY source""")
def worst_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("n_chars") < 200, "noisy_ocr").when(F.col("n_chars") < 1000, "partial_pages").when(F.col("n_chars") > 50000, "arabic_noisy").otherwise("clean")
    return pages.worst_mode(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), mode.alias("mode")))


@register("resolved_names", r"""
WITH w AS (SELECT DISTINCT source || '_' || (doc_id % 50) || '.pdf' AS filename FROM documents),
c AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN source || '_' || (doc_id % 50) || '.pdf' WHEN doc_id % 3 = 1 THEN source || ' ' || (doc_id % 50) || '.pdf' ELSE upper(source) || '-' || (doc_id % 50) || '.TXT' END AS cached FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(lower(cached), '\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g') AS key FROM c),
j AS (SELECT w.filename, cached, CASE WHEN w.filename = cached THEN 0 WHEN replace(w.filename, '_', ' ') = cached THEN 1 ELSE 2 END AS p
  FROM w JOIN k ON regexp_replace(regexp_replace(lower(w.filename), '\.[^.]+$', ''), '[^a-z0-9]+', ' ', 'g') = k.key)
SELECT filename, arg_min(cached, struct_pack(p := p, c := cached)) AS cached FROM j GROUP BY filename""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), (F.col("doc_id") % 50).cast("string")
    wanted = docs.select(F.concat("source", F.lit("_"), n, F.lit(".pdf")).alias("filename"))
    kind = F.col("doc_id") % 3
    names = F.when(kind == 0, F.concat("source", F.lit("_"), n, F.lit(".pdf"))).when(kind == 1, F.concat("source", F.lit(" "), n, F.lit(".pdf"))).otherwise(F.concat(F.upper("source"), F.lit("-"), n, F.lit(".TXT")))
    return pages.resolved_names(wanted, docs.select(names.alias("filename")))


@register("resolved_pages", """
WITH known AS (SELECT l_orderkey AS doc_id, 'p. ' || l_linenumber AS page, l_linenumber AS n FROM lineitem),
asked AS (SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN l_linenumber % 3 = 0 THEN 'Page ' || l_linenumber WHEN l_linenumber % 3 = 1 THEN 'p. ' || l_linenumber ELSE 'p. 9' END AS raw FROM lineitem)
SELECT a.doc_id, raw, arg_min(page, struct_pack(k := CASE WHEN raw = page THEN 0 ELSE 1 END, n := n)) AS page
FROM asked a JOIN known k ON a.doc_id = k.doc_id AND (raw = page OR CAST(regexp_extract(raw, '[0-9]+') AS INTEGER) = n OR contains(raw, page) OR contains(page, raw)) GROUP BY a.doc_id, raw""")
def resolved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    known = lines.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p. "), n).alias("page"))
    raw = F.when(n % 3 == 0, F.concat(F.lit("Page "), n)).when(n % 3 == 1, F.concat(F.lit("p. "), n)).otherwise("p. 9")
    return pages.resolved_pages(lines.select(F.col("l_orderkey").alias("doc_id"), raw.alias("raw")).distinct(), known)


@register("page_order", "SELECT page_id, CAST(coalesce(try_cast(regexp_extract(url, '(\\d+)', 1) AS INTEGER), 10000) AS INTEGER) AS number, url AS label FROM pages")
def page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.page_order(F.col("url")).alias("o")).select("page_id", "o.*")


@register("fact_sources", "SELECT l_orderkey AS doc_id, least(count(DISTINCT struct_pack(a := l_linenumber % 3, b := coalesce(l_returnflag, 'general'))), 4) AS places FROM lineitem GROUP BY 1")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.collect_list(F.struct((F.col("l_linenumber") % 3).cast("string").alias("page"), F.col("l_returnflag").alias("section")))
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(items.alias("items")).withColumn("field", F.lit("f"))
    return reports.fact_sources(found).select("doc_id", F.size("places").cast("long").alias("places"))


@register("fact_counts", r"""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*-'))) AS items FROM documents""")
def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", registry.item_count(F.lit(None).cast("array<string>"), F.col("text")).cast("long").alias("items"))


@register("fact_numbers", "SELECT user_id, count(DISTINCT event_type) - CAST(max(event_type = 'view') AS INTEGER) AS n FROM events GROUP BY user_id")
def fact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types by user as a map of facts; those named like no fact do not count."""
    key = F.when(F.col("event_type") == "view", "summary").otherwise(F.col("event_type"))
    known = table(spark, sf_dir, "events").select("user_id", key.alias("k")).distinct().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.lit(1).alias("v")))).alias("facts"))
    return known.select("user_id", registry.fact_count(F.col("facts")).cast("long").alias("n"))


@register("group_pages", """
WITH g AS (SELECT doc_id, ['submission', 'documents', 'guarantees', 'execution', 'other'][doc_id % 5 + 1] AS g, CAST(doc_id % 12 AS INTEGER) AS b, ['clean', 'arabic_noisy', 'noisy_ocr', 'partial_pages'][doc_id % 4 + 1] AS m FROM documents),
w AS (SELECT *, CASE g WHEN 'documents' THEN 8 WHEN 'guarantees' THEN 7 WHEN 'execution' THEN 8 ELSE 0 END AS d,
 CASE m WHEN 'arabic_noisy' THEN CASE g WHEN 'submission' THEN 12 WHEN 'documents' THEN 16 WHEN 'guarantees' THEN 14 WHEN 'execution' THEN 14 ELSE 0 END
  WHEN 'noisy_ocr' THEN CASE g WHEN 'submission' THEN 8 WHEN 'documents' THEN 12 WHEN 'guarantees' THEN 10 WHEN 'execution' THEN 10 ELSE 0 END
  WHEN 'partial_pages' THEN CASE g WHEN 'submission' THEN 8 WHEN 'documents' THEN 10 WHEN 'guarantees' THEN 10 WHEN 'execution' THEN 10 ELSE 0 END ELSE 0 END AS e FROM g)
SELECT doc_id, CAST(CASE WHEN b < 5 THEN b ELSE greatest(b, d, e) END AS INTEGER) AS pages FROM w""")
def group_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    group, mode = of(["submission", "documents", "guarantees", "execution", "other"]), of(["clean", "arabic_noisy", "noisy_ocr", "partial_pages"])
    return table(spark, sf_dir, "documents").select("doc_id", registry.group_pages(group, (F.col("doc_id") % 12).cast("int"), mode).alias("pages"))


@register("placeholder_values", r"""
WITH t AS (SELECT conv_id, 'IM ' || (turn % 3) || ': ' || regexp_replace(left(text, 40), '\s+', ' ', 'g') AS line FROM conversations),
v AS (SELECT conv_id AS doc_id, 'IM' || CAST(regexp_extract(line, 'IM (\d+)', 1) AS INTEGER) AS key, trim(regexp_replace(line, '^IM \d+: *', ''), ' .;:-') AS value FROM t)
SELECT doc_id, key, arg_max(value, struct_pack(n := length(value), v := value)) AS value FROM v GROUP BY doc_id, key""")
def placeholder_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest value of each numbered place-holder of a conversation."""
    line = F.concat(F.lit("IM "), F.col("turn") % 3, F.lit(": "), F.regexp_replace(F.left("text", F.lit(40)), r"\s+", " "))
    return facts.placeholders(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), line.alias("text")))


# text functions -------------------------------------------------------------


@register("arabic_share", r"""
WITH t AS (SELECT doc_id, translate(text, 'aeiou', 'ابﻻﺏت') AS t FROM documents)
SELECT doc_id, round(CASE WHEN length(regexp_replace(t, '[^\p{L}]+', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace(t, '[^\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]+', '', 'g')) / length(regexp_replace(t, '[^\p{L}]+', '', 'g')) END, 4) AS share FROM t""")
def arabic_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vowels are Arabic letters, two of them presentation forms."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.arabic_ratio(F.translate("text", "aeiou", "ابﻻﺏت")), 4).alias("share"))


_SIGNALS = ["أمر بصرف 30", "غرامة التأخير 5%", "خطايا التأخير", "الضمان النهائي 903", "العرض الفني ISO 9001", "plain words only here", "ضمان نهائي 3% غرامة التأخير 965"]


@register("arabic_signals", "SELECT doc_id, CAST([1, 1, 0, 1, 1, 0, 2][doc_id % 7 + 1] AS INTEGER) AS signals, CAST([1, 1, 0, 1, 1, 0, 2][doc_id % 7 + 1] > 0 AND doc_id % 7 <> 1 AS BOOLEAN) AS adds FROM documents")
def arabic_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known signals by document, and whether they add to a text that has one of them."""
    text = F.element_at(F.array(*map(F.lit, _SIGNALS)), (F.col("doc_id") % len(_SIGNALS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.arabic_signals(text).alias("signals"), T.adds_arabic_signal(F.lit(_SIGNALS[1]), text).alias("adds"))


@register("page_quality", r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(text || CASE WHEN turn % 2 = 0 THEN ' Office de prix' ELSE ' date limite' END, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM conversations),
f AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[`’]', '''', 'g'), '\s+', ' ', 'g')) AS x FROM c)
SELECT conv_id, turn, CAST(least(length(t) // 80, 40) + least(length(regexp_replace(t, '[^0-9]+', '', 'g')), 30)
  + 16 * len(list_filter(['appel d''offres', 'appel d offres', 'cahier des charges', 'date limite', 'soumission', 'offre technique', 'offre financiere', 'bordereau des prix', 'caracteristiques techniques'], lambda m: contains(x, m)))
  + 8 * len(list_filter(['tuneps', 'www.tuneps.tn', 'prix', 'qte'], lambda m: contains(x, m)))
  - CASE WHEN len(list_filter(['tuneps', 'republique tunisienne', 'ministere', 'office de'], lambda m: contains(x, m))) > 0 THEN 35 ELSE 0 END AS INTEGER) AS quality FROM f""")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, " Office de prix").otherwise(" date limite"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.page_quality(text).alias("quality"))


@register("name_ids", r"""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '-' || doc_id)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS uuid FROM h""")
def name_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.uuid5(F.concat("source", F.lit("-"), "doc_id")).alias("uuid"))


@register("stripped_reasoning", r"""
SELECT conv_id, turn, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM conversations""")
def stripped_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a block of reasoning put before and within it, and taken out again."""
    dressed = F.concat(F.lit("<think>a\nb</think>\n"), "text", F.lit("<THINK></THINK> "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.strip_reasoning(dressed), 256).alias("digest"))


@register("answer_languages", r"""
SELECT conv_id, turn, l AS language, CASE l WHEN 'ar' THEN 'غير مذكور في هذه الوثيقة.' WHEN 'en' THEN 'Not mentioned in this document.' ELSE 'Non mentionne dans ce document.' END AS missing,
  CASE l WHEN 'ar' THEN 'Reponds uniquement en arabe.' WHEN 'en' THEN 'Answer only in English.' ELSE 'Reponds uniquement en francais.' END AS instruction
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'ar'
  WHEN len(list_filter([""" + ", ".join(f"' {x} '" for x in rules.ENGLISH_MARKERS) + r"""], lambda m: contains(' ' || n || ' ', m))) > 0 THEN 'en' ELSE 'fr' END AS l
  FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\w\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM conversations))""")
def answer_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = F.concat("text", F.when(F.col("turn") % 5 == 4, " ما").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_language(question).alias("language"), T.missing_answer(question).alias("missing"), T.language_instruction(question).alias("instruction"))


@register("page_selections", """
SELECT o_orderkey, (SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT unnest(list_concat([o_orderkey % 5 + 1], range(o_orderkey % 7 + 1, o_orderkey % 7 + 4))) AS x)) AS pages FROM orders""")
def page_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    spec = F.concat((k % 5 + 1).cast("string"), F.lit(", "), (k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 3).cast("string"), F.lit(","))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", T.page_selection(spec).cast("array<string>")).alias("pages"))


@register("date_values", r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(day(o_orderdate) AS VARCHAR) || ' mars ' || year(o_orderdate) ELSE strftime(o_orderdate, '%d/%m/%Y') END AS value FROM orders""")
def date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long date found behind a numeric one, or the numeric one alone."""
    plain = F.date_format("o_orderdate", "dd/MM/yyyy")
    long_date = F.concat(F.lit(" avant le "), F.dayofmonth("o_orderdate"), F.lit(" mars "), F.year("o_orderdate"))
    text = F.concat(F.lit("du "), plain, F.when(F.col("o_orderkey") % 2 == 0, long_date).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.date_value(text).alias("value"))


@register("durations", r"""
SELECT doc_id, regexp_matches(text, '(?i)\d+\s*(?:\([^)]*\)\s*)?(?:jours?|mois|ans?|années?|heures?|days?|months?|years?)') AS has FROM documents""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.has_duration(F.col("text")).alias("has"))


@register("excerpts", r"""
WITH p AS (SELECT doc_id, text AS t, instr(lower(text), 'license') AS a FROM documents)
SELECT doc_id, sha256(CASE WHEN a > 31 THEN '...' ELSE '' END || substring(t, greatest(a - 30, 1), a - greatest(a - 30, 1) + 37) || CASE WHEN a + 36 < length(t) THEN '...' ELSE '' END) AS digest FROM p WHERE a > 0""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), "license", 30).alias("x"))
    return found.where("x is not null").select("doc_id", F.sha2("x", 256).alias("digest"))


@register("guesswork", "SELECT doc_id, len(list_filter([" + ", ".join("'" + x.lower().replace("'", "''") + "'" for x in rules.GUESSWORK) + "], lambda m: contains(lower(text), m))) > 0 AS guess FROM documents")
def guesswork(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.guesswork(F.col("text")).alias("guess"))


@register("title_bonus", """
SELECT page_id, round(CAST(CASE WHEN n <= 1 THEN 0.45 WHEN n <= 2 THEN 0.30 WHEN n <= 4 THEN 0.15 ELSE -0.05 END + CASE WHEN contains(lower(html), 'html') THEN 0.25 ELSE 0 END AS DOUBLE), 4) AS bonus FROM (SELECT *, page_id % 7 AS n FROM pages)""")
def title_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.round(T.page_bonus((F.col("page_id") % 7).cast("string"), F.col("html"), ["html"]), 4).alias("bonus"))


@register("repaired_mojibake", "SELECT doc_id, sha256(source || ' é ç “ œ') AS digest FROM documents")
def repaired_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 that was read as cp1252, read right."""
    broken = F.concat("source", F.lit(" é ç “ œ".encode().decode("cp1252")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.repair_mojibake(broken), 256).alias("digest"))
