"""The engine's end-to-end plans: indexing files, and answering batches of questions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import access, answers, chunking, facts, passages, retrieval
from ..sources import readers
from . import models


def document_ids(found: DataFrame) -> DataFrame:
    """Files with the id of their content."""
    return found.withColumn("doc_id", F.left("sha256", F.lit(16)))


def page_rows(found: DataFrame) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) of files."""
    named = document_ids(found)
    return readers.page_entries(named).join(named.select("path", "doc_id"), "path").select("doc_id", "path", "page_seq", "page", "text")


def indexed(found: DataFrame, policy: access.Policy, make: Callable[[], models.Embed], visibility: str = "department", universe: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors and stamps, and facts, of files."""
    pages = page_rows(found)
    made = chunking.chunks(pages)
    names = document_ids(found).select("doc_id", F.regexp_extract("path", r"([^/]+)$", 1).alias("source")).dropDuplicates(["doc_id"])
    stamped = made.join(names, "doc_id").withColumns({
        "department": F.lit(policy.department_id), "visibility": F.lit(visibility), "uploaded_by": F.lit(policy.user_id),
        "universe_id": F.lit(universe).cast("string"), "vec_id": F.col("id"), "point_id": T.uuid5(F.col("id")),
    })
    return models.embedded(stamped, make), facts.document_facts(pages)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of the store; None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def committed(spark: SparkSession, store: str, name: str) -> DataFrame | None:
    """The rows of a table of the store (``files``, ``chunks``, ``facts``) whose batch has a commit record; None without any."""
    rows, commits = _table(spark, f"{store}/{name}"), _table(spark, f"{store}/commits")
    if rows is None or commits is None:
        return None
    return rows.join(commits.select("batch"), "batch", "left_semi")


def index_folder(spark: SparkSession, folder: str, store: str, policy: access.Policy, make: Callable[[], models.Embed]) -> int:
    """Indexes the files of a folder that are not indexed yet; how many these were.

    A run writes its files, chunks and facts under a batch of its own and a commit record
    last, in one small file. Only committed batches are read (``committed``), so a run that
    fails anywhere leaves nothing to be seen and its files are indexed by the next one.
    Files that give no chunks are recorded too and not read again.
    """
    found, done, batch = readers.files(spark, folder), committed(spark, store, "files"), uuid.uuid4().hex
    if done is not None:
        found = readers.not_indexed(found, done)
    names = document_ids(found).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "doc_id", "sha256")
    _put(names, store, "files", batch)
    recorded = spark.read.parquet(f"{store}/files").where(F.col("batch") == batch).count()
    if recorded:
        chunks, known = indexed(found, policy, make)
        _put(chunks, store, "chunks", batch)
        _put(known, store, "facts", batch)
        spark.createDataFrame([(batch, recorded)], "batch string, n_files long").coalesce(1).write.mode("append").parquet(f"{store}/commits")
    return recorded


def _put(rows: DataFrame, store: str, name: str, batch: str) -> None:
    rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{store}/{name}")


def searched(chunks: DataFrame, questions: DataFrame, policy: access.Policy, make: Callable[[], models.Embed], k: int = 6) -> DataFrame:
    """The k chunks most like each question (query_id, question) among those the user may see."""
    seen = chunks.where(access.search_filter(departments=policy.departments, user_id=policy.user_id, is_admin=policy.is_admin))
    asked = models.embedded(questions.withColumn("_q", T.expand_question(F.col("question"))), make, "_q", "query").select("query_id", "query")
    hits = retrieval.top_k_many(seen, asked, k)
    return retrieval.with_defaults(hits.join(seen.select("vec_id", "doc_id", "source", "page", "section", "text"), "vec_id"))


def answered(chunks: DataFrame, known: DataFrame, questions: DataFrame, policy: access.Policy, make: Callable[[], models.Embed], generate: Callable[[], models.Generate] | None = None, k: int = 6) -> DataFrame:
    """Questions (query_id, question, doc_id) through the cascade: facts first, then retrieved chunks, then a model if given."""
    hits = searched(chunks, questions, policy, make, k)
    context = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("passage"))
    if generate:
        prompts = answers.prompts(questions.join(context, "query_id"), "passage")
        context = models.generated(prompts, generate).select("query_id", F.col("answer").alias("passage"))
    return answers.answered(questions, known, context)


def analysed_documents(documents: DataFrame, known: DataFrame, policy: access.Policy, kind: str, at: Column, chunks: DataFrame | None = None, instruction: str = "", make: Callable[[], models.Generate] | None = None) -> tuple[DataFrame, DataFrame]:
    """Analyses (doc_id, answer) of the documents (id, filename, ...) that the user sees, and their audit rows.

    ``tender_checklist`` needs facts only and gives no row to documents without any;
    every other kind asks the model for all chunks of a document.
    """
    seen = documents.where(access.registry_filter(policy)).select(F.col("id").alias("doc_id"), "filename")
    if kind == "tender_checklist":
        made = answers.full_checklist(known, seen.join(known.select("doc_id").distinct(), "doc_id", "left_semi")).withColumnRenamed("checklist", "answer")
    elif chunks is None or make is None:
        raise ValueError(f"{kind} needs chunks and a model")
    else:
        made = models.analysed(chunks.join(seen, "doc_id", "left_semi"), instruction, make)
    audit = made.join(seen, "doc_id").select(
        F.lit(policy.user_id).alias("user_id"), F.lit("analyze_document").alias("action"), F.col("filename").alias("resource"),
        F.lit(policy.department_id).alias("department_id"), F.to_json(F.struct(F.lit(kind).alias("analysis_type"))).alias("metadata"), at.alias("created_at"),
    )
    return made, audit


def cached_answers(pages: DataFrame, question: str) -> DataFrame:
    """The best passage of cached pages (filename, page_seq, page, text) for one question."""
    spark = pages.sparkSession
    row = spark.range(1).select(T.terms_of(F.lit(question)).alias("t"), T.article_number(F.lit(question)).alias("a")).collect()[0]
    keyed = pages.withColumn("_key", F.concat_ws("\u0000", "filename", "page"))
    found = passages.search(keyed, row.t, row.a, key="_key")
    split = F.split("_key", "\u0000")
    best = found.select(F.get(split, F.lit(0)).alias("filename"), F.get(split, F.lit(1)).alias("page"), "score", "passage")
    return best.groupBy("filename").agg(F.max_by(F.struct("page", "score", "passage"), F.struct("score", F.expr("-length(passage)"))).alias("_b")).select("filename", "_b.*")
