"""Lookups, listings and job states over the registry of documents and its neighbours.

Every listing has a total order. Functions that change a table return its new contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from .access import Policy, can_access_universe, registry_filter


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows whose key has a value; none for a null."""
    return rows.where(F.col(key) == F.lit(value))


def document_by_id(documents: DataFrame, doc_id: str, policy: Policy | None = None) -> DataFrame:
    """A document, if the user sees it."""
    return lookup(documents, "id", doc_id).where(registry_filter(policy))


def documents_by_hash(documents: DataFrame, file_hash: str) -> DataFrame:
    """All documents with a content's hash, the oldest first."""
    return lookup(documents, "file_hash", file_hash).orderBy("created_at", "id")


def document_by_hash(documents: DataFrame, file_hash: str) -> DataFrame:
    """The document with a content's hash; several are an error."""
    found = documents_by_hash(documents, file_hash)
    if len(found.limit(2).collect()) > 1:
        raise ValueError(f"several documents have the hash {file_hash}")
    return found


def universe_by_id(universes: DataFrame, universe: str, policy: Policy) -> DataFrame:
    """A universe; one of another department is refused."""
    found = lookup(universes, "id", universe)
    if not found.where(~F.coalesce(can_access_universe(policy), F.lit(False))).isEmpty():
        raise PermissionError(f"universe {universe} belongs to another department")
    return found


def users(rows: DataFrame, department: str | None = None) -> DataFrame:
    """Users by name, of one department if given."""
    return (rows if department is None else lookup(rows, "department_id", department)).orderBy("name", "id")


def departments(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name", "id")


def universes(rows: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Universes of the allowed departments, all without a list."""
    return (rows if allowed is None else rows.where(F.col("department_id").isin(allowed))).orderBy("id")


def audit_log(rows: DataFrame, n: int = 100, action: str | None = None, department: str | None = None, manager_department: str | None = None) -> DataFrame:
    """The newest audit rows, of an action and a department if given; a manager only sees the own department."""
    own = manager_department or department
    if own:
        rows = lookup(rows, "department_id", own)
    if action:
        rows = lookup(rows, "action", action)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def selected(
    documents: DataFrame, ids: list[str] | None = None, filenames: list[str] | None = None, status: list[str] | None = None,
    missing_facts: bool = False, most: int | None = None,
) -> DataFrame:
    """Ids of registered documents, the oldest first; ``missing_facts`` keeps those whose extracted facts are null or empty."""
    for column, wanted in (("id", ids), ("filename", filenames), ("status", status)):
        if wanted:
            documents = documents.where(F.col(column).isin(wanted))
    if missing_facts:
        documents = documents.where(F.coalesce(F.trim("extracted_facts"), F.lit("")).isin("", "null", "{}", "[]"))
    found = documents.orderBy("created_at", "id").select("id")
    return found if most is None else found.limit(most)


def all_chunks(chunks: DataFrame) -> DataFrame:
    """Every chunk as (id, text, metadata), the metadata being all other columns."""
    rest = [c for c in chunks.columns if c not in ("id", "text", "original_id")]
    return chunks.select("id", "text", F.struct(*rest).alias("metadata"))


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n"))


def sources(chunks: DataFrame) -> DataFrame:
    """Names of all sources, sorted."""
    return chunks.where(F.col("source") != "").select("source").distinct().orderBy("source")


def document_chunks(chunks: DataFrame, doc_id: object) -> DataFrame:
    """A document's chunks in their order; one without an index counts as the first."""
    return lookup(chunks, "doc_id", doc_id).orderBy(F.coalesce("chunk_index", F.lit(0)), "id")


def claimed(documents: DataFrame, n: int = 1) -> DataFrame:
    """The table after the ``n`` oldest queued documents were taken up: they are processing."""
    # n rows
    taken = F.broadcast(documents.where(F.col("status") == "queued").orderBy("created_at", "id").limit(n).select("id").withColumn("_taken", F.lit(True)))
    status = F.when(F.col("_taken"), "processing").otherwise(F.col("status"))
    return documents.join(taken, "id", "left").withColumn("status", status).select(documents.columns)


def claims(documents: DataFrame, workers: list[str], n: int = 1) -> DataFrame:
    """(worker, id, place) of the oldest queued documents, dealt to the workers in turn, ``n`` for each: none goes to two.

    Rows of equal time (ties) go by id; a worker that is named twice counts once.
    """
    names = list(dict.fromkeys(workers))
    oldest = documents.where(F.col("status") == "queued").select("created_at", "id").orderBy("created_at", "id").limit(n * len(names))
    # one window over as many rows as are claimed
    place = F.row_number().over(Window.orderBy("created_at", "id")) - 1
    turn = oldest.withColumn("_p", place)
    return turn.select(F.get(F.array(*map(F.lit, names)), F.col("_p") % len(names)).alias("worker"), "id", F.floor(F.col("_p") / len(names)).cast("int").alias("place"))


def processed(documents: DataFrame, results: DataFrame) -> DataFrame:
    """The table after jobs ended (id, chunks, error): indexed with their chunks, or failed; only what is processing changes."""
    ended = results.select("id", F.col("chunks").alias("_n"), F.col("error").alias("_e"), F.lit(True).alias("_ended"))
    joined = documents.join(ended, "id", "left")
    done = F.coalesce("_ended", F.lit(False)) & (F.col("status") == "processing")
    fine = done & F.col("_e").isNull()
    return joined.withColumns({
        "chunk_count": F.when(fine, F.col("_n")).otherwise(F.col("chunk_count")),
        "status": F.when(fine, "indexed").when(done, "failed").otherwise(F.col("status")),
    }).select(documents.columns)


def fact_count(facts: Column) -> Column:
    """Number of facts in a map of facts by field, without the keys that are none."""
    return F.coalesce(F.size(F.map_filter(facts, lambda k, _: ~k.isin(rules.NO_FACTS))), F.lit(0))


def item_count(items: Column, text: Column) -> Column:
    """Number of a fact's items, or without a list of its lines that begin with a dash."""
    dashed = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), lambda x: F.startswith(F.regexp_replace(x, r"(?U)^\s+", ""), F.lit("-")))
    return F.coalesce(F.size(items), F.size(dashed))


def group_pages(group: Column, base: Column, mode: Column, arabic: Column | None = None) -> Column:
    """Evidence pages for a group of fields: ``base``, widened by the group and the text's quality; a narrow base stays."""
    table = lambda own: F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    of = lambda own: F.coalesce(F.try_element_at(table(own), group), base)
    kind = F.when(F.coalesce(arabic, F.lit(False)) if arabic is not None else F.lit(False), "arabic_noisy").otherwise(F.lower(F.trim(F.coalesce(mode, F.lit("")))))
    wider = base
    for name, own in rules.MODE_GROUP_PAGES.items():
        wider = F.when(kind == name, of(own)).otherwise(wider)
    return F.when(base < rules.NARROW_PAGES, base).otherwise(F.greatest(base, of(rules.GROUP_PAGES), wider))


def health(chunks: DataFrame | None, database: bool = True, llm: bool = True, embeddings: str = "local") -> DataFrame:
    """One row (status, store, database, llm, embeddings, chunks) from the parts' states; without chunks the store is disconnected."""
    state = lambda up: "connected" if up else "disconnected"
    parts = {"store": state(chunks is not None), "database": state(database), "llm": state(llm)}
    well = set(parts.values()) == {"connected"} and embeddings in ("connected", "local")
    counted = chunks.agg(F.count("*").alias("chunks")) if chunks is not None else SparkSession.active().range(1).select(F.lit(0).cast("long").alias("chunks"))
    named = {"status": "healthy" if well else "degraded", **parts, "embeddings": embeddings}
    return counted.select(*[F.lit(v).alias(k) for k, v in named.items()], "chunks")
