"""Lists as evidence: which of two lists of a field is taken, their union in order, and items that tell a fact of another field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import reliable, reliable_fields

# The words of strong lists, the fields that items may tell and the lists they are looked for in, in order.
TARGETS = ["caution", "manufacturer_authorization", "references"]
SOURCES = ["technical_documents", "administrative_documents"]
PROTECTED, PROTECTED_LEAST = "arabic_offer_documents_table", {"administrative_documents": 4, "technical_documents": 2, "financial_documents": 2}
ADMINISTRATIVE = ["registre", "rne", "cnss", "fisc", "cahier", "declaration", "soumissionnaire", "attestation", "الضمان الوقتي", "السجل الوطني", "بطاقة", "تصريح", "ظرف مغلق"]
NOT_TECHNICAL = ["caution bancaire", "caution provisoire", "fiche de renseignements", "cahier des charges", "registre", "rne", "attestation fiscale", "cnss", "non faillite"]
TECHNICAL = [
    "offre technique", "technique", "specification", "documentation", "delai de livraison", "conformite", "fiche produit", "constructeur", "architecture", "bom",
    "support", "programme de formation", "formation", "certification", "certificat", "maintenance", "hpe", "service delivery partner", "العرض الفني", "المواصفات الفنية",
    "تقرير اختبار", "جداول الخاصيات", "جذاذات فنية", "iso",
]
FINANCIAL = ["soumission", "bordereau", "devis", "prix", "financier", "quantite", "pu", "pt", "العرض المالي", "التعهد المالي", "جدول الأثمان"]
BULLET = r"(?U)^\s*(?:[-*+]|\d+[\).:-])\s*"

ITEMS = "array<struct<text:string,page:string>>"


def _texts(items: Column) -> Column:
    return F.transform(F.coalesce(items, F.array().cast(ITEMS)), lambda x: x["text"])


def strong_list(field: Column, items: Column, source: Column) -> Column:
    """Whether a list's items (text, page) carry what its field must show; a null or empty list never does."""
    joined, n = F.array_join(_texts(items), " "), F.size(F.coalesce(items, F.array().cast(ITEMS)))
    arabic = F.when(joined.rlike(f"[{T.ARABIC_SCRIPT}]"), T.arabic_matching(joined))

    def judge(folded: Column) -> Column:
        hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(folded, w)))
        foreign = (hits(NOT_TECHNICAL) >= 3) & (hits(TECHNICAL) <= 2)
        return (
            F.when(field == "administrative_documents", (n >= 3) & (hits(ADMINISTRATIVE) >= 2))
            .when(field == "technical_documents", ~foreign & (n >= 2) & (hits(TECHNICAL) >= 2))
            .when(field == "financial_documents", (n >= 1) & (hits(FINANCIAL) >= 2))
            .otherwise((n >= 2) & (F.char_length(folded) >= 40))
        )

    return (n > 0) & (protected(field, items, source) | T.let(T.fold(F.concat_ws(" ", joined, arabic)), judge))


def protected(field: Column, items: Column, source: Column) -> Column:
    """Whether a list was read from a table of documents and has enough items to stay whatever else is found."""
    least = F.lit(None).cast("int")
    for name, n in PROTECTED_LEAST.items():
        least = F.when(field == name, n).otherwise(least)
    return F.coalesce((source == PROTECTED) & (F.size(items) >= least), F.lit(False))


def _both(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row for each (doc_id, field) with ``a`` and ``b``; of repeated rows (ties) the longest list, then the least."""
    best = lambda df, name: df.groupBy("doc_id", "field").agg(F.min_by(F.struct("items", "source"), F.struct(-F.size("items"), "items", "source")).alias(name))
    return best(current, "a").join(best(candidate, "b"), ["doc_id", "field"], "full")


def merged(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """Lists (doc_id, field, items, source) -> the same columns: the candidate where there is no strong list yet or it has more items.

    A list of a table with enough items stays; an empty or missing candidate changes nothing.
    """
    field, have, new = F.col("field"), F.size(F.coalesce("a.items", F.array().cast(ITEMS))), F.size(F.coalesce("b.items", F.array().cast(ITEMS)))
    weak = ~F.coalesce(strong_list(field, F.col("a.items"), F.col("a.source")), F.lit(False))
    take = (new > 0) & ~protected(field, F.col("a.items"), F.col("a.source")) & (weak | (new > have))
    return _both(current, candidate).select("doc_id", "field", F.when(take | F.col("a").isNull(), F.col("b")).otherwise(F.col("a")).alias("_w")).select("doc_id", "field", "_w.*")


def united(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """(doc_id, field, items): the current items in their order, then the candidate's that say something else; alike by ``text.item_key``."""
    some = lambda c: F.coalesce(c, F.array().cast(ITEMS))
    listed = F.concat(some(F.col("a.items")), some(F.col("b.items")))
    once = lambda own: T.let(F.transform(own, lambda x: T.item_key(x["text"])), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    return _both(current, candidate).select("doc_id", "field", T.let(F.filter(listed, lambda x: x["text"].isNotNull()), once).alias("items"))


def promoted(lists: DataFrame, facts: DataFrame, targets: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Lists (doc_id, field, items) and facts (doc_id, field, text) -> (doc_id, field, text, page, derived_from).

    For each target that a document has no reliable fact of, the first item that is one,
    by the order of ``sources``, then by its place in the list. Items lose their bullets;
    null and empty ones tell nothing. Repeated lists (ties) count by their text.
    """
    targets, sources = targets or TARGETS, sources or SOURCES
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("field"))
    each = lists.where(F.col("field").isin(sources)).select("doc_id", "field", rank.alias("_s"), F.posexplode("items").alias("_i", "_x"))
    items = each.select("doc_id", F.col("field").alias("derived_from"), "_s", "_i", T.strip(F.regexp_replace("_x.text", BULLET, "")).alias("text"), F.coalesce("_x.page", F.lit("?")).alias("page")).where("text != ''")
    # each item is read once for all targets
    told = items.select("*", F.explode(reliable_fields(F.col("text"), targets)).alias("field"))
    first = told.groupBy("doc_id", "field").agg(F.min_by(F.struct("text", "page", "derived_from"), F.struct("_s", "_i", "text", "page")).alias("_b")).select("doc_id", "field", "_b.*")
    known = facts.where(F.col("field").isin(targets) & reliable(F.col("field"), F.col("text"))).select("doc_id", "field").distinct()
    return first.join(known, ["doc_id", "field"], "left_anti")
