"""The facts-first cascade that answers batches of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.phrases import phrases_in
from . import facts as facts_of
from . import questions as asks

#: Words of a question that ask for a field, in order of priority.
FIELD_WORDS = [
    ("deadline", ["date limite", "deadline", "delai de remise"]),
    ("definitive_caution", ["caution definitive", "cautionnement definitif"]),
    ("caution", ["caution", "cautionnement"]),
    ("validity", ["validite", "valable", "validity"]),
    ("opening", ["ouverture", "l'ouverture", "d'ouverture", "opening"]),
    ("guarantee", ["garantie", "warranty"]),
    ("penalties", ["penalite", "penalites", "penalty", "penalties"]),
    ("payment", ["paiement", "payment"]),
    ("reception", ["reception"]),
    ("variants", ["variante", "variantes"]),
    ("references", ["reference", "references"]),
    ("subject", ["objet", "l'objet", "sujet", "subject", "projet", "project"]),
]
IDENTITY = ["what can you do"]
#: Texts of fixed answers by language.
WHO = {"fr": "Je réponds aux questions sur vos documents.", "en": "I answer questions about your documents.", "ar": "أجيب عن الأسئلة حول وثائقك."}
NOT_FOUND = {"fr": "Information non mentionnée dans le document.", "en": "Not mentioned in the document.", "ar": "غير مذكور في الوثيقة."}


def by_language(language: Column, texts: dict[str, str]) -> Column:
    out = F.lit(texts["fr"])
    for code, text in texts.items():
        out = F.when(language == code, F.lit(text)).otherwise(out)
    return out


def field_of(question: Column) -> Column:
    """The first field whose words a question has."""
    normal = T.normalize_query(question)
    return F.coalesce(*[F.when(T.has_any(normal, words), F.lit(field)) for field, words in FIELD_WORDS])


def answered(
    questions: DataFrame, facts: DataFrame, passages: DataFrame | None = None, generate: Callable[[Column, Column], Column] | None = None, strict: bool = False
) -> DataFrame:
    """Questions (query_id, question, doc_id) -> (query_id, answer, stage).

    The order is: who is asked, a stored fact, the best passage (query_id,
    passage), a generated answer from it unless it shows guesswork, and the fixed
    text for what is not found. ``strict`` stops after the facts.
    """
    rows = questions.withColumns({"_field": field_of(F.col("question")), "_language": T.answer_language(F.col("question"))})
    rows = rows.withColumn("_who", asks.kind_flags(F.col("question"))["assistant"] | T.has_any(T.normalize_query(F.col("question")), IDENTITY))
    known = facts.select("doc_id", F.col("field").alias("_field"), F.col("text").alias("_fact"), F.col("page").alias("_page"))
    rows = rows.join(known, ["doc_id", "_field"], "left")
    if passages is not None:
        rows = rows.join(passages.select("query_id", F.col("passage").alias("_passage")), "query_id", "left")
    else:
        rows = rows.withColumn("_passage", F.lit(None).cast("string"))
    made = generate(F.col("question"), F.col("_passage")) if generate else F.col("_passage")
    made = F.when(~T.guesswork(made), T.strip_reasoning(made))
    stages = [("identity", F.when(F.col("_who"), by_language(F.col("_language"), WHO))), ("fact", F.when(F.col("_fact").isNotNull(), F.concat(F.col("_fact"), F.lit(" (page "), F.coalesce("_page", F.lit("?")), F.lit(")"))))]
    if not strict:
        stages.append(("passage", F.when(F.col("_passage").isNotNull(), made)))
    stages.append(("missing", by_language(F.col("_language"), NOT_FOUND)))
    answer = F.coalesce(*[c for _, c in stages])
    stage = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in stages])
    return rows.select("query_id", answer.alias("answer"), stage.alias("stage"))


def checklist(facts: DataFrame, documents: DataFrame, items: list[tuple[str, str]] | None = None) -> DataFrame:
    """One text for each document: every question of the list with its fact, or that it is missing."""
    items = items or [(field.replace("_", " ").capitalize(), field) for field in facts_of.CORE_FIELDS]
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(q).alias("q"), F.lit(f).alias("field")) for k, (q, f) in enumerate(items)])
    asked = documents.select("doc_id", F.inline(listed))
    joined = asked.join(facts.select("doc_id", "field", "text"), ["doc_id", "field"], "left")
    line = F.concat((F.col("k") + 1).cast("string"), F.lit(". "), "q", F.lit(": "), F.coalesce("text", F.lit(NOT_FOUND["fr"])))
    return joined.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("checklist"))


def full_checklist(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The checklist of all fixed questions, long values of receptions and guarantees told short."""
    told = facts.withColumn("text", asks.short_value(F.col("field"), F.col("text")))
    return checklist(told, documents, [(question, field) for question, field, _ in rules.CHECKLIST])


def flagged_checklist(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, number, question, field, answer): one row for each document and fixed question.

    Answers to questions of presence begin with a yes, that about variants with a no where
    its text refuses them; a question without a fact, or with an empty one, is answered as not
    found. A document has its rows whether it has facts or not; of several facts of a field
    (ties) the least text is taken.
    """
    items = F.array(*[F.struct(F.lit(k + 1).alias("number"), F.lit(q).alias("question"), F.lit(f).alias("field"), F.lit(p).alias("presence")) for k, (q, f, p) in enumerate(rules.CHECKLIST)])
    told = facts.withColumn("value", T.compact(asks.short_value(F.col("field"), F.col("text")))).where("value <> ''").groupBy("doc_id", "field").agg(F.min("value").alias("value"))
    refused = F.size(phrases_in(F.col("value"), rules.VARIANTS_REFUSED, punctuation=False)) > 0
    answer = (
        F.when(F.col("value").isNull(), F.lit(NOT_FOUND["fr"]))
        .when(F.col("field") == "variants", F.concat(F.when(refused, "Non - ").otherwise("Oui / a verifier - "), F.col("value")))
        .when(F.col("presence"), F.concat(F.lit("Oui - "), F.col("value")))
        .otherwise(F.col("value"))
    )
    asked = documents.select("doc_id").distinct().select("doc_id", F.inline(items))
    return asked.join(told, ["doc_id", "field"], "left").select("doc_id", "number", "question", "field", answer.alias("answer"))


def prompts(questions: DataFrame, context: str = "context") -> DataFrame:
    """Prompts from questions and their context."""
    head = F.lit("Answer only from the context. If it does not say, answer so.\n\nContext:\n")
    return questions.withColumn("prompt", F.concat(head, context, F.lit("\n\nQuestion: "), "question"))
