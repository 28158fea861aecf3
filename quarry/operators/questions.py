"""What kind of question is asked, and answers that are read off chunks or facts without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T

# case of any script is ignored, and classes are those of Unicode
_ANY = "(?isU)"


def kind_flags(question: Column) -> dict[str, Column]:
    """For each kind of question whether a question is of it; false for a null."""

    def some(padded: Column, phrases: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(f" {phrase} ") for phrase in phrases]), lambda x: F.contains(padded, x))

    def flags(padded: Column) -> Column:
        of = {kind: some(padded, phrases) for kind, phrases in rules.QUESTION_KINDS.items()}
        of["organization"] = of["organization"] | (some(padded, rules.ORGANIZATION_WORDS) & some(padded, rules.ORGANIZATION_SHAPES))
        words = F.lit(True)
        for group in rules.ASSISTANT_WORDS:
            words = words & some(padded, group)
        of["assistant"] = of["assistant"] | words
        return F.struct(*[flag.alias(kind) for kind, flag in of.items()])

    found = T.let(F.concat(F.lit(" "), T.normalize_query(F.coalesce(question, F.lit(""))), F.lit(" ")), flags)
    return {kind: found[kind] for kind in rules.QUESTION_KINDS}


def of_chunk(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, r"(?U)\s+", " "))


def following(text: Column, head: str) -> Column:
    """What follows a head up to the end of the statement, without marks at its ends; '' where there is no head."""
    return T.compact(F.regexp_extract(text, f"{_ANY}{head}(.+?){rules.ANSWER_STOP}", 1))


def cited(answer: Column, source: Column, page: Column) -> Column:
    """An answer with its source and page, where both are known."""
    known = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(page, F.lit("")) != "")
    return F.when(known, F.concat(answer, F.lit("\nSource: "), source, F.lit(", page "), page, F.lit("."))).otherwise(answer)


def _first(questions: DataFrame, chunks: DataFrame, answer: Column) -> DataFrame:
    """The answer of each question's first chunk that has one; of chunks of one rank the least answer."""
    found = questions.join(chunks.select("query_id", "rank", F.col("text").alias("_text"), "source", "page"), "query_id").withColumn("_answer", answer)
    given = found.where("_answer <> ''").select("query_id", "rank", cited(F.col("_answer"), F.col("source"), F.col("page")).alias("_answer"))
    return given.groupBy("query_id").agg(F.min_by("_answer", F.struct("rank", "_answer")).alias("answer"))


def direct_answers(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions (query_id, question), their chunks (query_id, rank, text, source, page) -> (query_id, answer).

    Only questions for the subject or the deadline are answered: by the first head
    that matches in the first chunk that has one. Others, and those without such a
    chunk, have no row.
    """
    flags = kind_flags(F.col("question"))
    kind = F.when(flags["subject"], "subject").when(flags["deadline"], "deadline")
    asked = questions.select("query_id", kind.alias("_kind")).where("_kind is not null")

    def first(heads: list[str], text: Column) -> Column:
        return F.coalesce(*[F.nullif(following(text, head), F.lit("")) for head in heads])

    answer = T.let(of_chunk(F.col("_text")), lambda x: F.when(F.col("_kind") == "subject", first(rules.DIRECT_HEADS["subject"], x)).otherwise(first(rules.DIRECT_HEADS["deadline"], x)))
    return _first(asked, chunks, answer)


def summary_of(text: Column) -> Column:
    """At most two parts of a text: what follows its heads and its listed items, else its first sentences; '' for an empty one."""

    def distinct(parts: Column) -> Column:
        """Parts that neither contain an earlier one nor are contained in it."""
        start = F.array().cast("array<struct<n:string,x:string>>")

        def add(kept: Column, part: Column) -> Column:
            normal = T.normalize_query(part)
            same = F.exists(kept, lambda k: F.contains(k["n"], normal) | F.contains(normal, k["n"]))
            return F.when((part == "") | same, kept).otherwise(F.concat(kept, F.array(F.struct(normal.alias("n"), part.alias("x")))))

        return F.transform(F.slice(F.aggregate(parts, start, add), 1, rules.SUMMARY_PARTS), lambda k: k["x"])

    def stated(found: Column, before: str) -> Column:
        return T.let(found, lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(before), x)))

    def parts(whole: Column) -> Column:
        heads = [stated(following(whole, head), before) for head, before in rules.SUMMARY_HEADS]
        found = F.regexp_extract_all(whole, F.lit(r"(?U)[•\-]\s*([^•]+?)(?=[•\-]|$)"), F.lit(1))
        items = F.slice(F.transform(F.filter(found, lambda x: F.char_length(of_chunk(x)) > rules.SUMMARY_ITEM_LEAST), T.compact), 1, rules.SUMMARY_ITEMS)
        listed = T.let(items, lambda x: F.when(F.size(x) > 0, T.compact(F.concat(F.lit(rules.SUMMARY_LISTED), F.array_join(x, ", ")))).otherwise(""))
        sentences = F.transform(F.filter(F.split(whole, r"(?<=[.!?]) +"), lambda x: F.char_length(x) > rules.SUMMARY_SENTENCE_LEAST), T.compact)
        own = F.filter(F.array(*heads, listed), lambda x: x != "")
        return T.let(own, lambda x: distinct(F.when(F.size(x) > 0, x).otherwise(F.slice(sentences, 1, 2))))

    return F.array_join(T.let(of_chunk(F.coalesce(text, F.lit(""))), parts), " ")


def summary_answers(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """As ``direct_answers``, for questions that ask for a summary."""
    asked = questions.where(kind_flags(F.col("question"))["summary"]).select("query_id")
    return _first(asked, chunks, summary_of(F.col("_text")))


def fact_summaries(facts: DataFrame) -> DataFrame:
    """Facts (doc_id, field, text, page, source) -> (doc_id, answer): the stored summary, else subject and deadline.

    Of several facts of a field the one of the least (page, text) counts. Documents
    with none of the three fields have no row.
    """
    def of(field: str) -> Column:
        value = F.struct(T.compact(F.col("text")).alias("text"), "page", "source")
        return F.min_by(value, F.when(F.col("field") == field, F.struct("page", "text"))).alias(field)

    rows = facts.groupBy("doc_id").agg(*map(of, ["summary", "subject", "deadline"]))
    deadline = F.when(F.col("deadline.text") != "", F.concat(F.lit(rules.SUMMARY_DEADLINE), "deadline.text", F.lit(".")))
    main = F.coalesce("subject", "deadline")
    parts = F.nullif(F.concat_ws(" ", "subject.text", deadline), F.lit(""))
    whole = F.nullif(F.col("summary.text"), F.lit(""))
    answer = F.coalesce(cited(whole, F.col("summary.source"), F.col("summary.page")), cited(parts, main["source"], main["page"]))
    return rows.select("doc_id", answer.alias("answer")).where("answer is not null")


def _joined(phrases: Column) -> Column:
    """Phrases with commas, and ' puis ' before the last."""
    n = F.size(phrases)
    return F.when(n <= 1, F.array_join(phrases, "")).otherwise(F.concat(F.array_join(F.slice(phrases, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" puis "), F.element_at(phrases, -1)))


def _named(normal: Column, entries: list[tuple[str, list[str]]]) -> Column:
    """The names of the entries one of whose words a normalised text contains."""
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(normal, w)), F.lit(name)) for name, words in entries]))


def short_reception(value: Column) -> Column:
    """A long account of receptions told by its types and conditions, if it has two types or more."""
    def told(normal: Column) -> Column:
        types, details = _named(normal, [(x, [x]) for x in rules.RECEPTION_TYPES]), _named(normal, rules.RECEPTION_DETAILS)
        tail = F.when(F.size(details) > 0, F.concat(F.lit(" ("), F.array_join(details, "; "), F.lit(")"))).otherwise("")
        return F.when(F.size(types) >= 2, F.concat(F.lit("Modalites de reception: "), _joined(types), tail, F.lit(".")))

    return F.coalesce(F.when(F.char_length(value) >= rules.RECEPTION_LEAST, T.let(T.normalize_query(value), told)), value)


def short_guarantee(value: Column) -> Column:
    """A long account of a guarantee told by its durations, distinct when folded, the first four."""
    def told(durations: Column) -> Column:
        keyed = F.transform(durations, lambda x, i: F.struct(T.normalize_query(x).alias("k"), i.alias("i"), T.compact(x).alias("x")))
        first = F.filter(keyed, lambda d: ~F.exists(keyed, lambda e: (e["k"] == d["k"]) & (e["i"] < d["i"])))
        return F.when(F.size(first) > 0, F.concat(F.lit("Garantie: "), F.array_join(F.transform(F.slice(first, 1, rules.GUARANTEE_MOST), lambda d: d["x"]), "; "), F.lit(".")))

    long = (F.char_length(value) >= rules.GUARANTEE_LEAST) & F.contains(T.normalize_query(value), F.lit("garantie"))
    return F.coalesce(F.when(long, T.let(F.regexp_extract_all(value, F.lit(_ANY + rules.DURATION), F.lit(0)), told)), value)


def short_value(field: Column, value: Column) -> Column:
    """A fact's value as the checklist tells it."""
    return F.when(field == "reception", short_reception(value)).when(field == "guarantee", short_guarantee(value)).otherwise(value)
