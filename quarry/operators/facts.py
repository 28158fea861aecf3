"""Structured facts by rules: patterns over pages, lists under headings, mined facts, profiles.

A rule is data; rule packs are lists of rules. Packs that hold the wording of one
issuer are not part of the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as fixed
from ..functions import text as T
from ..functions.phrases import fields_judged, judged, phrases_in
from ..functions.reliability import PATTERNS, RELIABLE


@dataclass(frozen=True)
class FieldRule:
    """The first page on which ``pattern`` matches gives the field; group 1, or the match if 0.

    ``needs``: a match has one of these phrases in its folded text, so that the pattern is
    tried only on pages that hold one.
    """

    field: str
    pattern: str
    group: int = 1
    most: int = 1200
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class ListRule:
    """Items between a heading and the next stop, within ``most`` characters."""

    field: str
    heading: str
    stop: str
    most: int = 2200


@dataclass(frozen=True)
class MinedRule:
    """Every match gives a fact: the label from group 1, the value from group 2."""

    type: str
    pattern: str


DEFAULT_FIELDS = [
    FieldRule("subject", r"(?isu)\bobjet\s*(?:de\s+[^:]{0,60})?:\s*(.{15,600}?)(?:\.\s|\n\s*\n|$)", needs=("objet",)),
    FieldRule("deadline", r"(?isu)date\s+limite[^.]{0,160}?(\d{1,2}(?:er)?\s+\p{L}+\s+\d{4}|\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", needs=("date limite",)),
    FieldRule("validity", r"(?isu)((?:offres?|soumissions?)[^.]{0,120}valab\w*[^.]{0,120}\d+[^.]{0,40}jours)", needs=("valab",)),
    FieldRule("caution", r"(?isu)(caution(?:nement)?\s+provisoire[^.]{0,200}(?:\d[\d .]*\s*(?:dinars|dt|%)|\d+\s*%))", needs=("caution provisoire", "cautionnement provisoire")),
    FieldRule("definitive_caution", r"(?isu)(caution(?:nement)?\s+d[ée]finiti\w+[^.]{0,200}\d+\s*%)", needs=("caution definiti", "cautionnement definiti")),
    FieldRule("guarantee", r"(?isu)(garantie[^.]{0,160}\d+\s*(?:\([^)]*\)\s*)?(?:mois|ans?|années?))", needs=("garantie",)),
    FieldRule("penalties", r"(?isu)(p[ée]nalit[ée]s?[^.]{0,220}(?:retard|jour|mille)[^.]{0,120})", needs=("penalite",)),
    FieldRule("payment", r"(?isu)(paiement[^.]{0,300}(?:jours|facture|r[ée]ception|%)[^.]{0,120})", needs=("paiement",)),
    FieldRule("opening", r"(?isu)(ouverture\s+des\s+(?:plis|offres)[^.]{0,220})", needs=("ouverture des",)),
    FieldRule("reception", r"(?isu)(r[ée]ception\s+(?:provisoire|d[ée]finitive|quantitative)[^.]{0,220})", needs=("reception provisoire", "reception definitive", "reception quantitative")),
    FieldRule("variants", r"(?isu)(variantes?[^.]{0,160}(?:admis\w*|accept\w*|interdit\w*|autoris\w*)[^.]{0,60})", needs=("variante",)),
    FieldRule("references", r"(?isu)(r[ée]f[ée]rences?[^.]{0,200}(?:projets?|ann[ée]es|liste|similaires)[^.]{0,100})", needs=("reference",)),
]
DEFAULT_LISTS = [
    ListRule("administrative_documents", r"(?iu)documents?\s+administratifs?\s*:?", r"(?iu)documents?\s+(?:techniques?|financiers?)|offre\s+(?:technique|financi[eè]re)"),
    ListRule("technical_documents", r"(?iu)documents?\s+techniques?\s*:?", r"(?iu)documents?\s+(?:administratifs?|financiers?)|offre\s+financi[eè]re"),
    ListRule("financial_documents", r"(?iu)documents?\s+financiers?\s*:?", r"(?iu)documents?\s+(?:administratifs?|techniques?)|article\s+\d"),
]
DEFAULT_MINED = [
    MinedRule("lot", r"(?iu)\bLOT\s*(?:N[°o]\s*)?(\d{1,3})\s*[:\-–]\s*([^\n]{3,260})"),
    MinedRule("metric", r"(?iu)\b(nombre\s+d['e]\s*[\p{L} ]{3,40}|quantit[ée])\s*[:=]\s*(\d+)"),
    MinedRule("requirement", r"(?imu)^\s*[-•]?\s*([\p{L}][\p{L} ]{2,40})\s*:\s*([^\n:]{2,120})$"),
]
#: The fields of a profile that count as its core.
CORE_FIELDS = [
    "subject", "deadline", "validity", "opening", "caution", "definitive_caution", "guarantee", "reception",
    "penalties", "payment", "submission_method", "variants",
]


def field_facts(pages: DataFrame, rules: list[FieldRule] | None = None) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, field, text, page): per field the first page, the first rule."""
    rules = rules or DEFAULT_FIELDS
    needs = list(dict.fromkeys(x for r in rules for x in r.needs))
    own = pages.withColumn("_held", phrases_in(F.col("text"), needs)) if needs else pages

    def value(r: FieldRule) -> Column:
        found = F.left(T.compact(F.regexp_extract(F.col("text"), r.pattern, r.group)), F.lit(r.most))
        return F.when(F.arrays_overlap("_held", F.array(*[F.lit(needs.index(x)) for x in r.needs])), found).otherwise("") if r.needs else found

    tried = F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(k).alias("rule"), value(r).alias("text")) for k, r in enumerate(rules)])
    found = own.select("doc_id", "page_seq", "page", F.inline(F.filter(tried, lambda x: x["text"] != "")))
    best = F.min_by(F.struct("text", "page"), F.struct("page_seq", "rule"))
    return found.groupBy("doc_id", "field").agg(best.alias("_b")).select("doc_id", "field", "_b.text", "_b.page")


def all_matches(pages: DataFrame, rules: list[FieldRule]) -> DataFrame:
    """Every match of every rule, distinct by page and lower-cased text."""
    def tries(k: int, r: FieldRule) -> Column:
        hits = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        return F.transform(hits, lambda x: F.struct(F.lit(r.field).alias("field"), F.lit(k).alias("rule"), T.compact(x).alias("match")))

    tried = F.flatten(F.array(*[tries(k, r) for k, r in enumerate(rules)]))
    found = pages.select("doc_id", "page_seq", F.inline(F.filter(tried, lambda x: x["match"] != "")))
    order = Window.partitionBy("doc_id", "page_seq", "field", F.lower("match")).orderBy("rule")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def list_segment(text: Column, rule: ListRule) -> Column:
    """What follows the heading, up to the next stop or ``most`` characters; null without heading."""
    after = F.get(F.split(text, rule.heading, 2), F.lit(1))
    return F.left(F.get(F.split(after, rule.stop, 2), F.lit(0)), F.lit(rule.most))


def list_facts(pages: DataFrame, rules: list[ListRule] | None = None, most: int = 12) -> DataFrame:
    """(doc_id, field, items, page): the first page with items under the field's heading."""
    from .chunking import listed_items

    tried = F.array(*[
        F.struct(F.lit(r.field).alias("field"), listed_items(F.coalesce(list_segment(F.col("text"), r), F.lit("")), most).alias("items")) for r in rules or DEFAULT_LISTS
    ])
    found = pages.select("doc_id", "page_seq", "page", F.inline(F.filter(tried, lambda x: F.size(x["items"]) > 0)))
    return found.groupBy("doc_id", "field").agg(F.min_by(F.struct("items", "page"), "page_seq").alias("_b")).select("doc_id", "field", "_b.items", "_b.page")


def mined_facts(pages: DataFrame, rules: list[MinedRule] | None = None) -> DataFrame:
    """(doc_id, type, label, value, page): every match, distinct by folded label and value, the first wins."""
    def tries(r: MinedRule) -> Column:
        part = lambda g: F.regexp_extract_all("text", F.lit(r.pattern), F.lit(g))
        return F.zip_with(part(1), part(2), lambda a, b: F.struct(F.lit(r.type).alias("type"), T.compact(a).alias("label"), T.compact(b).alias("value")))

    tried = F.flatten(F.array(*[tries(r) for r in rules or DEFAULT_MINED]))
    kept = F.filter(tried, lambda x: (x["label"] != "") & (x["value"] != ""))
    found = pages.select("doc_id", "page_seq", "page", F.posexplode(kept).alias("_i", "_f")).select("doc_id", "page_seq", "page", "_i", "_f.*")
    order = Window.partitionBy("doc_id", "type", T.fold(F.col("label")), T.fold(F.col("value"))).orderBy("page_seq", "_i")
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("doc_id", "type", "label", "value", "page")


def placeholders(pages: DataFrame, pattern: str = r"\b(IM|DPAO)\s*\(?(\d{1,3})\)?\s*[:=]\s*([^\n]{1,300})") -> DataFrame:
    """(doc_id, key, value): the longest value that follows each numbered place-holder."""
    part = lambda g: F.regexp_extract_all("text", F.lit(pattern), F.lit(g))
    found = pages.select("doc_id", F.inline(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))))
    return found.select("doc_id", F.concat("a", F.col("b").cast("int")).alias("key"), T.compact(F.col("c")).alias("value")).groupBy("doc_id", "key").agg(
        F.max_by("value", F.struct(F.char_length("value"), "value")).alias("value")
    )


def reliable(field: Column, text: Column) -> Column:
    """Whether a fact's text carries what its field must show, by the table ``reliability.RELIABLE``; an empty text never does."""
    return (T.strip(F.coalesce(text, F.lit(""))) != "") & judged(field, text, RELIABLE, PATTERNS)


def reliable_fields(text: Column, fields: list[str]) -> Column:
    """Which of the fields a text is a ``reliable`` fact of."""
    good = fields_judged(text, fields, RELIABLE, PATTERNS)
    return F.when(T.strip(F.coalesce(text, F.lit(""))) != "", good).otherwise(F.array().cast("array<string>"))


def preferred(current: DataFrame, other: DataFrame) -> DataFrame:
    """Of two facts (doc_id, field, text, confidence) of a field the surer, then the longer; ties keep the current."""
    both = current.withColumn("_s", F.lit(1)).unionByName(other.withColumn("_s", F.lit(0)))
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    best = F.max_by(F.struct("text", "confidence"), F.struct(reliable(F.col("field"), F.col("text")), sure, F.char_length("text"), "_s"))
    return both.groupBy("doc_id", "field").agg(best.alias("_b")).select("doc_id", "field", "_b.*")


def profile(facts: DataFrame, core: list[str] | None = None) -> DataFrame:
    """Per document: core fields present, their share, and the missing ones."""
    core = core or CORE_FIELDS
    wanted = F.array(*map(F.lit, core))
    have = F.array_intersect(wanted, F.collect_set("field"))
    return facts.groupBy("doc_id").agg(have.alias("_h")).select(
        "doc_id", F.size("_h").alias("core_present"), F.round(F.size("_h") / len(core), 3).alias("core_ratio"),
        F.array_join(F.array_except(wanted, "_h"), ",").alias("missing_core"),
    )


def evidence_pages(pages: DataFrame, keywords: list[str], most: int = 5, chars: int = 1800) -> DataFrame:
    """Pages (doc_id, page_seq, text, heading, section) by keyword hits, at most ``most``; one without hits only if it is the first."""
    # every text is folded and read once for all keywords
    found = pages.withColumns({"_t": phrases_in(F.col("text"), keywords), "_h": phrases_in(F.coalesce("heading", F.lit("")), keywords)})
    early = F.when(F.col("page_seq") <= 2, 4).otherwise(0)
    named = F.lit(0)
    for word in keywords:
        named = named + F.when(F.contains(F.coalesce("section", F.lit("")), T.fold(F.lit(word))), 8).otherwise(0)
    score = early + 10 * F.coalesce(F.size("_t"), F.lit(0)) + 25 * F.size("_h") + named
    order = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "page_seq")
    ranked = found.withColumn("score", score).drop("_t", "_h").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= most) & ((F.col("score") > 0) | (F.col("rank") == 1))).withColumn("text", F.left("text", F.lit(chars)))


def document_facts(pages: DataFrame, rules: list[FieldRule] | None = None) -> DataFrame:
    """Reliable scalar facts of every document, as a long table."""
    found = field_facts(pages, rules)
    return found.where(reliable(F.col("field"), F.col("text"))).withColumn("confidence", F.lit("high"))


def warning(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with at most one fact whose text is fragmented."""
    text = pages.groupBy("doc_id").agg(F.avg(T.short_fragment_ratio(F.col("text"))).alias("fragments"), F.sum(F.char_length("text")).alias("chars"), F.count("*").alias("pages"))
    n = facts.groupBy("doc_id").agg(F.count("*").alias("facts"))
    joined = text.join(n, "doc_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    return joined.where((F.col("facts") <= 1) & ((F.col("fragments") >= 0.32) | (F.col("chars") / F.col("pages") < 320)))


def resolved(facts: DataFrame, values: DataFrame, pattern: str = r"\b(IM|DPAO)\s*\(?(\d{1,3})\)?") -> DataFrame:
    """Facts (doc_id, field, text) with place-holders replaced by their values (doc_id, key, value)."""
    table = values.groupBy("doc_id").agg(F.collect_list(F.struct("key", "value")).alias("_v"))
    joined = facts.join(table, "doc_id", "left")
    # the same key may be written with or without brackets
    plain = F.regexp_replace("text", pattern, "$1$2")
    text = F.aggregate(F.coalesce("_v", F.array().cast("array<struct<key:string,value:string>>")), plain, lambda t, v: F.regexp_replace(t, F.concat(F.lit(r"\b"), v["key"], F.lit(r"\b")), F.regexp_replace(v["value"], r"([\\$])", r"\\$1")))
    return joined.withColumn("text", F.when(F.col("text").rlike(pattern), text).otherwise(F.col("text"))).select(facts.columns)


def mined_scores(mined: DataFrame, questions: DataFrame, least: int = 4) -> DataFrame:
    """Mined facts (doc_id, type, label, value) that share enough with each question (query_id, doc_id, question).

    Two points for each term that the label has, one for the value's, and three if
    the question names the type.
    """
    asked = questions.select("query_id", "doc_id", T.terms_of(F.col("question")).alias("_t"), T.normalize_query(F.col("question")).alias("_q"))
    words = lambda c: F.split(T.normalize_query(F.col(c)), " ")
    joined = mined.join(asked, "doc_id")
    score = 2 * F.size(F.array_intersect("_t", words("label"))) + F.size(F.array_intersect("_t", words("value"))) + F.when(F.contains("_q", "type"), 3).otherwise(0)
    kept = joined.withColumn("score", score).where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "type", "label", "value")
    return kept.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "type", "label", "value", "score", "rank")


def fact_text(text: Column) -> Column:
    """A fact's text without control characters, up to the next section's start; a guarantee's may name a caution."""
    plain = T.compact(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))
    # a split would compile its pattern for every text
    cut = lambda x, starts: F.regexp_replace(x, rf"(?isU)\s+\b(?:{starts})\b.*", "")
    about = lambda x: x.rlike(r"(?isU)^(?:(?:un|une|la)\s+)?(?:caution|cautionnement|garantie)\s+")
    own = T.let(plain, lambda x: F.when(about(x), cut(x, fixed.SECTION_STARTS)).otherwise(cut(x, fixed.SECTION_STARTS + "|CAUTION")))
    return T.compact(F.regexp_replace(T.compact(own), r"(?iU)\b(?:article|lot|chapitre)\s+\d+\b.*$", ""))


def pricing_items(pages: DataFrame) -> DataFrame:
    """(doc_id, type, label, value, page): the rows of price schedules, distinct by folded label and value, the first wins."""
    rows = pages.select("doc_id", "page_seq", "page", T.compact(F.col("text")).alias("_x"), T.fold(F.col("text")).alias("_f"))
    priced = F.exists(F.array(*map(F.lit, fixed.PRICE_PAGES)), lambda m: F.contains(F.col("_f"), m))
    part = lambda g: F.regexp_extract_all("_x", F.lit("(?iU)" + fixed.PRICE_ROW), F.lit(g))
    lot = F.regexp_extract("_x", "(?isU)" + fixed.PRICE_LOT, 1)
    head = F.when(lot == "", "Bordereau").otherwise(F.concat(F.lit("Lot "), lot))
    found = rows.where(priced).select("doc_id", "page_seq", "page", head.alias("_h"), F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))).alias("_i", "_r"))
    made = found.select(
        "doc_id", "page_seq", "page", "_i", F.lit("pricing_item").alias("type"), F.concat("_h", F.lit(" item "), "_r.a").alias("label"),
        T.compact(F.concat(fact_text(F.col("_r.b")), F.lit(" - Unite "), F.col("_r.c"))).alias("value"),
    )
    order = Window.partitionBy("doc_id", T.fold(F.col("label")), T.fold(F.col("value"))).orderBy("page_seq", "_i")
    return made.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", "type", "label", "value", "page")


def subject_score(text: Column, page: Column, pattern: Column) -> Column:
    """(explicit, pattern, length, page) by which candidates for the subject are compared; a null text counts as empty."""
    own = F.coalesce(text, F.lit(""))
    number = F.regexp_extract(F.coalesce(page.cast("string"), F.lit("")), r"(?U)^\s*([+-]?\d+)(?:\s|$)", 1).try_cast("int")
    early = F.coalesce(-number, F.lit(-999))
    some = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    every = lambda c, words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(c, w))
    give = lambda cond, weight: F.when(cond, weight).otherwise(0)

    def explicit(forms: Column) -> Column:
        low, folded = forms["low"], forms["folded"]
        out = F.lit(0)
        for weight, words in fixed.SUBJECT_SIGNS:
            out = out + give(every(low, words), weight)
        for weight, words in fixed.SUBJECT_FOLDED_SIGNS:
            out = out + give(every(folded, words), weight)
        out = out + give(some(folded, fixed.SUBJECT_TENDER), fixed.SUBJECT_TENDER_WEIGHT) + give(own.rlike(r"(?U)\d"), fixed.SUBJECT_DIGIT)
        # an early page helps only what nothing else speaks for
        helped = T.let(out, lambda x: x + give((early >= -3) & (x < 50) & F.contains(folded, F.lit("objet")), fixed.SUBJECT_EARLY))
        return (
            helped + give(F.char_length(own) < 25, fixed.SUBJECT_SHORT)
            + give(some(low, fixed.SUBJECT_REFUSED), fixed.SUBJECT_REFUSED_WEIGHT)
            + give(some(folded, fixed.SUBJECT_CONTENTS), fixed.SUBJECT_CONTENTS_WEIGHT)
            + give(F.regexp_count(own, F.lit(r"(?iU)\bARTICLE\s*\d+\b")) >= 3, fixed.SUBJECT_ARTICLES)
            + give(folded.rlike(r"(?U)^\s*annexe\s+(?:n[°o]\s*)?\d+") | some(folded, ["modele de soumission", "formulaire de reponse"]), fixed.SUBJECT_ANNEX)
            + give(own.rlike(r"(?U)\.{2,}\s*,?\s*\d+\s*="), fixed.SUBJECT_LEADERS)
            + give(((F.regexp_count(own, F.lit(", 1 =")) >= 2) | F.contains(folded, F.lit("composition du marche"))) & ~F.contains(folded, F.lit("a pour objet")), fixed.SUBJECT_LIST)
        )

    forms = F.struct(F.lower(F.replace(own, F.lit("’"), F.lit("'"))).alias("low"), T.fold(own).alias("folded"))
    return F.struct(
        T.let(forms, explicit).cast("int").alias("explicit"), (20 - F.coalesce(pattern, F.lit(20))).cast("int").alias("pattern"),
        F.least(F.char_length(own), F.lit(240)).alias("length"), early.cast("int").alias("page"),
    )


def best_subject(candidates: DataFrame) -> DataFrame:
    """Candidates (doc_id, text, page, pattern) -> (doc_id, text, page, score): the highest score, of equals the least text."""
    score = subject_score(F.col("text"), F.col("page"), F.col("pattern"))
    scored = candidates.select("doc_id", "text", "page", score.alias("score"))
    first = F.min_by(F.struct("text", "page", "score"), F.struct(*[(-F.col(f"score.{k}")).alias(k) for k in ("explicit", "pattern", "length", "page")], F.col("text").alias("_t")))
    return scored.groupBy("doc_id").agg(first.alias("_b")).select("doc_id", "_b.*")
