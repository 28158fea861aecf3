"""Articles over page breaks: an offset index of joined pages, sections from marker to marker, facts by article.

Pages of a document are thought of as one text, joined by an empty line, but are never
joined as a whole: each page is cut at the markers that begin in it, the pieces are
numbered by a running count of markers, and only the pieces of one article come together.
Every article keeps where in its text each page begins, so a fact has the page on which
it stands, be it pages after the article's heading.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import offsets

#: What begins an article, and how much of the next page is read for one that a page break cuts.
MARKER = r"\bARTICLE\s*\d+\b"
CUT = 64
GAP = 2


def page_at(points: DataFrame, pages: DataFrame, by: str = "doc_id", order: str = "page_seq", text: str = "text") -> DataFrame:
    """Points (doc_id, offset, ...) with the page_seq and page that hold the offset of the joined text.

    An as-of lookup: pages and points are sorted by offset and each point takes the last
    page that begins at or before it. The blank between two pages counts to the former;
    an offset before the first page or in a document without pages has none.
    """
    starts = offsets(pages, by, order, text, GAP).select(by, F.col("start").cast("long").alias("offset"), F.struct(F.col(order), "page").alias("_page"))
    rows = points.withColumn("_page", F.lit(None).cast(starts.schema["_page"].dataType)).withColumn("_point", F.lit(1))
    both = rows.unionByName(starts.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    last = F.last("_page", ignorenulls=True).over(Window.partitionBy(by).orderBy("offset", "_point").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_page", last).where("_point = 1")
    return found.select(*points.columns, F.col(f"_page.{order}").alias(order), F.col("_page.page").alias("page"))


def _cut(own: Column, head: Column, marker: str) -> Column:
    """Pieces (at, text, begins) of a page; ``head`` is what follows on the next page."""
    # each list is made once, not again for each of its pieces
    def placed(parts: Column) -> Column:
        at = F.transform(parts, lambda x, i: F.struct(F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, y: n + F.char_length(y)).alias("at"), x.rlike(rf"(?iU)^{marker}").alias("begins")))
        return T.let(F.filter(at, lambda x: (x["at"] < F.char_length(own)) & (x["begins"] | (x["at"] == 0))), texts)

    def texts(inside: Column) -> Column:
        return F.transform(inside, lambda x, i: F.struct(
            x["at"].alias("at"), x["begins"].alias("begins"),
            F.substring(own, x["at"] + 1, F.coalesce(F.get(inside, i + 1)["at"], F.char_length(own)) - x["at"]).alias("text"),
        ))

    return T.let(F.split(F.concat(own, F.lit("\n" * GAP), head), rf"(?iU)(?={marker})"), placed)


def _blanks(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, r"(?U)\s+", " "))


def sections(pages: DataFrame, marker: str = MARKER) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, number, page_seq, page, text, places), one row for each article.

    ``text`` has single blanks; ``places`` are (begins, page) where each page begins in it.
    What stands before the first marker belongs to no article. Null texts are empty
    pages; pages of equal page_seq (ties) go by text.
    """
    order = Window.partitionBy("doc_id").orderBy("page_seq", "text")
    some = pages.select("doc_id", "page_seq", F.col("page").cast("string").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    headed = some.withColumns({"_head": F.coalesce(F.left(F.lead("text").over(order), F.lit(CUT)), F.lit("")), "_row": F.row_number().over(order)})
    pieces = headed.select("doc_id", "page_seq", "page", "_row", F.explode(_cut(F.col("text"), F.col("_head"), marker)).alias("_p"))
    along = Window.partitionBy("doc_id").orderBy("_row", "_p.at").rowsBetween(Window.unboundedPreceding, 0)
    counted = pieces.withColumn("number", F.sum(F.col("_p.begins").cast("int")).over(along)).where("number > 0")
    own = counted.select("doc_id", "number", "page_seq", "page", "_row", F.col("_p.at").alias("at"), _blanks(F.col("_p.text")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("_row", "at", "page_seq", "page", "text")))
    grouped = own.groupBy("doc_id", "number").agg(F.filter(listed, lambda x: x["text"] != "").alias("_l"))
    before = F.transform("_l", lambda x, i: F.aggregate(F.slice("_l", 1, i), F.lit(0), lambda n, y: n + F.char_length(y["text"]) + 1))
    return grouped.select(
        "doc_id", "number", F.get("_l", F.lit(0))["page_seq"].alias("page_seq"), F.get("_l", F.lit(0))["page"].alias("page"),
        F.array_join(F.transform("_l", lambda x: x["text"]), " ").alias("text"),
        F.zip_with(before, F.col("_l"), lambda b, x: F.struct(b.alias("begins"), x["page"].alias("page"))).alias("places"),
    )


def place_of(places: Column, at: Column) -> Column:
    """The page that holds an offset of an article's text."""
    return F.try_element_at(F.filter(places, lambda x: x["begins"] <= at), F.lit(-1))["page"]


@dataclass(frozen=True)
class ArticleRule:
    """Which articles may give a field, and which of their sentences do.

    ``title``, ``start`` and ``body``: one of the words stands in the folded heading, the
    folded first 420 characters, the folded text. ``unless``: not with these words in the
    heading, but for one of ``still``. ``sentences``: for each group the first sentence with
    its first word that any sentence has; the sentences of all groups are joined.
    ``shown``: a pattern that the folded sentence must match; ``most``: characters of a sentence.
    """

    field: str
    sentences: tuple[tuple[str, ...], ...] = ()
    title: tuple[str, ...] = ()
    start: tuple[str, ...] = ()
    body: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    still: tuple[str, ...] = ()
    shown: str = ""
    most: int = 650


#: The words by which an article is told and its sentences are chosen.
ARTICLE_RULES = [
    ArticleRule("validity", (("valables", "engag", "lies"),), title=("validite", "valables"), unless=("caution", "garantie", "execution", "marche", "contrat", "bancaire"), still=("offre", "soumission")),
    ArticleRule("caution", (("montant de la caution provisoire", "caution provisoire", "cautionnement provisoire"),), body=("caution provisoire", "cautionnement provisoire", "garantie de soumission")),
    ArticleRule("definitive_caution", (("caution definitive", "cautionnement definitif", "montant de la caution"),), body=("caution definitive", "cautionnement definitif")),
    ArticleRule("guarantee", (("delai de garantie", "periode de garantie", "duree de garantie"),), title=("garantie",), shown=r"\d+ ?(?:\([^)]*\) ?)?(?:jours?|mois|ans?|heures?)\b|garantie est fixe"),
    ArticleRule("reception", (("reception provisoire",), ("reception definitive",), ("reception est prononcee",), ("proces-verbal",)), title=("reception",), unless=("reception de la soumission",), most=950),
    ArticleRule("penalties", (("penalite",), ("cinq pour cent", "5 %")), start=("penalite", "retard"), most=950),
]
SUBJECT_REFUSED = ["fixent les procedures", "procedures de l'appel d'offres", "stipulent les conditions du marche"]
TITLE_END = r"(?iU)^(.{12}.*?)\b(?:La|Le|Les|L['’]|Chaque|Pour|Dans|Au|TSB|T\.S\.B)\b.*$"
SUBJECT_HEAD = r"(?iU)^.*?\bOBJET(?:\s+(?:DU|DE\s+LA|DE\s+L['’])\s+(?:MARCH[EÉ]|CONSULTATION|CAHIER\s+DES\s+CHARGES))?\b\s*[:\-]?"
SUBJECT_PURPOSE = r"(?iU)^.*?\b((?:le\s+pr[eé]sent\s+(?:march[eé]|appel\s+d['’]offres?)|la\s+pr[eé]sente\s+consultation)\s+a\s+pour\s+objet\b)"
LONG_DATE = r"(?iU)\b\d{1,2}\s+(?:janvier|f[eé]vrier|mars|avril|mai|juin|juillet|ao[uû]t|septembre|octobre|novembre|d[eé]cembre)\s+\d{4}(?:\s*(?:a|à)\s*\d{1,2}\s*h(?:\s*\d{2})?)?\b"
SHORT_DATE = r"(?iU)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})(?:\s*(?:a|à)\s*\d{1,2}\s*h(?:\s*\d{2})?)?\b"
ARRIVAL = r"(?iU)(\b(?:(?:les\s+)?(?:offres|soumissions)\s+doivent\s+parvenir)\b.*?)(?:\(\s*La\s+date\s+limite|\bLa\s+date\s+limite|$)"
PAYMENT_HEAD = r"(?iU)^\s*\|?\s*(?:(?:CONDITIONS|MODALIT[EÉ]S?)\s+)?(?:DE\s+)?PAIEMENT\s+"
ARTICLE_HEAD = r"(?iU)^\s*ARTICLE\s+\d+\s*[.:|\-]?\s*"


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(True)


def _sentence(pairs: Column, words: tuple[str, ...], most: int) -> Column:
    """Of (plain, folded) sentences the first with the first of the words that any has; null without one."""
    first = lambda w: F.get(F.filter(pairs, lambda x: F.contains(x["folded"], F.lit(w))), F.lit(0))["plain"]
    return F.left(F.coalesce(*[first(w) for w in words]), F.lit(most))


def _trimmed(text: Column) -> Column:
    return F.nullif(F.trim(text, F.lit(" .;:-")), F.lit(""))


def _ruled(rule: ArticleRule, a: dict[str, Column]) -> tuple[Column, Column]:
    """(text, what is looked up for its page) of a rule for an article; null where it gives nothing.

    Both are made only for articles that fit: most rules fit one article of a document.
    """
    fits = _any(a["title"], rule.title) & _any(a["start"], rule.start) & _any(a["folded"], rule.body)
    if rule.unless:
        fits = fits & (~_any(a["title"], rule.unless) | (_any(a["title"], rule.still) if rule.still else F.lit(False)))
    parts = [_sentence(a["sentences"], group, rule.most) for group in rule.sentences]
    text = _trimmed(F.concat_ws(" ", *[F.trim(p, F.lit(" .;:-")) for p in parts]))
    if rule.shown:
        text = F.when(T.fold(text).rlike(rule.shown), text)
    looked = F.coalesce(*parts)
    if rule.field == "validity":
        cut = text
        for start in ("offres", "soumissionnaires", "candidats"):
            cut = F.regexp_replace(cut, rf"(?iU)^.*?\bLes\s+{start}\b", f"Les {start}")
        text = cut
    if rule.field == "definitive_caution":
        text = F.when(F.contains(T.fold(text), F.lit("definit")), text).otherwise(F.concat(F.lit("Cautionnement definitif : "), text))
    return F.when(fits, text), F.when(fits, looked)


def _subject(a: dict[str, Column]) -> tuple[Column, Column]:
    about = F.contains(a["start"], F.lit("objet"))
    body = F.regexp_replace(F.when(about, a["text"]), SUBJECT_HEAD, "")
    body = F.trim(F.regexp_replace(body, SUBJECT_PURPOSE, "$1"), F.lit(" .;:-"))

    def value(own: Column) -> Column:
        parts = F.filter(F.transform(F.split(own, r"(?<=[.!?])\s+"), lambda x: F.trim(x, F.lit(" .;:-"))), lambda x: x != "")
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        out = F.when(F.startswith(T.fold(second), F.lit("a cet effet")), F.concat(first, F.lit(". "), second)).otherwise(first)
        lots = F.contains(T.fold(out), F.lit("lot a")) & F.contains(T.fold(own), F.lit("lot b"))
        whole = F.regexp_replace(own, r"(?iU)^(.{80}.*?)\b(?:Le\s+soumissionnaire|Les\s+soumissionnaires|La\s+participation|ARTICLE)\b.*$", "$1")
        return _trimmed(F.when(lots, whole).otherwise(out))

    text = T.let(body, value)
    fine = about & ~_any(T.fold(text), SUBJECT_REFUSED)
    return F.when(fine, text), F.when(about, text)


def _deadline(a: dict[str, Column]) -> tuple[Column, Column]:
    title = a["title"]
    fits = _any(title, ["date limite", "remise des offres"]) & (~F.contains(title, F.lit("validite")) | _any(title, ["date limite de reception", "date limite de remise"]))
    date = F.coalesce(*[F.nullif(F.regexp_extract(a["text"], p, 0), F.lit("")) for p in (LONG_DATE, SHORT_DATE)])
    sentence = _trimmed(_sentence(a["sentences"], ("date limite",), 650))
    text = F.coalesce(_trimmed(date), F.when(F.char_length(sentence) > 12, sentence))
    return F.when(fits, text), F.when(fits, text)


def _arrival(a: dict[str, Column]) -> tuple[Column, Column]:
    fits = _any(a["start"], ["date limite", "presentation", "reception de la soumission"])
    text = _trimmed(F.left(F.regexp_extract(a["text"], ARRIVAL, 1), F.lit(650)))
    return F.when(fits, text), F.when(fits, text)


def article_facts(pages: DataFrame, marker: str = MARKER, rules: list[ArticleRule] | None = None) -> DataFrame:
    """(doc_id, field, text, page, found_on): for each field the first article that gives it.

    ``page`` is where the article begins, ``found_on`` where the text stands. Payment is
    made of all articles about it, in order.
    """
    own = sections(pages, marker)
    folded = T.fold(F.col("text"))
    title = T.fold(F.regexp_replace(F.left("text", F.lit(320)), TITLE_END, "$1"))
    cut = F.transform(F.split(F.col("text"), r"(?<=[.!?])\s+"), lambda x: F.struct(x.alias("plain"), T.fold(x).alias("folded")))
    read = own.withColumns({"_f": folded, "_t": title, "_s": cut}).withColumn("_h", T.fold(F.left("text", F.lit(420))))
    a = {"text": F.col("text"), "folded": F.col("_f"), "title": F.col("_t"), "sentences": F.col("_s"), "start": F.col("_h")}
    made = {"subject": _subject(a), "deadline": _deadline(a), "submission_method": _arrival(a), **{r.field: _ruled(r, a) for r in rules or ARTICLE_RULES}}
    tried = F.array(*[F.struct(F.lit(f).alias("field"), x.alias("text"), look.alias("look")) for f, (x, look) in made.items()])
    found = read.select("doc_id", "number", "page", "places", F.col("text").alias("_x"), F.inline(F.filter(tried, lambda x: x["text"].isNotNull())))
    at = F.greatest(F.instr(F.col("_x"), F.col("look")) - 1, F.lit(0))
    one = found.select("doc_id", "field", "number", F.struct("text", "page", place_of(F.col("places"), at).alias("found_on")).alias("fact"))
    first = one.groupBy("doc_id", "field").agg(F.min_by("fact", "number").alias("_b")).select("doc_id", "field", "_b.*")
    return first.unionByName(_payment(read))


def _payment(read: DataFrame) -> DataFrame:
    about = read.where(_any(F.col("_h"), ["conditions de paiement", "modalites de paiement"]))
    body = _trimmed(F.left(F.regexp_replace(F.regexp_replace("text", ARTICLE_HEAD, ""), PAYMENT_HEAD, ""), F.lit(650)))
    parts = about.select("doc_id", "number", "page", "places", F.col("text").alias("_x"), body.alias("body")).where("body is not null")
    at = F.greatest(F.instr(F.col("_x"), F.col("body")) - 1, F.lit(0))
    listed = F.array_sort(F.collect_list(F.struct("number", "page", place_of(F.col("places"), at).alias("found_on"), "body")))
    grouped = parts.groupBy("doc_id").agg(listed.alias("_l"))
    return grouped.select(
        "doc_id", F.lit("payment").alias("field"), F.array_join(F.transform("_l", lambda x: x["body"]), " ").alias("text"),
        F.get("_l", F.lit(0))["page"].alias("page"), F.get("_l", F.lit(0))["found_on"].alias("found_on"),
    )
