"""Values near their anchors: positions of all matches, and for each anchor the next value within a distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .articles import LONG_DATE, SHORT_DATE

#: Characters from an anchor within which a value has to end.
NEAR = 520
#: What announces the end of the time for offers, and what says so with its date.
ANCHOR = r"(?iU)\b(?:date\s+limite|remise\s+des\s+offres|r[eé]ception\s+des\s+offres|au\s+plus\s+tard)\b"
NAMED = r"(?iU)(?:dernier\s+d\S+lai\s+de\s+r\S+ception\s+des\s+offres|date\s+limite\s+(?:fix\S+e\s+pour\s+la\s+)?r\S+ception\s+des\s+offres)\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}(?:\s*-\s*\d{1,2}\s*h\s*\d{0,2})?)"
CLOSING = r"(?iU)(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\s*(?:[^\d\s]\s*|a\s*)?\d{1,2}\s*h\s*\d{0,2})[\s\S]{0,900}?(?:TUNEPS\s+sera\s+ferm\S+e\s+automatiquement|au\s+plus\s+tard\s+d\S+lai\s+rigueur)"
ARABIC = r"(?:آخر\s+أجل|اخر\s+اجل|لقبول\s+العروض|قبول\s+العروض|موعد)[\s\S]{0,160}?(\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
#: Where a text is cut before its anchors, and what begins with one.
BEFORE, STARTS = ANCHOR.replace(r"(?iU)", r"(?iU)(?=") + ")", ANCHOR.replace(r"(?iU)", r"(?iU)^")
#: More than the characters of any date in a text with single blanks.
MARGIN = 64
#: Both words after an anchor say that it is about questions, not offers; within so many characters.
QUESTIONS, QUESTION_CHARS = ("demande", "eclaircissement"), 220


def matches(rows: DataFrame, by: list[str], text: str, pattern: str) -> DataFrame:
    """(by, at, value) of every match in a row's text, ``at`` from 0. ``by`` has to tell the rows apart."""
    before, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = rows.where(F.col(text).rlike(pattern)).select(*by, F.posexplode(F.zip_with(before, found, lambda b, v: F.struct(b.alias("b"), v.alias("v")))).alias("_i", "_x"))
    each = each.where("_x.v is not null")
    along = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.char_length("_x.b") + F.char_length("_x.v")).over(along)
    return each.select(*by, (end - F.char_length("_x.v")).cast("long").alias("at"), F.col("_x.v").alias("value"))


def next_values(anchors: DataFrame, values: DataFrame, by: list[str], most: int = NEAR) -> DataFrame:
    """Anchors (by, at) with the next ``value`` that begins at or after them and ends within ``most`` characters; null without one.

    Anchors and values are sorted by position and each anchor looks ahead to the first
    value, so no anchor meets more than one of the values near it. Of values with equal
    positions (ties) the longer one is taken.
    """
    own = anchors.select(*by, "at", F.lit(None).cast("struct<at:bigint,value:string>").alias("_v"))
    both = own.unionByName(values.select(*by, "at", F.struct(F.col("at").cast("long").alias("at"), "value").alias("_v")))
    ahead = Window.partitionBy(*by).orderBy("at", F.char_length("_v.value").desc_nulls_first(), F.col("_v.value").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    seen = both.withColumn("_n", F.first("_v", ignorenulls=True).over(ahead)).where("_v is null")
    near = F.col("_n.at") + F.char_length("_n.value") <= F.col("at") + most
    return seen.select(*by, "at", F.when(near, F.col("_n.value")).alias("value"))


def _first_dated(text: Column, most: int) -> Column:
    """The date within ``most`` characters of the first anchor about offers that has one; null without one.

    What follows each anchor is read by itself, so the work grows with the text and its
    anchors. An anchor begins with a letter that no date holds there, so the next date is
    the first of what follows; ``MARGIN`` more characters show a date that goes on beyond.
    """
    def starts(parts: Column) -> Column:
        ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + F.char_length(x)))
        return F.filter(F.zip_with(ends, parts, lambda at, x: F.when(x.rlike(STARTS), at)), lambda at: at.isNotNull())

    def read(after: Column) -> Column:
        def date(pattern: str) -> Column:
            before = F.regexp_replace(after, pattern + r"[\s\S]*", "")
            return T.let(F.regexp_extract(after, pattern, 0), lambda v: F.when((v != "") & (F.char_length(before) + F.char_length(v) <= most), v))

        return F.when(_about_offers(after), F.coalesce(date(LONG_DATE), date(SHORT_DATE)))

    values = T.let(F.split(text, BEFORE), lambda parts: F.transform(starts(parts), lambda at: T.let(F.substring(text, at + 1, F.lit(most + MARGIN)), read)))
    return F.when(text.rlike(ANCHOR), F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0)))


def _about_offers(after: Column) -> Column:
    start = F.lower(T.fold(F.left(after, F.lit(QUESTION_CHARS))))
    return ~(F.contains(start, F.lit(QUESTIONS[0])) & F.contains(start, F.lit(QUESTIONS[1])))


def _stated(text: Column, pattern: str) -> Column:
    return F.nullif(T.compact(F.regexp_extract(text, pattern, 1)), F.lit(""))


def deadlines(pages: DataFrame, most: int = NEAR) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, text, page): the end of the time for offers, from the first page that tells it.

    On a page, a date that is named as such comes first, then the closing time of the
    portal, then the first anchor with a date within ``most`` characters (a long one before
    one in figures), then the Arabic wording. Anchors about questions are passed over. A
    date that the distance would cut is not taken.
    """
    by = ["doc_id", "page_seq", "page"]
    own = pages.select(*by, T.compact(F.coalesce("text", F.lit(""))).alias("text")).groupBy(*by).agg(F.min("text").alias("text"))
    text = T.compact(F.coalesce(_stated(F.col("text"), NAMED), _stated(F.col("text"), CLOSING), _first_dated(F.col("text"), most), _stated(F.col("text"), ARABIC)))
    # by way of a generator, behind which no filter repeats the search
    best = own.select("doc_id", "page_seq", "page", F.inline(F.array(F.struct(text.alias("text"))))).where(F.col("text").isNotNull())
    return best.groupBy("doc_id").agg(F.min_by(F.struct("text", "page"), "page_seq").alias("_b")).select("doc_id", "_b.*")
