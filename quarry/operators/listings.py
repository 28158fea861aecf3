"""Lists and windows of Arabic documents: items between an opening and a closing mark, over pages in order; table cells; text around marks.

Which page opens a list and which closes it is settled by one row of two marks for each
page and rule; then only the pages between are read for items. No text of a document is
joined, and of each page no more items than a list may have are sent on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import fact_text

#: Fewest characters of an item.
LEAST = 8


@dataclass(frozen=True)
class Listing:
    """Items of a field between the patterns ``open`` and ``close``.

    ``way``: how items are told: ``lines`` (each line, over the pages up to the closing one),
    ``bullets`` (each line of one page), ``dashes`` (parts between dashes of one page) or
    ``table`` (the cell behind a number, on a page that holds ``open``; ``OFFER_WORDS`` say
    whose it is). ``most``: items at most, ``least``: with fewer the rule gives none.
    """

    field: str
    open: str
    close: str = ""
    way: str = "lines"
    most: int = 12
    least: int = 1


@dataclass(frozen=True)
class Around:
    """A text from ``before`` characters before the first of ``marks`` that a page holds to ``after`` behind its start; of each group in ``shown`` it has one."""

    field: str
    marks: tuple[str, ...]
    before: int = 80
    after: int = 520
    most: int = 700
    shown: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class Between:
    """A page's text from ``open`` on up to ``close``, with one of ``shown`` in it."""

    field: str
    open: str
    close: str
    most: int = 900
    shown: tuple[str, ...] = ()


@dataclass(frozen=True)
class Matching:
    """Group 1 of ``pattern`` on a page's text with single blanks."""

    field: str
    pattern: str
    most: int = 900


# The words and patterns by which lists and facts are told.

#: Whose a table's item is: the first field with one of its words.
OFFER_WORDS = {
    "financial_documents": ["وثيقة التعهد", "العرض المالي", "جداول الأثمان", "جدول الأثمان", "الأثمان الفردية", "الأثمان التفصيلية"],
    "technical_documents": [
        "جداول الخاصيات الفنية", "جدول الخاصيات الفنية", "الخاصيات الفنية", "الخصائص الفنية", "تعهد كتابي", "مواد أصلية", "الوثائق الفنية", "العلامة التجارية",
        "المطويات الفنية", "Prospectus",
    ],
    "administrative_documents": [
        "شروط طلب العروض", "كرّاس الشّروط", "كراس الشروط", "الضمان الوقتي", "شهادة في الانخراط", "الصناديق الإجتماعية", "الصناديق الاجتماعية", "الوضعية الجبائية",
        "السجل التجاري", "السجل الوطني", "تصريح على الشرف", "بطاقة إرشادات", "بطاقة الإرشادات",
    ],
}
OFFER_TABLE = r"الوثائق المكونة للعرض|الوثائق المكوّنة للعرض"
#: Lines with one of these are none of a list's items.
NO_ITEM = {
    "lines": ["الفصل", "وتتكون من", "وذلك وفقا", "يجب أن يتضمن", "يجب ان يتضمن"],
    "bullets": ["ترسل الظروف", "يعتمد ختم", "ويتكون العرض", "يتكون العرض"],
    "dashes": [],
}
#: Items that begin so are none.
NO_START = {"bullets": r"(?:الفصل|ملاحظة|Page|\[Page)\b", "dashes": r"(?:الفصل|هام)\b"}
#: What is written before an item.
BULLET = {
    "lines": [r"^[IVX]+\.\s*", r"^[\d٠-٩]+[.)،\-]?\s*"],
    "bullets": [r"^(?:[-–—•●▪*]+|[\d٠-٩]+[.)،:\-]+|[أابتثجحخدذرزسشصضطظعغفقكلمنهوي]\s*[-.)])\s*"],
    "dashes": [r"^[\d٠-٩]+[.)،\-]?\s*", r"^(?:يتضمن\s+الوثائق\s+التالية|الوثائق\s+التالية)\s*[:：]?\s*"],
}
#: An item between dashes ends before these.
DASH_ENDS = r"ملاحظة|كل الوثائق المذكورة|ويُرسل|ويرسل|أو يسلم"
NEXT_ARTICLE = (
    r"\s*الفصل\s+(?:\d+|[اأ]?[وا]ل|الثاني|الثالث|الرابع|الخامس|السادس|السابع|الثامن|التاسع|العاشر|الحادي\s+عشر|الثاني\s+عشر|"
    r"الثالث\s+عشر|الرابع\s+عشر|الخامس\s+عشر|السادس\s+عشر)\s*[:：]?"
)
WINDOW_END = r"\s+(?=(?:الفصل|لفصل)\s*\d+\s*:|[IVX]+\.\s|—+\s*Page|\[Page\s+\d+\])"

LISTINGS = [
    Listing("administrative_documents", OFFER_TABLE, way="table", most=1000, least=4),
    Listing("administrative_documents", r"يتضمن\s+(?:الطرف|الظرف)\s+الخارجي[\s\S]{0,180}?الوثائق\s+التالية\s*[:：]?", r"و?يتكون\s+العرض\s+الفني|الفصل\s*0?5\s*[:：]", "bullets", 10),
    Listing("administrative_documents", r"الوثائق\s+التي\s+ترسل\s+مباشرة\s+ل(?:لإدارة|لادارة)\s*[:：]?", r"كل\s+الوثائق\s+المذكورة|الفصل\s+\d+\s*[:：]|هام\s*[:：]?", "dashes", 5),
    Listing("administrative_documents", r"(?:I\.\s*)?الوثائق\s+الإدارية\s*وتتكون\s+من\s*[:：]?", r"(?:II\.\s*)?(?:ال)?وثائق\s+الخاصة\s+بالعرض\s+الفني"),
    Listing("technical_documents", OFFER_TABLE, way="table", most=1000, least=2),
    Listing("technical_documents", r"و?يتكون\s+العرض\s+الفني\s+من\s+الوثائق\s+التالية\s*[:：]?", r"يتكون\s+العرض\s+المالي|الفصل\s*0?5\s*[:：]", "bullets", 8),
    Listing("technical_documents", r"(?:\b1\s*-\s*)?العرض\s+الفني\s*[:：]?[\s\S]{0,120}?يتضمن\s+الوثائق\s+التالية\s*[:：]?", r"(?:\b2\s*-\s*)?العرض\s+المالي\s*[:：]?|الوثائق\s+التي\s+ترسل\s+مباشرة", "dashes"),
    Listing("technical_documents", r"(?:II\.\s*)?الوثائق\s+الخاصة\s+بالعرض\s+الفني\s*[:：]?", r"(?:III\.\s*)?(?:ال)?وثائق\s+الخاصة\s+بالعرض\s+المالي"),
    Listing("financial_documents", OFFER_TABLE, way="table", most=1000, least=2),
    Listing("financial_documents", r"يتكون\s+العرض\s+المالي\s+من\s+الوثائق\s+التالية\s*[:：]?", r"ترسل\s+الظروف|الفصل\s*0?5\s*[:：]", "bullets", 6),
    Listing("financial_documents", r"(?:\b2\s*-\s*)?العرض\s+المالي\s*[:：]?[\s\S]{0,120}?يتضمن\s+الوثائق\s+التالية\s*[:：]?", r"ملاحظة|الوثائق\s+التي\s+ترسل\s+مباشرة|الفصل\s+\d+\s*[:：]", "dashes", 6),
    Listing("financial_documents", r"(?:III\.\s*)?وثائق\s+الخاصة\s+بالعرض\s+المالي\s*[:：]?", r"الفصل\s+\d+\s*[:：]?\s*(?:الأثمان|فتح\s+العروض)"),
]

_MONTHS = "أفريل|ابريل|إبريل|أبريل|جانفي|فيفري|مارس|ماي|جوان|جويلية|أوت|سبتمبر|أكتوبر|نوفمبر|ديسمبر"
SCALARS = [
    Matching("deadline", rf"((?:أجل\s+أقصاه|[اآ]خر\s+أجل|التاريخ\s+ال[أا]قصى)[\s\S]{{0,220}}?(?:\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}})[\s\S]{{0,120}}?(?:الساعة[\s\S]{{0,35}}|منتصف[\s\S]{{0,25}}|صباحا|مساء|$))", 340),
    Matching("deadline", r"([آا]خر\s+أجل\s+لقبول\s+العروض[\s\S]{0,220}?(?:على\s+الساعة|الساعة)[\s\S]{0,100})", 340),
    Matching("deadline", r"(التاريخ\s+ال[أا]قصى[\s\S]{0,180}?لقبول\s+العروض[\s\S]{0,120})", 340),
    Between("validity", r"الفصل\s*0?6\s*[:：]?\s*صلاحي|صلاحي(?:ة|ته)\s+العروض|يتعهد\s+العارض", r"الفصل\s*0?7\s*[:：]", 520, ("90", "120", "يوما", "يوم")),
    Matching("validity", r"((?:يلتزم\s+العارض\s+بعرضه|صلوحية\s+العروض|يبقى\s+المتعهدون\s+ملتزمون\s+بما\s+قدموه\s+من\s+عروض)[\s\S]{0,260}?(?:مائة\s+وعشرين|تسعون|ستون|\(?\s*(?:90|60|120|33)\s*\)?)\s+يوما[\s\S]{0,180})", 360),
    Between("opening", r"(?:الفصل\s*0?8\s*[:：]?\s*)?فتح\s+الظروف", r"الفصل\s*0?9\s*[:：]", 620, ("جلسة", "علنية", "الساعة", "2017")),
    Around("opening", ("جلسة فتح العروض", "تنعقد جلسة فتح العروض", "تجتمع لجنة فتح العروض"), 100, 560, 620, (("فتح العروض",), ("نفس اليوم", "جلسة واحدة", "علنية"))),
    Around("opening", ("تنعقد جلسة فتح العروض", "لجنة فتح العروض", "فتح العروض"), 120, 540, 620, (("فتح العروض",), ("نفس اليوم", "جلسة واحدة", "علنية"))),
    Matching("opening", r"((?:يتم\s+)?فتح\s+العروض[\s\S]{0,220}?(?:على\s+)?الساعة[\s\S]{0,80})", 360),
    Between("caution", r"(?:الفصل\s*0?7\s*[:：]?\s*)?الضمان\s+الوقتي", r"الفصل\s*0?8\s*[:：]", 920, ("دينار", "500", "350", "400", "120")),
    Matching("caution", r"((?:وثيقة)?الضمان\s+المالي\s+الوقتي[\s\S]{0,260}?(?:مبلغ\s+قدره|قدرها|بمبلغ|بقيمة)[\s\S]{0,140}?دينارا?)", 520),
    Matching("caution", r"((?:عدم\s+تقديم\s+)?الضمان\s+المالي\s+الوقتي[\s\S]{0,260}?(?:إقصاء\s+العرض|قبول\s+العرض|صالحة|وثيقة\s+إدارية)[\s\S]{0,160})", 520),
    Matching("definitive_caution", r"((?:الضمان\s+المالي\s+النهائي|الضمان\s+النهائي|ضمان\s+نهائي|ضمانا\s+(?:ماليا\s+)?نهائيا)[\s\S]{0,260}?(?:903|3\s*96|\d{1,2}\s*%|عشرة\s+بالمائة|ثلاثة\s+بالمائة)[\s\S]{0,180})", 480),
    Around("definitive_caution", ("الضمان النهائي", "ضمان نهائي"), 100, 430, 560, (("3 96", "903", "3%", "10%", "ثلاثة بالمائة", "عشرة بالمائة"),)),
    Around("reception", ("الاستلام والتسليم", "وصل الاستلام", "استلام المواد"), 80, 520, 620, (("استلام",), ("وصل الاستلام", "Bon de livraison", "مطابقتها للمواصفات"))),
    Between("reception", r"الاستلام\s+الودي|ال[اإ]ستلام\s+الوقتي", r"الفصل\s+(?:\d+|[اأإآء-ي]+)", 760, ("الاستلام النهائي", "مدة الضمان", "محضر")),
    Around("reception", ("محضر الاستلام", "الاستلام النهائي", "الفصل 19", "تسليم المواد"), 220, 760, 820, (("محضر",), ("الاستلام النهائي", "استلام نهائي"))),
    Around("information_sheet", ("بطاقة الإرشادات",), 60, 160, 220),
    Matching("information_sheet", r"(بطاقة\s+إرشادات\s+عامة[\s\S]{0,120})", 180),
    Around("cnss", ("الضمان الإجتماعي", "الضمان الاجتماعي", "نظام للضمان", "الصناديق الإجتماعية", "الصناديق الاجتماعية"), 80, 180, 280),
    Around("fiscal_certificate", ("الوضعية الجبائية",), 80, 180, 280),
    Matching("fiscal_certificate", r"((?:شهادة|الوضعية)[\s\S]{0,160}?الجبائية[\s\S]{0,120})", 260),
    Around("rne", ("السجل الوطني للمؤسسات",), 60, 180, 260),
    Around("rne", ("السجل التجاري",), 60, 180, 260),
]


def _any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match; null without one."""
    # a split compiles its pattern for every text
    return F.when(_has(text, pattern), F.get(F.split(text, f"(?iU){pattern}", 2), F.lit(1)))


def _until(text: Column, pattern: str) -> Column:
    return F.get(F.split(text, f"(?iU){pattern}", 2), F.lit(0)) if pattern else text


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){pattern}") if pattern else F.lit(False)


def _cell(line: Column) -> Column:
    """The cell behind a number in one of the first two cells of a row; null for other lines."""
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.btrim(c, F.lit(" \t:-"))), lambda c: c != "")
    number = lambda c: F.coalesce(c, F.lit("")).rlike(r"^[\d٠-٩]{1,2}$")

    def pick(c: Column) -> Column:
        found = F.when(number(F.get(c, F.lit(0))), F.get(c, F.lit(1))).when(number(F.get(c, F.lit(1))), F.get(c, F.lit(2)))
        return F.when(~found.rlike(r"(?i)^(?:عدد|العدد|N[°o]|---)$"), found)

    return F.when(F.contains(line, F.lit("|")), T.let(cells, pick))


def _owner(item: Column) -> Column:
    out = F.lit(None).cast("string")
    for field, words in reversed(OFFER_WORDS.items()):
        out = F.when(_any(item, words), field).otherwise(out)
    return out


def _table_items(segment: Column) -> Column:
    """(text, owner) of the rows of a table."""
    told = F.filter(F.transform(F.split(segment, r"\r\n|\n|\r"), lambda x: fact_text(_cell(x))), lambda x: x.isNotNull() & (x != ""))
    return F.transform(told, lambda x: F.struct(x.alias("text"), _owner(x).alias("owner")))


def _owned(rows: Column, rule: Listing) -> Column:
    kept = F.transform(F.filter(rows, lambda x: x["owner"] == rule.field), lambda x: x["text"])
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, rule.most)


def _table_lists(segment: Column, rules: list[tuple[int, Listing]]) -> Column:
    """(rule, items) of each rule for one table."""
    return T.let(_table_items(segment), lambda rows: F.array(*[F.struct(F.lit(k).alias("rule"), _owned(rows, r).alias("items")) for k, r in rules]))


def items_of(segment: Column, rule: Listing) -> Column:
    """The items of a piece of text by the rule's way, at most ``rule.most``."""
    if rule.way == "table":
        return T.let(_table_items(segment), lambda rows: _owned(rows, rule))
    parts = F.split(F.regexp_replace(segment, r"(?U)\s+", " "), r"(?U)\s*-\s*") if rule.way == "dashes" else F.split(segment, r"\r\n|\n|\r")

    def plain(x: Column) -> Column:
        out = fact_text(x)
        for start in BULLET[rule.way]:
            out = F.regexp_replace(out, f"(?iU){start}", "")
        return T.strip(_until(out, DASH_ENDS) if rule.way == "dashes" else out)

    refused = lambda x: _any(x, NO_ITEM[rule.way]) | (_has(x, "^" + NO_START[rule.way]) if rule.way in NO_START else F.lit(False))
    kept = F.filter(F.transform(parts, plain), lambda x: (F.char_length(x) >= LEAST) & ~refused(x))
    return F.slice(F.coalesce(kept, F.array().cast("array<string>")), 1, rule.most)


def _own(pages: DataFrame) -> DataFrame:
    """One row for each page with Arabic; of pages with equal page_seq (ties) the least text."""
    some = pages.where(F.col("text").rlike(f"[{T.ARABIC_SCRIPT}]"))
    own = some.groupBy("doc_id", "page_seq").agg(F.min(F.struct("text", F.col("page").cast("string").alias("page"))).alias("_p")).select("doc_id", "page_seq", "_p.*")
    return own.withColumn("_m", T.arabic_matching(F.col("text")))


def _over_pages(own: DataFrame, rules: list[tuple[int, Listing]]) -> DataFrame:
    """(doc_id, page_seq, page, rule, items) of lists that run over pages.

    The first page that opens a list begins it; it ends on that page behind the opening,
    else on the next page that closes it, else with the document.
    """
    text = F.col("text")
    marks = F.array(*[
        F.struct(F.lit(k).alias("rule"), _has(text, r.open).alias("opens"), _has(_after(text, r.open), r.close).alias("ends"), _has(text, r.close).alias("closes")) for k, r in rules
    ])
    marked = own.select("doc_id", "page_seq", F.inline(F.filter(marks, lambda m: m["opens"] | m["closes"])))
    first = F.min(F.when(F.col("opens"), F.col("page_seq"))).over(Window.partitionBy("doc_id", "rule"))
    closing = ((F.col("page_seq") == F.col("first")) & F.col("ends")) | ((F.col("page_seq") > F.col("first")) & F.col("closes"))
    spans = marked.withColumn("first", first).where("first is not null").groupBy("doc_id", "rule", "first").agg(F.min(F.when(closing, F.col("page_seq"))).alias("last"))
    within = (F.col("page_seq") >= F.col("first")) & (F.col("page_seq") <= F.coalesce("last", "page_seq"))
    read = own.select("doc_id", "page_seq", "page", "text").join(spans, "doc_id").where(within)
    items = F.lit(None).cast("array<string>")
    for k, r in rules:
        begun = F.when(F.col("page_seq") == F.col("first"), _after(text, r.open)).otherwise(text)
        piece = F.when(F.col("page_seq") == F.col("last"), _until(begun, r.close)).otherwise(begun)
        items = F.when(F.col("rule") == k, items_of(piece, r)).otherwise(items)
    # by way of a generator, behind which no filter repeats the search for items
    return read.select("doc_id", "page_seq", "page", F.inline(F.array(F.struct("rule", items.alias("items")))))


def listings(pages: DataFrame, rules: list[Listing] | None = None) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, field, items, page), items as (text, page).

    Rules of a field are tried in order over the whole document; the first with at least
    its least number of items gives the field. A list on one page is taken from the first
    page with items. Items that are alike but for case and marks count once. Null and
    empty texts and pages without Arabic give nothing; of pages with equal page_seq the
    least text is read.
    """
    numbered = list(enumerate(LISTINGS if rules is None else rules))
    own = _own(pages)
    # the rows of a page's table are read once for all fields
    tables = {r.open: [(k, t) for k, t in numbered if t.way == "table" and t.open == r.open] for _, r in numbered if r.way == "table"}
    owned = [_table_lists(F.when(_has(F.col("_m"), pattern), F.col("_m")), same) for pattern, same in tables.items()]
    single = [F.struct(F.lit(k).alias("rule"), items_of(_until(_after(F.col("_m"), r.open), r.close), r).alias("items")) for k, r in numbered if r.way not in ("lines", "table")]
    over = [(k, r) for k, r in numbered if r.way == "lines"]
    empty = F.array().cast("array<struct<rule:int,items:array<string>>>")
    found = own.select("doc_id", "page_seq", "page", F.inline(F.concat(empty, F.array(*single), *owned) if single else F.concat(empty, *owned)))
    if over:
        found = found.unionByName(_over_pages(own, over))
    along = Window.partitionBy("doc_id", "rule").orderBy("page_seq")
    most, least, field = (F.array(*[F.lit(getattr(r, name)) for _, r in numbered])[F.col("rule")] for name in ("most", "least", "field"))
    first_only = ~F.col("rule").isin([k for k, _ in over])
    earlier = F.coalesce(F.sum(F.size("items")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = found.where(F.size("items") > 0).withColumns({"_n": F.row_number().over(along), "_before": earlier})
    kept = some.where(F.when(first_only, F.col("_n") == 1).otherwise(F.col("_before") < most))
    # at most ``most`` pages come together here, as each has an item
    lists = kept.groupBy("doc_id", "rule").agg(F.array_sort(F.collect_list(F.struct("page_seq", "page", "items"))).alias("_l"))
    told = F.flatten(F.transform("_l", lambda p: F.transform(p["items"], lambda x: F.struct(T.clean_item(x).alias("text"), p["page"].alias("page")))))
    once = T.let(F.filter(F.slice(told, 1, most), lambda x: x["text"] != ""), lambda own: T.let(
        F.transform(own, lambda x: T.fold(x["text"])), lambda keys: F.filter(own, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)))
    once = lists.select("doc_id", F.inline(F.array(F.struct("rule", once.alias("items"))))).where(F.size("items") >= least)
    best = once.select("doc_id", "rule", field.alias("field"), "items").groupBy("doc_id", "field").agg(F.min_by("items", "rule").alias("items"))
    return best.select("doc_id", "field", "items", F.get("items", F.lit(0))["page"].alias("page"))


def _told(compact: Column, rule: Around | Between | Matching) -> Column:
    """The rule's text on a page, empty without one."""
    if isinstance(rule, Matching):
        got = _until(F.regexp_extract(compact, f"(?iU){rule.pattern}", 1), NEXT_ARTICLE)
        return T.compact(T.arabic_percent(F.left(T.strip(got), F.lit(rule.most))))
    if isinstance(rule, Between):
        opened = F.regexp_extract(compact, f"(?iU)(?:{rule.open})[\\s\\S]*$", 0)
        head = F.regexp_extract(opened, f"(?iU)^(?:{rule.open})", 0)
        own = T.arabic_percent(T.strip(F.concat(head, _until(F.substring(opened, F.char_length(head) + 1, F.char_length(opened)), rule.close))))
        return T.let(own, lambda x: F.when(_any(x, rule.shown) if rule.shown else F.lit(True), T.compact(F.left(x, F.lit(rule.most)))).otherwise(""))
    at = F.coalesce(*[F.nullif(F.instr(compact, F.lit(m)), F.lit(0)) for m in rule.marks])
    start = F.greatest(at - rule.before, F.lit(1))
    piece = F.substring(compact, start, at + rule.after - start)
    own = T.compact(T.arabic_percent(T.compact(F.left(_until(T.compact(piece), WINDOW_END), F.lit(rule.most)))))

    def shown(x: Column) -> Column:
        good = x.isNotNull()
        for group in rule.shown:
            good = good & _any(x, group)
        return F.when(good, x).otherwise("")

    return T.let(own, shown)


def arabic_facts(pages: DataFrame, rules: list[Around | Between | Matching] | None = None) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, field, text, page): the first rule that tells a field, on the first page where it does.

    Cases as for ``listings``.
    """
    own = _own(pages).select("doc_id", "page_seq", "page", T.compact(F.col("_m")).alias("_c"))
    tried = F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(k).alias("rule"), _told(F.col("_c"), r).alias("text")) for k, r in enumerate(SCALARS if rules is None else rules)])
    found = own.select("doc_id", "page_seq", "page", F.inline(F.filter(tried, lambda x: x["text"] != "")))
    return found.groupBy("doc_id", "field").agg(F.min_by(F.struct("text", "page"), F.struct("rule", "page_seq")).alias("_b")).select("doc_id", "field", "_b.*")
