"""Items that a tender asks for: rows of tables, lines that begin with a quantity, and rows that broken lines have torn apart.

A page is read in one expression: its lines from the table's heading on, or, where the
lines do not tell, the text with single blanks behind each heading, so that line breaks
inside a row do not matter. Only the items found are shuffled, each under its own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .facts import fact_text

# Patterns of headings, units, rows and ends of a table of items.
UNIT = r"(?:utilisateurs?|users?|instances?|licen[cs]es?|postes?|unit[eé]s?|uc|pcs?|laptops?|ordinateurs?|[eé]crans?|serveurs?|jours?|j/h|ans?)"
_NAMES = r"(?:rubriques?|d[eé]signations?|libell[eé]|produits?|articles?|licen[cs]es?)"
_AMOUNTS = r"(?:quantit\S*|qte|qt[eé]|nombre)"
HEADING = rf"(?:{_NAMES}(?:\s+\S+){{0,10}}?\s+{_AMOUNTS}|{_AMOUNTS}(?:\s+\S+){{0,6}}?\s+{_NAMES})(?:(?:\s+\S+){{0,12}}?(?:support\s*id|id\s+support|id\s+de\s+licen[cs]e|r[eé]f[eé]rence))?"
STOP = r"\b(?:avec\s+nos\s+salutations|tunis\s+le|article\s+\d+|conditions?\s+de\s+paiement|modalit[eé]s?|p[eé]nalit[eé]s?|votre\s+offre\s+doit)\b"
_NAMED = r"[A-Z][A-Za-z0-9À-ÖØ-öø-ÿ&/().,+#'’\-\s]"
_NUMBER = r"\d+(?:[.,]\d+)?"
WITH_SUPPORT = rf"({_NAMED}{{2,140}}?)\s+({_NUMBER}\s*{UNIT})\b([\s\S]{{0,180}}?)(#[0-9]{{4,}})"
GENERIC = rf"({_NAMED}{{2,100}}?)\s+({_NUMBER}\s*{UNIT})\b"
QUANTITY_FIRST = rf"({_NUMBER})(?![A-Za-z])(?:\s*{UNIT})?\s+({_NAMED}{{2,180}}?)(?=(?:\s+{_NUMBER}(?![A-Za-z])(?:\s*{UNIT})?\s+[A-Z])|$)"
QUANTITY_LINE = rf"^({_NUMBER})(?:\s*{UNIT})?\s+(.+?)\s*$"
ROW_LINE = rf"^\s*(?:item|poste|n[°o])?\s*\d{{1,3}}\s+(.+)\s+(unit\S*|u|forfait|lot|licen[cs]es?|poste?s?|jours?|j/h|mois|ans?)\s+({_NUMBER})\s*$"
ROW_TEXT = rf"(?:^|\s)(?:item|poste|n[°o])?\s*\d{{1,3}}\s+([A-Z].{{3,180}}?)\s+(unit[eé]|u\b|forfait|lot|licen[cs]es?|poste?s?|jours?|j/h|mois|ans?)\s+({_NUMBER})\b"
#: A row's number has up to three digits, and more on a page whose rows have come near a thousand.
NUMBERS, LAST_NUMBERS, LONG_NUMBERS = r"\d{1,3}", r"99\d", r"\d+"
#: What every match of ROW_LINE or ROW_TEXT holds; pages without it, which one pass shows, have no rows.
HAS_ROW = r"\s(?:unit\S*|u|forfait|lot|licen[cs]es?|poste?s?|jours?|j/h|mois|ans?)\s+\d"
LICENCE_ID = r"\b(?=[A-Z0-9][A-Z0-9\-\s]{5,80}\d)(?:[A-Z0-9]{6,}|[A-Z0-9]{4,}(?:\s*-\s*[A-Z0-9]{2,})+)\b"
BEFORE_NAME = (
    r"^.*\b(?:rubriques?|d[eé]signations?|libell[eé]|produits?|articles?|licen[cs]es?|quantit\S*|qte|qt[eé]|nombre|support\s*id|id\s+support|id\s+de\s+licen[cs]e|r[eé]f[eé]rence)\b\s*"
)
#: What every match of GENERIC or WITH_SUPPORT holds, and of WITH_SUPPORT too. The patterns try each letter as the
#: beginning of a name and look from there for a unit, so they are tried only where these are found, which takes one pass.
HAS_UNIT, HAS_SUPPORT = rf"\s{_NUMBER}\s*{UNIT}\b", r"#[0-9]{4}"
#: A page without any of these has no items; a heading has one of each of the two groups.
PAGE_WORDS = ["licence", "license", "quantit", "qte", "support id", "id support", "designation", "libelle"]
ROW_NAMES, ROW_AMOUNTS = ["designation", "libelle", "article"], ["quantite", "qte", "unite"]
HEAD_AMOUNTS = ["quantite", "qte", "qt", "unit"]
LINE_NAMES = ["designation", "article", "produit"]
#: Without a heading a page with one of these is read as a whole.
LICENCE_WORDS = ["support id", "id support", "id de licence", "id licence", "licence"]
NO_NAME_STARTS = ["et versions", "versions ulterieures", "admin externes", "admin internes", "de ressources", "des ressources", "nombre de", "nombre des"]
NO_NAME_WORDS = [["windows server", "version"], ["annexe", "bordereau"], ["modele de bordereau"], ["ressources a proteger"]]
NO_NAMES = ["rubriques", "designation", "designations", "quantite", "support id", "id licence", "id de licence"]
#: Between the parts of a match; no part can hold it.
_MARK = "\u0001"
_ITEM = "struct<designation:string,quantity:string,licence_id:string,support_id:string,kind:int>"


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def designation(raw: Column) -> Column:
    """A name without the heading's words before it; empty if it is none."""
    return T.let(fact_text(raw), _designated)


def _designated(fact: Column) -> Column:
    """``designation`` of what ``fact_text`` has read."""
    def cleaned(own: Column) -> Column:
        return T.let(F.trim(F.regexp_replace(F.trim(F.regexp_replace(own, f"(?iU){BEFORE_NAME}", ""), F.lit(" .;:-|")), r"(?U)\s+", " "), F.lit(" .;:-|")), lambda x: T.let(T.fold(x), lambda f: judge(own, x, f)))

    def judge(own: Column, x: Column, f: Column) -> Column:
        none = F.exists(F.array(*map(F.lit, NO_NAME_STARTS)), lambda w: F.startswith(f, w)) | (F.char_length(x) < 3) | f.isin(NO_NAMES)
        for words in NO_NAME_WORDS:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(f, F.lit(w))
            none = none | every
        return F.when(none, "").otherwise(x)

    return cleaned(fact)


def _kept_licence(raw: Column) -> Column:
    """The designation of a table's row, where a name that begins with the word licence keeps it."""
    return T.let(fact_text(raw), lambda r: T.let(_designated(r), lambda d: F.when(F.startswith(T.fold(r), F.lit("licence ")) & ~F.startswith(T.fold(d), F.lit("licence ")), r).otherwise(d)))


def _item(name: Column, quantity: Column, kind: int | Column, licence: Column | None = None, support: Column | None = None) -> Column:
    plain = lambda c: F.lit("") if c is None else F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s.;:\-|]+$|^[\s.;:\-|]+|\s+", "")
    return F.struct(name.alias("designation"), fact_text(quantity).alias("quantity"), plain(licence).alias("licence_id"), plain(support).alias("support_id"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"))


def _named(items: Column) -> Column:
    return F.filter(items, lambda x: x["designation"] != "")


def _first_of_name(items: Column) -> Column:
    """The first item of each folded designation, in their order; sorted by name, so that long tables take no square of their rows."""
    keyed = lambda own: F.array_sort(F.transform(own, lambda x, i: F.struct(T.fold(x["designation"]).alias("key"), i.alias("i"))))
    firsts = lambda own: T.let(keyed(own), lambda k: F.array_sort(F.transform(F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["key"] != x["key"])), lambda x: x["i"])))
    return T.let(items, lambda own: F.transform(firsts(own), lambda i: F.get(own, i)))


def _all(text: Column, pattern: str | Column, *groups: int) -> Column:
    own = F.lit(f"(?iU){pattern}") if isinstance(pattern, str) else pattern
    parts = [F.regexp_extract_all(text, own, F.lit(g)).alias(f"g{g}") for g in groups]
    return F.arrays_zip(*parts)


def _after_head(lines: Column) -> Column:
    """The lines behind the first that is a heading; none without."""
    head = lambda own: F.array_position(F.transform(own, lambda x: x["head"]), True)
    return T.let(lines, lambda own: T.let(head(own), lambda h: F.when(h > 0, F.slice(own, h.cast("int") + 1, F.size(own))).otherwise(F.slice(own, 1, 0))))


def table_rows(text: Column) -> Column:
    """Items of numbered rows (number, name, unit, quantity) below a heading; where no line is a row, rows of the text with single blanks."""
    lines = F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: T.strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    marked = F.transform(lines, lambda x: T.let(T.fold(x), lambda f: F.struct(x.alias("line"), (_any(f, ROW_NAMES) & _any(f, HEAD_AMOUNTS)).alias("head"), F.startswith(f, F.lit("page ")).alias("page"))))

    numbered = lambda pattern, numbers: "(?iU)" + pattern.replace(NUMBERS, numbers)
    row = lambda name, unit, quantity: _item(_kept_licence(name), F.concat(fact_text(quantity), F.lit(" "), fact_text(unit)), 1)

    def below(after: Column) -> Column:
        is_row = lambda x, numbers: x["line"].rlike(numbered(ROW_LINE, numbers))
        part = lambda x, g: F.regexp_extract(x["line"], numbered(ROW_LINE, LONG_NUMBERS), g)
        many = F.exists(after, lambda x: is_row(x, LAST_NUMBERS))
        rows = T.let(many, lambda m: F.filter(after, lambda x: ~x["head"] & ~x["page"] & (is_row(x, NUMBERS) | (m & is_row(x, LONG_NUMBERS)))))
        return F.transform(rows, lambda x: row(part(x, 1), part(x, 2), part(x, 3)))

    def torn(own: Column) -> Column:
        pattern = F.when(own.rlike(numbered(ROW_TEXT, LAST_NUMBERS)), numbered(ROW_TEXT, LONG_NUMBERS)).otherwise(numbered(ROW_TEXT, NUMBERS))
        return F.transform(_all(own, pattern, 1, 2, 3), lambda m: row(m["g1"], m["g2"], m["g3"]))

    compact, none = T.compact(text), F.array().cast(f"array<{_ITEM}>")
    told = T.let(_first_of_name(_named(T.let(_after_head(marked), below))), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(_first_of_name(_named(T.let(compact, torn)))))
    below_heading = T.let(T.fold(compact), lambda f: F.when(_any(f, ROW_NAMES) & _any(f, ROW_AMOUNTS), told).otherwise(none))
    return F.when(text.rlike(f"(?iU){HAS_ROW}"), below_heading).otherwise(none)


def quantity_lines(text: Column) -> Column:
    """Items of lines that begin with a quantity, below a heading and up to the table's end."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), fact_text), lambda x: x != "")
    marked = F.transform(lines, lambda x: T.let(T.fold(x), lambda f: F.struct(x.alias("line"), (F.contains(f, F.lit("quantit")) & _any(f, LINE_NAMES)).alias("head"), x.rlike(f"(?iU){STOP}").alias("stop"))))

    def below(own: Column) -> Column:
        return T.let(_after_head(own), lambda a: T.let(F.array_position(F.transform(a, lambda x: x["stop"]), True), lambda end: F.filter(a, lambda x, i: ((end == 0) | (i + 1 < end)) & x["line"].rlike(f"(?iU){QUANTITY_LINE}"))))

    part = lambda x, g: F.regexp_extract(x["line"], f"(?iU){QUANTITY_LINE}", g)
    return _named(F.transform(T.let(marked, below), lambda x: _item(_kept_licence(part(x, 2)), part(x, 1), 2)))


def windows(compact: Column, folded: Column) -> Column:
    """What follows each heading up to the table's end or else the page's; without headings a page about licences as a whole."""
    between, heads = F.split(compact, f"(?iU){HEADING}", -1), F.regexp_extract_all(compact, F.lit(f"(?iU){HEADING}"), F.lit(0))

    def ends(b: Column, h: Column) -> Column:
        upto = lambda i: F.aggregate(F.slice(b, 1, i + 1), F.lit(0), lambda n, x: n + F.char_length(x)) + F.aggregate(F.slice(h, 1, i + 1), F.lit(0), lambda n, x: n + F.char_length(x))
        return F.transform(h, lambda _, i: T.strip(F.substring(compact, upto(i) + 1, F.char_length(compact))))

    rests = T.let(between, lambda b: T.let(heads, lambda h: ends(b, h)))
    cut = F.transform(F.filter(rests, lambda x: x != ""), lambda x: F.get(F.split(x, f"(?iU){STOP}", 2), F.lit(0)))
    return T.let(cut, lambda own: F.when((F.size(own) == 0) & _any(folded, LICENCE_WORDS), F.array(compact)).otherwise(own))


def _window_matches(window: Column, quantity_first: Column) -> Column:
    """What the patterns find in a window, as texts: kind, name, quantity, licence and support, with ``_MARK`` between."""
    none = F.array().cast("array<string>")
    match = lambda kind, name, quantity, licence=F.lit(""), support=F.lit(""): F.concat_ws(_MARK, F.lit(str(kind)), name, quantity, licence, support)

    def matches(unit: Column) -> Column:
        support = F.transform(_all(window, WITH_SUPPORT, 1, 2, 3, 4), lambda m: match(3, m["g1"], m["g2"], F.regexp_extract(m["g3"], LICENCE_ID, 0), m["g4"]))
        first = F.transform(_all(window, QUANTITY_FIRST, 1, 2), lambda m: match(4, m["g2"], m["g1"]))
        generic = F.transform(_all(window, GENERIC, 1, 2), lambda m: match(4, m["g1"], m["g2"]))
        others = lambda: F.concat(F.when(quantity_first, first).otherwise(none), F.when(unit, generic).otherwise(none))
        some = lambda s: F.exists(s, lambda m: designation(F.get(F.split(m, _MARK), F.lit(1))) != "")
        return T.let(F.when(unit & window.rlike(HAS_SUPPORT), support).otherwise(none), lambda s: F.when(some(s), s).otherwise(others()))

    return T.let(window.rlike(f"(?iU){HAS_UNIT}"), matches)


def _made(matches: Column) -> Column:
    """The items of ``_window_matches`` that have a name."""
    item = lambda p: _item(designation(p[1]), p[2], p[0].cast("int"), p[3], p[4])
    return _named(F.transform(matches, lambda m: T.let(F.split(m, _MARK), item)))


def _window_items(window: Column, quantity_first: Column) -> Column:
    return _made(_window_matches(window, quantity_first))


def _page_items(text: Column) -> Column:
    def torn(lines: Column) -> Column:
        own = T.let(T.compact(text), lambda compact: T.let(T.fold(compact), lambda folded: windows(compact, folded)))
        found = F.transform(own, lambda w: _window_matches(w, F.size(lines) == 0))
        # of headings without an end between them each window holds the next one's: what repeats is made once
        return F.concat(lines, _made(F.array_distinct(F.flatten(found))))

    return T.let(table_rows(text), lambda rows: F.when(F.size(rows) > 0, rows).otherwise(T.let(quantity_lines(text), torn)))


def requested_items(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_seq, page, text) -> (doc_id, number, item, designation, quantity, licence_id, support_id, page).

    A page with rows of a table gives these; else its lines with quantities, then what
    stands behind its headings whatever its line breaks: rows with a support id, or else
    rows that begin with a quantity (where no line told one) and rows that end with one.
    Of items that repeat, by their folded text or, behind headings, by their folded name,
    the first of the document stays. ``number`` counts from 1. Null and empty texts give
    nothing; pages with equal page_seq (ties) go by page, then text.
    """
    own = pages.select("doc_id", "page_seq", F.col("page").cast("string").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    some = own.where(_any(T.fold(F.col("text")), PAGE_WORDS))
    found = some.select("doc_id", "page_seq", "page", F.xxhash64("text").alias("_t"), F.posexplode(_page_items(F.col("text"))).alias("_i", "_x")).select("doc_id", "page_seq", "page", "_t", "_i", "_x.*")
    ids = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f", {label} "), F.col(c))).otherwise("")
    item = F.concat("designation", F.lit(" : "), "quantity", ids("ID licence", "licence_id"), ids("Support ID", "support_id"))
    keyed = found.withColumn("item", item).withColumn("_key", F.when(F.col("kind") >= 3, T.fold(F.col("designation"))).otherwise(T.fold(F.col("item"))))
    place = ["page_seq", "page", "_t", "_i"]
    first = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(*place))
    kept = keyed.withColumn("_n", first).where((F.col("_n") == 1) | (F.col("kind") == 3))
    again = F.row_number().over(Window.partitionBy("doc_id", T.fold(F.col("item"))).orderBy(*place))
    once = kept.withColumn("_n", again).where("_n = 1")
    return once.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*place)).alias("number"), "item", "designation", "quantity", "licence_id", "support_id", "page")


def mined_items(pages: DataFrame) -> DataFrame:
    """(doc_id, type, label, value, page): the rows of tables as mined facts, distinct by folded label and value, the first page wins."""
    own = pages.select("doc_id", "page_seq", F.col("page").cast("string").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    some = own.where(F.col("text").rlike(f"(?iU){HAS_ROW}")).where(_any(T.fold(F.col("text")), ["designation", "qte"]))
    found = some.select("doc_id", "page_seq", "page", F.posexplode(table_rows(F.col("text"))).alias("_i", "_x"))
    order = Window.partitionBy("doc_id", T.fold(F.col("_x.designation")), T.fold(F.col("_x.quantity"))).orderBy("page_seq", "page", "_i")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc_id", F.lit("requested_item").alias("type"), F.col("_x.designation").alias("label"), F.col("_x.quantity").alias("value"), "page")
