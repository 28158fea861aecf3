"""Named queries with their SQL: kinds of questions, answers read off texts and facts, subjects, price rows, checklists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import answers, facts, questions, registry
from ..session import spread, table
from .engine import analysed_documents
from .queries import ME, REGISTRY, SEEN, registry_of
from .registry import register


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list[str], pad: str = "") -> str:
    return "[" + ", ".join(_text(pad + v + pad) for v in values) + "]"


def _any(normal: str, words: list[str]) -> str:
    return f"(len(list_filter({_list(words, ' ')}, lambda m: contains(' ' || {normal} || ' ', m))) > 0)"


def _some(value: str, words: list[str]) -> str:
    return f"(len(list_filter({_list(words)}, lambda m: contains({value}, m))) > 0)"


def _normal(value: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower({value})), '[^\w\s'']', ' ', 'g'), '\s+', ' ', 'g'))"


_ASKED = ["Quel est l'objet ?", "What is the closing date?", "Résumé, s'il vous plaît", "Quelle société est-ce ?", "who exactly are you", "c'est quoi", ""]


@register("question_kinds", f"""
WITH n AS (SELECT conv_id, turn, {_normal(f"text || ' ' || {_list(_ASKED)}[turn % {len(_ASKED)} + 1]")} AS n FROM conversations)
SELECT conv_id, turn, {", ".join(f"{_any('n', words)} AS {kind}" for kind, words in rules.QUESTION_KINDS.items() if kind not in ("organization", "assistant"))},
  {_any("n", rules.QUESTION_KINDS["organization"])} OR ({_any("n", rules.ORGANIZATION_WORDS)} AND {_any("n", rules.ORGANIZATION_SHAPES)}) AS organization,
  {_any("n", rules.QUESTION_KINDS["assistant"])} OR ({" AND ".join(_any("n", words) for words in rules.ASSISTANT_WORDS)}) AS assistant FROM n""")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with a question put behind it."""
    own = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("turn") % len(_ASKED) + 1).cast("int"))
    flags = questions.kind_flags(F.concat("text", F.lit(" "), own))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[flag.alias(kind) for kind, flag in flags.items()])


def _heads(kind: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(t, {_text('(?is)' + h + '(.+?)' + rules.ANSWER_STOP)}, 1), ' .;:-'), '')" for h in rules.DIRECT_HEADS[kind]) + ")"


@register("direct_answers", rf"""
WITH t AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, '') || ' Objet : offre de ' || source || '. 7 Date limite : le ' || (doc_id % 28 + 1) || ' mars. 8 fin', '\s+', ' ', 'g')) AS t FROM documents WHERE doc_id % 3 < 2)
SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 0 THEN {_heads("subject")} ELSE {_heads("deadline")} END || chr(10) || 'Source: ' || source || ', page 2.' AS answer FROM t""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each document's subject or deadline, or one that no rule answers."""
    docs = table(spark, sf_dir, "documents").withColumn("query_id", F.col("doc_id"))
    asked = docs.select("query_id", F.element_at(F.array(*map(F.lit, ["Quel est l'objet ?", "What is the deadline?", "Combien de pages ?"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("question"))
    stated = F.concat(F.coalesce("text", F.lit("")), F.lit(" Objet : offre de "), "source", F.lit(". 7 Date limite : le "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(" mars. 8 fin"))
    first = docs.select("query_id", F.lit(0).alias("rank"), F.lit("rien").alias("text"), "source", F.lit("1").alias("page"))
    return questions.direct_answers(asked, first.unionByName(docs.select("query_id", F.lit(1).alias("rank"), stated.alias("text"), "source", F.lit("2").alias("page"))))


@register("summary_answers", rf"""
WITH w AS (SELECT conv_id || '-' || turn AS query_id, role, turn, trim(regexp_replace(translate(text, '•-', '  '), '\s+', ' ', 'g')) AS w FROM conversations),
s AS (SELECT *, list_transform(list_filter(string_split(regexp_replace(w, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 20)[1:2], lambda x: trim(x, ' .;:-')) AS s FROM w),
n AS (SELECT *, {_normal("s[1]")} AS a, {_normal("s[2]")} AS b FROM s),
p AS (SELECT query_id, CASE WHEN turn % 3 = 0 THEN 'Consultation pour ' || role || ' et services' WHEN turn % 3 = 1 THEN 'Elements cites : alpha ' || role || ', beta' ELSE
  CASE WHEN len(s) = 0 THEN '' WHEN len(s) = 1 OR contains(a, b) OR contains(b, a) THEN s[1] ELSE s[1] || ' ' || s[2] END END AS answer FROM n)
SELECT query_id, answer FROM p WHERE answer <> ''""")
def summary_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn summed up: by what follows a head, by listed items, or by its first sentences."""
    plain = F.translate("text", "•-", "  ")
    text = F.when(F.col("turn") % 3 == 0, F.concat(plain, F.lit(" Consultation pour "), "role", F.lit(" et services. 7 fin"))).when(F.col("turn") % 3 == 1, F.concat(plain, F.lit(" • alpha "), "role", F.lit(" • beta • xy"))).otherwise(plain)
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), text.alias("text"))
    chunks = turns.withColumns({"rank": F.lit(0), "source": F.lit(None).cast("string"), "page": F.lit(None).cast("string")})
    return questions.summary_answers(turns.select("query_id", F.lit("Give me an overview").alias("question")), chunks)


@register("fact_summaries", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'resume ' || doc_id || chr(10) || 'Source: ' || source || ', page 1.'
  WHEN doc_id % 3 = 0 THEN 'Date limite : le ' || doc_id || '.' || chr(10) || 'Source: ' || source || ', page 3.'
  ELSE 'objet ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' Date limite : le ' || doc_id || '.' ELSE '' END || chr(10) || 'Source: ' || source || ', page 2.' END AS answer
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def fact_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries from facts: documents have a stored one, a subject, a deadline, some of them or none."""
    i = F.col("doc_id")
    fact = lambda have, field, word, page: F.when(have, F.struct(F.lit(field).alias("field"), F.concat(F.lit(word), i, F.lit(" ;")).alias("text"), F.lit(page).alias("page")))
    known = F.array_compact(F.array(fact(i % 5 == 0, "summary", "resume ", "1"), fact(i % 3 != 0, "subject", "objet ", "2"), fact(i % 2 == 0, "deadline", "le ", "3")))
    return questions.fact_summaries(table(spark, sf_dir, "documents").select("doc_id", "source", F.inline(known)))


_STARTS = ["Le present appel a pour objet ", "Sommaire ", "Consultation pour ", "ARTICLE 1 ARTICLE 2 article 3 ", "Annexe 4 ", "Objet "]


def _weights() -> str:
    parts = [f"CASE WHEN {' AND '.join(f'contains({form}, {_text(w)})' for w in words)} THEN {weight} ELSE 0 END" for form, signs in (("low", rules.SUBJECT_SIGNS), ("f", rules.SUBJECT_FOLDED_SIGNS)) for weight, words in signs]
    return " + ".join([*parts, f"CASE WHEN {_some('f', rules.SUBJECT_TENDER)} THEN 80 ELSE 0 END", r"CASE WHEN regexp_matches(t, '\d') THEN 30 ELSE 0 END"])


@register("subject_scores", rf"""
WITH t AS (SELECT conv_id, turn, {_list(_STARTS)}[turn % 6 + 1] || text AS t FROM conversations),
f AS (SELECT *, lower(replace(t, '’', '''')) AS low, trim(regexp_replace(regexp_replace(strip_accents(lower(t)), '[`’]', '''', 'g'), '\s+', ' ', 'g')) AS f FROM t),
w AS (SELECT *, {_weights()} AS w FROM f),
s AS (SELECT *, w + CASE WHEN turn <= 3 AND w < 50 AND contains(f, 'objet') THEN 60 ELSE 0 END + CASE WHEN length(t) < 25 THEN -40 ELSE 0 END
  + CASE WHEN {_some("low", rules.SUBJECT_REFUSED)} THEN -160 ELSE 0 END + CASE WHEN {_some("f", rules.SUBJECT_CONTENTS)} THEN -260 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(t, '(?i)\bARTICLE\s*\d+\b')) >= 3 THEN -300 ELSE 0 END
  + CASE WHEN regexp_matches(f, '^\s*annexe\s+(?:n[°o]\s*)?\d+') OR contains(f, 'modele de soumission') OR contains(f, 'formulaire de reponse') THEN -180 ELSE 0 END
  + CASE WHEN regexp_matches(t, '\.{{2,}}\s*,?\s*\d+\s*=') THEN -220 ELSE 0 END
  + CASE WHEN (len(regexp_extract_all(t, ', 1 =')) >= 2 OR contains(f, 'composition du marche')) AND NOT contains(f, 'a pour objet') THEN -260 ELSE 0 END AS s FROM w)
SELECT conv_id AS doc_id, max(s)::INTEGER AS explicit, sha256(arg_min(t, struct_pack(a := -s, b := turn % 4 - 20, c := -least(length(t), 240), d := turn, e := t))) AS digest FROM s GROUP BY conv_id""")
def subject_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate for the subject among a conversation's turns, with a start that speaks for or against each."""
    text = F.concat(F.element_at(F.array(*map(F.lit, _STARTS)), (F.col("turn") % 6 + 1).cast("int")), "text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), text.alias("text"), F.col("turn").cast("string").alias("page"), (F.col("turn") % 4).alias("pattern"))
    return facts.best_subject(rows).select("doc_id", "score.explicit", F.sha2("text", 256).alias("digest"))


@register("pricing_items", """
SELECT p_partkey AS doc_id, 'pricing_item' AS type, 'Lot ' || (p_partkey % 4 + 1) || ' item ' || k AS label, CASE k WHEN 1 THEN p_name ELSE 'Papier A4' END || ' - Unite ' || p_size || CASE k WHEN 1 THEN '' ELSE ',5' END AS value
FROM part, (VALUES (1), (2)) v(k)""")
def pricing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price schedule for each part, one of its rows on two pages."""
    parts = spread(table(spark, sf_dir, "part"))
    size, lot = F.col("p_size").cast("string"), (F.col("p_partkey") % 4 + 1).cast("string")
    head = F.concat(F.lit("BORDEREAU DES PRIX\nLOT "), lot, F.lit(": Item Designation Qte\n1 "), "p_name", F.lit(" Unité "), size)
    pages = F.array(F.struct(F.lit(1).alias("page_seq"), F.concat(head, F.lit("\n2 Papier  A4\nUnite "), size, F.lit(",5")).alias("text")), F.struct(F.lit(2).alias("page_seq"), head.alias("text")), F.struct(F.lit(3).alias("page_seq"), F.lit("7 Autre chose Unite 8").alias("text")))
    return facts.pricing_items(parts.select(F.col("p_partkey").alias("doc_id"), F.inline(pages)).withColumn("page", F.col("page_seq").cast("string"))).select("doc_id", "type", "label", "value")


_LINES = " || chr(10) || ".join(
    f"'{k + 1}. ' || {_text(q)} || ': ' || " + {"subject": "source", "payment": f"CASE WHEN doc_id % 2 = 0 THEN 'par lot ' || doc_id ELSE {_text(answers.NOT_FOUND['fr'])} END"}.get(field, _text(answers.NOT_FOUND["fr"]))
    for k, (q, field, _) in enumerate(rules.CHECKLIST)
)


def _checklist_facts(docs: DataFrame) -> DataFrame:
    own = F.struct(F.lit("subject").alias("field"), F.col("source").alias("text"))
    paid = F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("payment").alias("field"), F.concat(F.lit("par lot "), "doc_id").alias("text")))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.inline(F.array_compact(F.array(own, paid))))


@register("full_checklist", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256({_LINES}) AS digest FROM documents")
def full_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return answers.full_checklist(_checklist_facts(docs), docs.select(F.col("doc_id").cast("string").alias("doc_id"))).select("doc_id", F.sha2("checklist", 256).alias("digest"))


@register("analysis_audit", f"""
WITH {REGISTRY} SELECT 'user3' AS user_id, 'analyze_document' AS action, filename AS resource, 'dept1' AS department_id, '{{"analysis_type":"tender_checklist"}}' AS metadata FROM registry WHERE {SEEN}""")
def analysis_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit rows of a checklist asked for all documents that the user sees."""
    docs = table(spark, sf_dir, "documents")
    _, audit = analysed_documents(registry_of(docs), _checklist_facts(docs), ME, "tender_checklist", F.timestamp_seconds(F.lit(0)))
    return audit.drop("created_at")


@register("short_receptions", rf"""
WITH v AS (SELECT doc_id, 'Réception provisoire, puis réception définitive. ' || coalesce(text, '') AS v FROM documents), n AS (SELECT *, {_normal("v")} AS n FROM v),
d AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_some('n', words)} THEN {_text(name)} END" for name, words in rules.RECEPTION_DETAILS)}], lambda x: x IS NOT NULL) AS d FROM n)
SELECT doc_id, sha256(CASE WHEN length(v) < 350 THEN v ELSE 'Modalites de reception: ' || CASE WHEN contains(n, 'reception quantitative') THEN 'reception quantitative, ' ELSE '' END
  || 'reception provisoire puis reception definitive' || CASE WHEN len(d) > 0 THEN ' (' || array_to_string(d, '; ') || ')' ELSE '' END || '.' END) AS digest FROM d""")
def short_receptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("Réception provisoire, puis réception définitive. "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(questions.short_value(F.lit("reception"), value), 256).alias("digest"))


@register("health", "SELECT 'healthy' AS status, 'connected' AS store, 'connected' AS database, 'connected' AS llm, 'local' AS embeddings, count(*) AS chunks FROM conversations")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.health(table(spark, sf_dir, "conversations"))
