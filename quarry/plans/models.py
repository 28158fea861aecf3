"""Pluggable models: embedding, reranking, generation and fact extraction.

A model is a function over lists of texts that is made once in each Python worker;
the stubs are deterministic and serve tests and offline runs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from ..functions import text as T

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]


def hashing_embedder(size: int = 64) -> Embed:
    """Unit vectors of hashed words; equal texts have equal vectors."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(size, np.float32)
            for word in re.findall(r"\w+", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % size] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(v))
            out.append((v / norm if norm else v).tolist())
        return out

    return embed


def embedded(df: DataFrame, make: Callable[[], Embed], text: str = "text", into: str = "embedding") -> DataFrame:
    """``df`` with vectors of a text column, in Arrow batches; the model is made once in each worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model([x or "" for x in batch]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, ArrayType(FloatType()))(F.col(text)))


def scored(df: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], question: str, text: str, into: str = "rerank") -> DataFrame:
    """``df`` with a cross-encoder's score of (question, text)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for a, b in batches:
            yield pd.Series(model(list(zip(a, b))), dtype="float64")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, DoubleType())(F.col(question), F.col(text)))


def generated(df: DataFrame, make: Callable[[], Generate], prompt: str = "prompt", into: str = "answer") -> DataFrame:
    """``df`` with a model's answers, without reasoning; answers that show guesswork are null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series(model(list(batch)), dtype="object")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    raw = df.withColumn(into, F.pandas_udf(run, StringType())(F.col(prompt)))
    clean = T.strip_reasoning(F.col(into))
    return raw.withColumn(into, F.when(~T.guesswork(clean), clean))


FACT = "struct<text:string,page:string,confidence:string>"


def standard_facts(answers: DataFrame, fields: list[str], raw: str = "answer") -> DataFrame:
    """Model answers (doc_id, answer as JSON, perhaps fenced) -> (doc_id, field, text, page, confidence); unusable ones drop out."""
    schema = f"map<string,{FACT}>"
    parsed = F.from_json(T.json_object(F.col(raw)), schema, {"mode": "PERMISSIVE"})
    rows = answers.select("doc_id", F.explode(parsed).alias("field", "fact")).where(F.col("field").isin(fields))
    return rows.select("doc_id", "field", T.compact(F.col("fact.text")).alias("text"), F.col("fact.page").alias("page"), F.coalesce("fact.confidence", F.lit("medium")).alias("confidence")).where("text <> ''")


def rejected(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts whose words are not on the page they name: (doc_id, field, reason)."""
    from ..operators.reports import quote_check

    joined = facts.join(pages.select("doc_id", "page", F.col("text").alias("_page_text")), ["doc_id", "page"], "left")
    state = quote_check(F.col("text"), F.coalesce("_page_text", F.lit("")))["state"]
    reason = F.when(F.col("_page_text").isNull(), "unknown page").when(state == "missing", "not on the page")
    return joined.select("doc_id", "field", reason.alias("reason")).where("reason is not null")


def enriched(pages: DataFrame, facts: DataFrame, fields: list[str], make: Callable[[], Generate], most_pages: int = 5) -> DataFrame:
    """Stored facts with a model's facts for the fields that lack one; unsupported facts are refused.

    One prompt for each document that lacks a field, from its best evidence pages.
    """
    from ..operators.facts import evidence_pages, reliable

    wanted = F.array(*map(F.lit, fields))
    strong = facts.where(reliable(F.col("field"), F.col("text")))
    have = strong.groupBy("doc_id").agg(F.collect_set("field").alias("_have"))
    weak = pages.select("doc_id").distinct().join(have, "doc_id", "left").select("doc_id", F.array_except(wanted, F.coalesce("_have", F.array().cast("array<string>"))).alias("weak")).where(F.size("weak") > 0)
    chosen = evidence_pages(pages.withColumns({"heading": F.lit(""), "section": F.lit("")}), [f.replace("_", " ") for f in fields], most_pages)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "page", "text"))), lambda x: F.concat(F.lit("[Page "), x["page"], F.lit("]\n"), x["text"])), "\n\n")
    context = chosen.groupBy("doc_id").agg(listed.alias("context"))
    head = F.concat(F.lit("Give the fields as one JSON object, each with text, page and confidence: "), F.array_join("weak", ", "), F.lit("\n\n"))
    prompts = weak.join(context, "doc_id").withColumn("prompt", F.concat(head, "context"))
    found = standard_facts(generated(prompts, make), fields)
    refused = rejected(found, pages).select("doc_id", "field")
    new = found.join(refused, ["doc_id", "field"], "left_anti").join(strong.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    return strong.select("doc_id", "field", "text", "page", F.lit("high").alias("confidence")).unionByName(new)


def json_stub(facts: dict[str, dict]) -> Callable[[], Generate]:
    """A generator that always answers with these facts, for tests."""
    answer = "```json\n" + json.dumps(facts) + "\n```"
    return lambda: lambda prompts: [answer for _ in prompts]


def analysed(chunks: DataFrame, instruction: str, make: Callable[[], Generate]) -> DataFrame:
    """One answer for each document from all of its chunks (doc_id, chunk_index, text) in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n\n---\n\n")
    prompts = chunks.groupBy("doc_id").agg(F.concat(F.lit(instruction + "\n\n"), joined).alias("prompt"))
    return generated(prompts, make).select("doc_id", "answer")


def audit_rows(answers: DataFrame, user_id: str, at: Column) -> DataFrame:
    """Audit entries of answered questions, to be appended."""
    return answers.select(F.lit(user_id).alias("user_id"), F.lit("query").alias("action"), F.col("query_id").cast("string").alias("resource"), F.to_json(F.struct("stage")).alias("metadata"), at.alias("created_at"))
