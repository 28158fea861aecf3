"""Lexical passage search: term hits, article numbers, and the best passage of each document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import rules
from ..functions import text as T
from ..functions.phrases import folded, normalized
from .chunking import passages, passages_of


#: Terms of questions that are sent to every task; more questions are asked in further passes.
MOST_TERMS = 200_000
#: Characters of passages that are indexed at once.
BLOCK_CHARS = 1 << 22


def score(passage: Column, terms: list[str], article: str | None = None, long: bool = True) -> Column:
    """Hits of terms in a normalised passage, less for numbers, more for the article; long passages lose a point, if ``long``."""

    def total(normal: Column) -> Column:
        out = F.lit(0.0)
        for term in terms:
            if term.isdigit():
                out = out + F.when(normal.rlike(rf"\b{term}\b"), rules.NUMBER_HIT).otherwise(0.0)
            else:
                out = out + F.when(F.contains(normal, F.lit(term)), 1.0).otherwise(0.0)
        if article:
            out = out + F.when(normal.rlike(rf"\barticle\s*{article}\b"), rules.ARTICLE_BONUS).otherwise(0.0)
        return out

    hits = T.let(normalized(passage), total)
    return hits - F.when(F.char_length(passage) > 2600, 1.0).otherwise(0.0) if long else hits


def search(documents: DataFrame, terms: list[str], article: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The best passage of each document that reaches the least score; ties by place."""
    least = rules.ARTICLE_LEAST if article else rules.PASSAGE_LEAST
    # a passage has no more hits than its document; only documents with enough of them are split
    some = documents.where(score(F.col(text), terms, article, long=False) >= least)
    own = some.select(key, F.posexplode(passages(F.col(text))).alias("place", "passage"))
    # let() keeps the filter from computing the score a second time
    scored = own.select(key, "place", "passage", F.explode(F.array(F.round(score(F.col("passage"), terms, article), 4))).alias("score")).where(F.col("score") >= least)
    best = F.max_by(F.struct("passage", "place"), F.struct("score", -F.col("place")))
    return scored.groupBy(key).agg(F.max("score").alias("score"), best.alias("_b")).select(key, "score", "_b.place", "_b.passage")


class Asked:
    """Questions as weights of terms, the dearest bound first pruned away.

    The score of a passage is the sum of the weights of the terms that it has. With a
    question's terms in order from rare to frequent, a passage that has none of the first m
    has at most the sum of the rest; where that is below the best score so far, only
    passages with one of the first m terms are looked at. So frequent terms are looked up
    for candidates and never read as a whole.
    """

    def __init__(self, rows: list[tuple[int, str, float]], n_asked: int, least: float) -> None:
        self.number = {t: k for k, t in enumerate(dict.fromkeys(t for _, t, _ in rows))}
        own: list[dict[int, float]] = [{} for _ in range(n_asked)]
        for q, term, weight in rows:
            k = self.number[term]
            own[q][k] = own[q].get(k, 0.0) + weight
        self.terms = [np.fromiter(x, np.int64, len(x)) for x in own]
        self.weights = [np.fromiter(x.values(), float, len(x)) for x in own]
        self.least = least

    def best(self, found: dict[int, tuple[float, int, int]], keys: list, places: list[int], passages: list[str]) -> None:
        """Puts into ``found`` the best (score, -key, -place) of each question, if it beats what is there."""
        held = [[self.number[w] for w in self.number.keys() & set(folded(x, False).split(" "))] for x in passages]
        sizes = [len(x) for x in held]
        term = np.fromiter((k for x in held for k in x), np.int64, sum(sizes))
        owner = np.repeat(np.arange(len(passages)), sizes)
        order = np.lexsort((owner, term))
        term, owner = term[order], owner[order]
        start = np.searchsorted(term, np.arange(len(self.number) + 1))
        for q, (terms, weights) in enumerate(zip(self.terms, self.weights)):
            count = start[terms + 1] - start[terms]
            some = count > 0
            terms, weights, count = terms[some], weights[some], count[some]
            if not len(terms) or weights.sum() < self.least - 1e-9:
                continue
            by = np.argsort(count, kind="stable")
            terms, weights = terms[by], weights[by]
            rest = np.append(np.cumsum(weights[::-1])[::-1], 0.0)
            floor = max(self.least, found[q][0] if q in found else 0.0) - 1e-9
            first = int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
            posting = lambda t: owner[start[t] : start[t + 1]]
            seen = np.unique(np.concatenate([posting(t) for t in terms[:first]])) if first else np.empty(0, np.int64)
            if not len(seen):
                continue
            total = np.zeros(len(seen))
            for t, w in zip(terms, weights):
                own = posting(t)
                at = np.minimum(np.searchsorted(own, seen), len(own) - 1)
                total += w * (own[at] == seen)
            total = np.round(total, 4)
            top = total.max()
            if top < self.least:
                continue
            for p in seen[total == top].tolist():
                x = (float(top), -keys[p], -places[p])
                if q not in found or x > found[q]:
                    found[q] = x


def _asking(asked: Asked):
    """(k, text) -> each task's best (n, k, place, score) for every question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, int]] = {}
        keys, places, own, size = [], [], [], 0
        for batch in batches:
            for k, text in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist()):
                if k is None or text is None:
                    continue
                for place, passage in enumerate(passages_of(text)):
                    keys.append(k)
                    places.append(place)
                    own.append(passage)
                    size += len(passage)
                if size > BLOCK_CHARS:
                    asked.best(best, keys, places, own)
                    keys, places, own, size = [], [], [], 0
        asked.best(best, keys, places, own)
        columns = list(zip(*((n, -k, -place, score) for n, (score, k, place) in best.items()))) or [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["n", "k", "place", "score"])

    return run


def search_many(documents: DataFrame, questions: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_TERMS) -> DataFrame:
    """For every question (query_id, question) its best passage of all documents; ties to the smallest key and place.

    Questions go to every task, about ``most`` of their terms in one pass over the documents.
    A task indexes the passages of a block by the terms that are asked for and keeps its best
    passage of each question (see ``Asked``). Documents with a null key or text have no passages.
    """
    spark = documents.sparkSession
    asked = questions.select("query_id", F.explode(T.terms_of(F.col("question"))).alias("term"))
    weight = F.when(F.col("term").rlike("^[0-9]+$"), rules.NUMBER_HIT).otherwise(1.0)
    asked = asked.select("query_id", "term", weight.alias("weight"))
    passes = max(1, -(-asked.count() // most))
    out = None
    for part in range(passes):
        # bounded: the terms of one pass
        rows = (asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == part)).collect()
        ids = list(dict.fromkeys(r[0] for r in rows))
        number = {q: n for n, q in enumerate(ids)}
        task = _asking(Asked([(number[q], t, w) for q, t, w in rows], len(ids), rules.PASSAGE_LEAST))
        found = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).mapInArrow(task, "n int, k long, place int, score double")
        names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("n", IntegerType()), asked.schema["query_id"]]))
        best = found.groupBy("n").agg(F.max_by(F.struct(F.col("k").alias(key), "place", "score"), F.struct("score", -F.col("k"), -F.col("place"))).alias("_b"))
        some = best.join(F.broadcast(names), "n").select("query_id", "_b.*")
        out = some if out is None else out.unionByName(some)
    return out


def grep(documents: DataFrame, terms: list[str], most: int = 8, width: int = 240, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first lines of each document that contain each term."""
    found = documents.select(key, F.posexplode(F.split(text, "\n")).alias("_n", "line"))
    hits = found.select(key, (F.col("_n") + 1).alias("number"), "line", F.explode(F.array(*map(F.lit, terms))).alias("term")).where(F.contains(F.lower("line"), F.lower("term")))
    order = Window.partitionBy(key, "term").orderBy("number")
    return hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select(key, "term", "number", F.left("line", F.lit(width)).alias("line"))
