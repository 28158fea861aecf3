"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Statistics of every text are measured in Arrow batches, since a dozen passes of
regular expressions cost several times as much. On a bounded sample of labelled
rows a series of shallow regression trees is boosted; every path from a root to a node is
a conjunctive rule over the statistics. A lasso logistic regression picks few of
these rules and of the (clipped) statistics and weighs them, and the result is one
column expression over the statistics.

The model is fitted on at most ``MOST_ROWS`` rows of each class, those whose hashed
ids are least; all scores cover all rows and whole texts.

Defined cases: null or empty text has the statistics of no words (all 0) and is
scored like any text; a null id is held out or not by the CRC of the empty text;
repeated rows get equal scores; without labelled rows of both classes every score
is the share of good rows, or 0 without any labelled row; ids whose labels differ
teach nothing; equal scores (ties) get equal predictions; a very long text is
measured whole; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, distinct, gram_hashes, rows_of, small_batches, texts, word_hashes
from .toxicity import labelled_sample, remainder

MOST_ROWS = 1000
TREES, DEPTH, LEAST_LEAF = 30, 3, 5
#: Lasso penalties tried from strong to weak; the strongest within one standard error of the best is taken.
PENALTIES = (0.02, 0.01, 0.004, 0.002)
FOLDS = 3
THRESHOLD = 0.3


NAMES = (
    "log_words word_length upper_share digit_share letter_share stop_share mark_share symbols_a_word "
    "distinct_words distinct_pairs duplicate_lines lines_a_word"
).split()


_KINDS = "other upper letter digit stop mark symbol blank".split()


def _character_kinds() -> np.ndarray:
    """The kind of every code point, as a place in _KINDS."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            out[point] = 1 if kind == "Lu" else 2
        elif kind == "Nd":
            out[point] = 3
    for place, signs in ((4, ".,;:?"), (5, "!"), (6, "#*$%&|<>"), (7, SPACE_CHARS)):
        out[[ord(x) for x in signs]] = place
    return out


def statistics(batch: list[bytes], kinds: np.ndarray) -> np.ndarray:
    """The statistics of each text, in the order of NAMES; shares lie between 0 and 1."""
    out = np.zeros((len(batch), len(NAMES)))
    for k, (text, words) in enumerate(zip(batch, word_hashes(batch))):
        chars = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        n, m = max(1, len(words)), max(1, len(chars))
        c = np.bincount(kinds[chars], minlength=len(_KINDS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        pairs = gram_hashes(words, 2)
        out[k] = (
            np.log1p(len(words)),
            (len(chars) - c[7]) / n,
            c[1] / m,
            c[3] / m,
            (c[1] + c[2]) / m,
            c[4] / m,
            c[5] / m,
            c[6] / n,
            len(distinct(words)) / n,
            len(distinct(pairs)) / n,
            (len(lines) - len(set(lines))) / max(1, len(lines)),
            (text.count(b"\n") + 1) / n,
        )
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _character_kinds()
    for batch in rows_of(batches):
        found = statistics(texts(batch.column("text")), kinds)
        kept = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *(pa.array(v) for v in found.T)], names=[*kept, *NAMES])


def with_statistics(df: DataFrame) -> DataFrame:
    """The columns of ``df``, but for ``text``, and its statistics."""
    small_batches(df.sparkSession)
    kept = df.drop("text").schema
    for name in NAMES:
        kept = kept.add(name, "double")
    return df.mapInArrow(_measured, kept)


@dataclass(frozen=True)
class Rule:
    """A conjunction of conditions (statistic, is at most, threshold)."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, at_most, cut in self.parts:
            out &= (x[:, k] <= cut) == at_most
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for k, at_most, cut in self.parts:
            part = F.col(NAMES[k]) <= F.lit(cut)
            out = out & (part if at_most else ~part)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...] = ()
    #: statistic, low, high, weight: the statistic is clipped to low..high
    linear: tuple[tuple[int, float, float, float], ...] = ()

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in self.rules:
            out += w * rule.holds(x)
        for k, low, high, w in self.linear:
            out += w * np.clip(x[:, k], low, high)
        return out

    def score(self) -> Column:
        """The compiled expression: 0 to 1."""
        logit = F.lit(self.bias)
        for rule, w in self.rules:
            logit = logit + F.when(rule.column(), F.lit(w)).otherwise(F.lit(0.0))
        for k, low, high, w in self.linear:
            logit = logit + F.lit(w) * F.least(F.greatest(F.col(NAMES[k]), F.lit(low)), F.lit(high))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def tree_paths(x: np.ndarray, target: np.ndarray, depth: int = DEPTH) -> tuple[list[tuple], np.ndarray]:
    """Least-squares tree: the paths of all its nodes but the root, and the fitted values."""
    paths: list[tuple] = []
    out = np.empty(len(x))

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        y = target[rows]
        out[rows] = y.mean()
        if path:
            paths.append(path)
        if not left or len(rows) < 2 * LEAST_LEAF:
            return
        best = (1e-9, 0, 0.0)
        total, n = y.sum(), len(y)
        for k in range(x.shape[1]):
            order = np.argsort(x[rows, k], kind="stable")
            v, below = x[rows[order], k], np.cumsum(y[order])[:-1]
            m = np.arange(1, n)
            gain = below**2 / m + (total - below) ** 2 / (n - m) - total**2 / n
            gain[(v[1:] <= v[:-1]) | (m < LEAST_LEAF) | (n - m < LEAST_LEAF)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), k, float((v[at] + v[at + 1]) / 2))
        if best[0] <= 1e-9:
            return
        _, k, cut = best
        low = x[rows, k] <= cut
        grow(rows[low], (*path, (k, True, cut)), left - 1)
        grow(rows[~low], (*path, (k, False, cut)), left - 1)

    grow(np.arange(len(x)), (), depth)
    return paths, out


def boosted_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Distinct rules from trees that each fit what the earlier ones left, on half of the rows."""
    random, f = np.random.default_rng(seed), np.zeros(len(y))
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = np.sort(random.choice(len(y), max(2 * LEAST_LEAF, len(y) // 2), replace=len(y) < 4 * LEAST_LEAF))
        rest = y - 1 / (1 + np.exp(-f))
        paths, _ = tree_paths(x[rows], rest[rows])
        kept = {Rule(tuple(sorted(p))).parts: None for p in paths}
        found.update(kept)
        leaf = np.zeros(len(y))
        for p in paths:  # deeper paths come later and overwrite
            here = Rule(p).holds(x)
            own = Rule(p).holds(x[rows])
            if own.any():
                leaf[here] = rest[rows][own].mean()
        f += 0.4 * leaf
    distinct, seen = [], set()
    for parts in found:
        sign = Rule(parts).holds(x)
        if 0 < sign.sum() < len(y) and sign.tobytes() not in seen:
            seen.update((sign.tobytes(), (~sign).tobytes()))
            distinct.append(Rule(parts))
    return distinct


def lasso(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 400) -> np.ndarray:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the last weight is the bias."""
    n = weight.sum()
    step = 4 * n / max(1e-9, float(np.linalg.norm(np.sqrt(weight)[:, None] * np.hstack([z, np.ones((len(z), 1))]), 2) ** 2))
    w = np.zeros(z.shape[1] + 1) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ ahead[:-1] + ahead[-1], -40, 40)))
        g = weight * (p - y) / n
        after = ahead - step * np.append(z.T @ g, g.sum())
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - step * penalty, 0)
        further = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / further * (after - w)
        done = np.abs(after - w).max() < 1e-6
        w, t = after, further
        if done:
            break
    return w


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """Rules from trees, then the lasso's choice of rules and statistics."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    rules = boosted_rules(x, y)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    scale = clipped.std(axis=0)
    used = np.flatnonzero(scale > 1e-12)
    z = np.hstack([*(r.holds(x)[:, None].astype(float) for r in rules), 0.4 * (clipped[:, used] - clipped[:, used].mean(axis=0)) / scale[used]])
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    fold = np.arange(len(y)) % FOLDS
    losses = []
    for penalty in PENALTIES:
        own = []
        for k in range(FOLDS):
            train, test = fold != k, fold == k
            if not len(np.unique(y[train])) == 2 or not test.any():
                continue
            w = lasso(z[train], y[train], weight[train], penalty, rounds=80)
            m = np.clip(z[test] @ w[:-1] + w[-1], -40, 40)
            own.append(np.average(np.logaddexp(0, m) - y[test] * m, weights=weight[test]))
        losses.append((np.mean(own), np.std(own) / np.sqrt(max(1, len(own)))) if own else (0.0, 0.0))
    best = min(range(len(PENALTIES)), key=lambda k: losses[k][0])
    chosen = next(k for k in range(len(PENALTIES)) if losses[k][0] <= losses[best][0] + losses[best][1])
    w = lasso(z, y, weight, PENALTIES[chosen])
    bias, m = float(w[-1]), len(rules)
    linear = []
    for j, k in enumerate(used.tolist()):
        if w[m + j]:
            slope = float(0.4 * w[m + j] / scale[k])
            bias -= slope * float(clipped[:, k].mean())
            linear.append((k, float(low[k]), float(high[k]), slope))
    return Model(bias, tuple((r, float(v)) for r, v in zip(rules, w[:m]) if v), tuple(linear))


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> Model:
    """Fits on the bounded sample of allowed labelled rows."""
    sample = labelled_sample(docs, labels, "quality", {1: MOST_ROWS, 0: MOST_ROWS}, allowed)
    rows = with_statistics(sample).select("label", *NAMES).collect()
    rows = sorted(tuple(r) for r in rows)
    data = np.array(rows, float).reshape(-1, len(NAMES) + 1)
    shuffled = data[np.random.default_rng(11).permutation(len(data))]
    return fitted(shuffled[:, 1:], shuffled[:, 0])


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score) for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return with_statistics(rows).select("doc_id", "held_out", model.score().alias("score"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted on rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, remainder(F.col("doc_id"), 5) != 0)
    return quality(docs, model).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
