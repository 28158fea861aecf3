"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic; a cell's mass is its
number of words. Raking multiplies the cells' weights in turn so that the kept
mass of every source, every language and every topic reaches its target; weights
are probabilities, so those above 1 are cut to 1 and the others raked on. Every
document is then kept if a hash of it, as a number between 0 and 1, lies below the
weight of its cell, whatever its partition.

Targets are shares by dimension; where none are given, natural shares to the power
``TEMPER``, which lifts rare sources, languages and topics.

Cells are counted with partial sums, so a hot source is no hot task. Up to
``MOST_CELLS`` cells are raked as arrays in the driver; more are raked by the same
steps as DataFrames.

Defined cases: nulls in source, language or text are values of their own (the
topic of a null or blank text is ``none``, its mass 0); repeated rows share one
decision; documents of cells without mass have the weight that keeps the stated
share; equal targets or masses (ties) have no order that matters; a very long text
is one document with all its words; an empty table gives an empty result; further
columns are kept, and where one of them begins with ``_m_`` the helper columns
begin with more underscores.

Targets can contradict each other or ask for more than there is. ``shortfalls``
lists what each value's target is and what the weights reach.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import words_of

DIMENSIONS = ("source", "lang", "topic")
KEEP = 0.5
TEMPER = 0.8
ROUNDS = 50
CLOSE = 1e-4
MOST_CELLS = 200_000
#: Parts of a cell's documents where cells are joined by a shuffle.
CELL_SALTS = 32


def topic_of(text: Column) -> Column:
    """A coarse topic from a text's make-up: none, table, figures, brief, notes, article, long."""
    text = F.coalesce(text, F.lit(""))
    n = F.char_length(text)
    bars = F.regexp_count(text, F.lit(r" \| "))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    return (
        F.when(F.trim(text) == "", "none")
        .when(bars * 40 > n, "table")
        .when(digits * 20 > n, "figures")
        .when(n < 500, "brief")
        .when(n < 2000, "notes")
        .when(n < 8000, "article")
        .otherwise("long")
    )


def _targets(mass: dict[str, dict], given: dict[str, dict] | None) -> dict[str, dict]:
    """Target shares of each dimension, for the values that occur."""
    out = {}
    for d in DIMENSIONS:
        natural = mass[d]
        wanted = (given or {}).get(d)
        raw = {v: (wanted.get(v, 0.0) if wanted else m**TEMPER) for v, m in natural.items()}
        total = sum(raw.values()) or 1.0
        out[d] = {v: x / total for v, x in raw.items()}
    return out


def raked(cells: list[tuple], keep: float, given: dict[str, dict] | None = None) -> np.ndarray:
    """Weights of cells (source, lang, topic, mass), by raking with weights of at most 1."""
    mass = np.array([c[3] for c in cells], float)
    total = mass.sum()
    w = np.full(len(cells), keep)
    if not total:
        return w
    codes, goals = [], []
    for k, d in enumerate(DIMENSIONS):
        values = {v: i for i, v in enumerate(dict.fromkeys(c[k] for c in cells))}
        code = np.array([values[c[k]] for c in cells])
        natural = np.bincount(code, weights=mass, minlength=len(values))
        share = _targets({x: dict(zip(values, natural)) if x == d else {} for x in DIMENSIONS}, given)[d]
        codes.append(code)
        goals.append(np.array([share[v] for v in values]) * keep * total)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weights=w * mass, minlength=len(goal))
            factor = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1)[now > 0].max(initial=0)))
            w = np.minimum(w * factor[code], 1.0)
        if worst < CLOSE:
            break
    return w


def raked_frame(cells: DataFrame, keep: float, given: dict[str, dict] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The same as DataFrames, for any number of cells: (_m_source, _m_lang, _m_topic, _m_mass, _m_weight)."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("_m_mass").alias("x")).collect()[0]["x"] or 0
    cells = stored(cells.withColumn("_m_weight", F.lit(float(keep))))
    if not total:
        return cells
    goals = {}
    for d in DIMENSIONS:
        own = cells.groupBy(f"_m_{d}").agg(F.sum("_m_mass").alias("m")).withColumnRenamed(f"_m_{d}", "v")
        if (given or {}).get(d):
            shares = spark.createDataFrame(list(given[d].items()), "g string, s double")
            own = own.join(shares, F.col("v").eqNullSafe(F.col("g")), "left").select("v", F.coalesce("s", F.lit(0.0)).alias("raw"))
        else:
            own = own.select("v", F.pow("m", F.lit(TEMPER)).alias("raw"))
        scale = own.agg(F.sum("raw").alias("x")).collect()[0]["x"] or 1.0
        goals[d] = stored(own.select("v", (F.col("raw") / scale * keep * total).alias("goal")))
    for _ in range(rounds):
        worst = 0.0
        for d in DIMENSIONS:
            now = cells.groupBy(f"_m_{d}").agg(F.sum(F.col("_m_weight") * F.col("_m_mass")).alias("now"))
            factor = now.join(goals[d], F.col(f"_m_{d}").eqNullSafe(F.col("v"))).select("v", F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0).alias("f"))
            factor = stored(factor)
            worst = max(worst, factor.agg(F.max(F.abs(F.col("f") - 1)).alias("x")).collect()[0]["x"] or 0.0)
            cells = cells.join(factor, F.col(f"_m_{d}").eqNullSafe(F.col("v"))).withColumn("_m_weight", F.least(F.col("_m_weight") * F.col("f"), F.lit(1.0))).drop("v", "f")
        cells = stored(cells)
        if worst < CLOSE:
            break
    return cells


def prefix_of(columns: list[str]) -> str:
    """What the helper columns begin with: ``_m_``, with as many underscores before it as no column has."""
    prefix = "_m_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def _cells(df: DataFrame, topic: Column | None = None) -> tuple[DataFrame, DataFrame, str]:
    """``df`` with its dimensions and mass, the table of its cells, and the prefix of these columns."""
    m = prefix_of(df.columns)
    named = df.withColumns({
        f"{m}source": F.col("source").cast("string"), f"{m}lang": F.col("lang").cast("string"),
        f"{m}topic": topic if topic is not None else topic_of(F.col("text")),
        f"{m}mass": F.size(words_of(F.col("text"))).cast("long"),
    })
    keys = [F.col(f"{m}{d}").alias(f"_m_{d}") for d in DIMENSIONS]
    return named, stored(named.groupBy(*keys).agg(F.sum(f"{m}mass").alias("_m_mass"))), m


def _raked_cells(cells: DataFrame, keep: float, targets: dict[str, dict] | None, most_cells: int) -> tuple[DataFrame, bool]:
    """The cells (_s, _l, _t, _w) with their weights, and whether they are few."""
    few = cells.count() <= most_cells
    if few:
        rows = sorted((tuple(r) for r in cells.collect()), key=repr)
        found = raked(rows, keep, targets)
        made = cells.sparkSession.createDataFrame([(*r[:3], float(w)) for r, w in zip(rows, found)], "_s string, _l string, _t string, _w double")
    else:
        made = raked_frame(cells, keep, targets).select(*[F.col(f"_m_{d}").alias(a) for d, a in zip(DIMENSIONS, ("_s", "_l", "_t"))], F.col("_m_weight").alias("_w"))
    return made, few


def weighted(df: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, topic: Column | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """``df`` with _m_source, _m_lang, _m_topic, _m_mass (its words), _m_weight and _m_kept."""
    named, cells, m = _cells(df, topic)
    weights, few = _raked_cells(cells, keep, targets, most_cells)
    # one string for each cell, with the nulls told apart
    cell = lambda *c: F.to_json(F.array(*c), {"ignoreNullFields": "false"})
    weights = weights.select(cell("_s", "_l", "_t").alias(f"{m}cell"), F.col("_w").alias(f"{m}weight"))
    rows = named.withColumn(f"{m}cell", cell(*[F.col(f"{m}{d}") for d in DIMENSIONS]))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11) / F.lit(float(2**53))
    if few:
        joined = rows.join(F.broadcast(weights), f"{m}cell")
    else:
        # the documents of a cell, of which a hot source may have most, are dealt to several tasks
        salt = F.pmod(F.xxhash64("doc_id", "text"), F.lit(CELL_SALTS)).cast("int")
        everywhere = weights.withColumn(f"{m}salt", F.explode(F.sequence(F.lit(0), F.lit(CELL_SALTS - 1))))
        joined = rows.withColumn(f"{m}salt", salt).join(everywhere, [f"{m}cell", f"{m}salt"])
    return joined.withColumn(f"{m}kept", chance < F.col(f"{m}weight")).select(*[F.col(f"`{c}`") for c in df.columns], *[f"{m}{x}" for x in (*DIMENSIONS, "mass", "weight", "kept")])


def shortfalls(df: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None, topic: Column | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """(dimension, value, target, reached): the share of the kept mass that each value should have, and has."""
    _, cells, _ = _cells(df, topic)
    weights, _ = _raked_cells(cells, keep, targets, most_cells)
    same = [F.col(f"_m_{d}").eqNullSafe(F.col(a)) for d, a in zip(DIMENSIONS, ("_s", "_l", "_t"))]
    cells = stored(cells.join(weights, same[0] & same[1] & same[2]).select(*[f"_m_{d}" for d in DIMENSIONS], "_m_mass", (F.col("_m_mass") * F.col("_w")).alias("_m_has")))
    total = cells.agg(F.sum("_m_has").alias("x")).collect()[0]["x"] or 1.0
    out = None
    for d in DIMENSIONS:
        own = cells.groupBy(F.col(f"_m_{d}").alias("value")).agg(F.sum("_m_mass").alias("mass"), (F.sum("_m_has") / total).alias("reached"))
        given = (targets or {}).get(d)
        if given:
            wanted = df.sparkSession.createDataFrame(list(given.items()), "g string, raw double")
            own = own.join(wanted, F.col("value").eqNullSafe(F.col("g")), "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
        else:
            own = own.withColumn("raw", F.pow("mass", F.lit(TEMPER)))
        scale = own.agg(F.sum("raw").alias("x")).collect()[0]["x"] or 1.0
        part = own.select(F.lit(d).alias("dimension"), "value", (F.col("raw") / scale).alias("target"), "reached")
        out = part if out is None else out.unionByName(part)
    return out


def mix(df: DataFrame, keep: float = KEEP, targets: dict[str, dict] | None = None) -> DataFrame:
    """The sampled documents, with the input's columns."""
    return weighted(df, keep, targets).where(F.col(f"{prefix_of(df.columns)}kept")).select(*[F.col(f"`{c}`") for c in df.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, words, probability and whether it is sampled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return weighted(docs).select(
        "doc_id", F.col("_m_source").alias("source"), F.col("_m_lang").alias("lang"), F.col("_m_topic").alias("topic"),
        F.col("_m_mass").alias("n_words"), F.col("_m_weight").alias("probability"), F.col("_m_kept").alias("kept"),
    )
