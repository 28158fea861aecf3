"""Prefix trie of conversations by chained digests.

A node is a distinct sequence of first d turns (role, text) of the conversations; the root
is the empty one. For each node the operator gives its members, children, the leaves below
it, the words that sharing prefixes saves below it, and a digest of the members that end in it.

Method. Every turn becomes the SHA-256 of its role and text, every prefix the chained digest
of its turns. All prefixes are rows, (depth, digest) groups them into nodes, and nodes are
exploded to their ancestors for the sums over subtrees. Before that explosion, nodes are
added up: the smallest member of a node is also that of the node's first child on its way, so
the nodes that one conversation stands for are the lower end of its path. Their sums run up
that end, and only its total goes to each ancestor above. So no more rows are exploded than
there are turns, however deep a conversation is.

Scale. Texts are read once and not shuffled. A conversation of any length is dealt by spans
of ``SPAN`` turns: turns are numbered and digests chained within a span, then the spans'
last digests are chained, one row for each span. What groups nodes is combined before it is
shuffled, so a third of all conversations may share a turn. The ids that end in one node are
sorted over all tasks and joined into pieces of ``PIECE`` ids; SHA-256 of their whole string
is sequential, so one task reads these pieces as a stream and holds one at a time.

Defined cases: turns without a conv_id belong to no conversation; a null role or text is
empty; null turn numbers come first; turns with equal numbers (ties) go by role, then by the
digest of role and text, so repeated rows are turns that follow each other; a conversation
that is left without turns is a member of the root only; an empty table has no nodes; very
long texts are digested whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, rows_of, small_batches, stored
from .quality_rules import words_of

#: Turns of a conversation that one task numbers and chains.
SPAN = 4096
#: Ids in one piece of the string of a node's last members.
PIECE = 4096
#: The digest of the empty sequence: any value that no chain gives.
ROOT = bytes(32)


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, item, words): each turn by the SHA-256 of its role and text, with the number of its words."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.unhex(F.sha2(role, 256)), F.unhex(F.sha2(text, 256))), 256))
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), item.alias("item"), F.size(words_of(text)).cast("long").alias("words")
    )


def numbered(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """(c, pos, item, words): turns with their place in the conversation, from 0.

    Places count within spans of turn numbers, after the turns of all earlier spans.
    """
    spans = turns.withColumn("bucket", F.floor(F.col("turn") / span))
    earlier = Window.partitionBy("c").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = spans.groupBy("c", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier))
    # only conversations of several spans have such rows; the first span, which may be null, has none
    later = sizes.where("before is not null").select("c", "bucket", "before")
    own = Window.partitionBy("c", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "item")
    placed = spans.withColumn("pos", F.row_number().over(own) - 1).join(later, ["c", "bucket"], "left")
    return placed.select("c", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "item", "words")


def borrowed(c: Column) -> Column:
    """How many turns conversation ``c`` begins with that are another's."""
    return (F.crc32(c.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations with borrowed openings: (c, depth, item, words), and the ids (c, n) with the turns each has."""
    c = F.col
    sizes = turns.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": borrowed(c("c")), "donor": c("c") - c("c") % 20})
    donors = sizes.select(c("c").alias("donor"), c("own").alias("given"))
    ids = sizes.join(donors, "donor", "left").withColumn("k", F.least("h", F.coalesce("given", F.lit(0))))
    ids = stored(ids.select("c", "own", "h", "donor", "k"))
    # at most 39 conversations borrow from one
    opening = turns.where("pos < 3").select(c("c").alias("donor"), "pos", "item", "words").join(ids, "donor").where("pos < k")
    opening = opening.select("c", (c("pos") + 1).alias("depth"), "item", "words")
    # where a donor has fewer turns than are borrowed, the own ones follow sooner
    short = ids.where("k < h").select("c", (c("h") - c("k")).alias("less"))
    own = turns.where(c("pos") >= borrowed(c("c"))).join(short, "c", "left")
    own = own.select("c", (c("pos") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "item", "words")
    return opening.unionByName(own), ids.select("c", (c("k") + F.greatest(c("own") - c("h"), F.lit(0))).alias("n"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, span, item, ...) in order -> the same with the chained digest of each (c, span) so far, and that before it."""
    key, last = None, b""
    for batch in rows_of(batches):
        own, before = [], []
        for c, span, item in zip(*(batch.column(x).to_pylist() for x in ("c", "span", "item"))):
            if (c, span) != key:
                key, last = (c, span), b""
            before.append(last or None)
            last = hashlib.sha256(last + item).digest()
            own.append(last)
        rest = [n for n in batch.schema.names if n != "item"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(own, pa.binary()), pa.array(before, pa.binary())], names=[*rest, "local", "previous"])


def _chained(rows: DataFrame, by: str) -> DataFrame:
    """``_chain`` over the rows (c, span, item, ...) of each (c, span), ordered by ``by``."""
    rest = ", ".join(f"{n} {kind}" for n, kind in rows.dtypes if n != "item")
    dealt = rows.repartition(partitions(rows.sparkSession), "c", "span").sortWithinPartitions("c", "span", by)
    return dealt.mapInArrow(_chain, f"{rest}, local binary, previous binary")


def prefixes(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """Table (c, depth, item, words) -> (c, depth, digest, parent, words), one row for each prefix."""
    c = F.col
    sha = lambda a, b: F.unhex(F.sha2(F.concat(a, b), 256))
    local = stored(_chained(turns.withColumn("span", F.floor((c("depth") - 1) / span)), "depth"))
    # a row for each full span: its last digest, chained with those before it
    full = local.where(c("depth") % span == 0).select("c", F.lit(0).cast("long").alias("span"), c("span").alias("number"), c("local").alias("item"), c("local").alias("last"))
    seeds = _chained(full, "number").select(
        "c", (c("number") + 1).alias("span"), c("local").alias("seed"),
        F.when(c("previous").isNull(), c("last")).otherwise(sha(c("previous"), c("last"))).alias("ended"),
    )
    seeded = local.join(seeds, ["c", "span"], "left")
    whole = lambda x: F.when(c("seed").isNull(), c(x)).otherwise(sha(c("seed"), c(x)))
    parent = F.coalesce(F.when(c("previous").isNotNull(), whole("previous")), "ended", F.lit(ROOT))
    return seeded.select("c", "depth", whole("local").alias("digest"), parent.alias("parent"), "words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, c) in order -> (digest, first, ids): runs of at most PIECE ids of a digest, comma-joined."""
    key, held = None, []
    rows: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, names=["digest", "first", "ids"])

    for batch in rows_of(batches):
        for digest, c in zip(batch.column("digest").to_pylist(), batch.column("c").to_pylist()):
            if held and (digest != key or len(held) == PIECE):
                rows.append((key, held[0], ",".join(map(str, held))))
                held = []
            key = digest
            held.append(c)
        if rows:
            yield batch_of()
    if held:
        rows.append((key, held[0], ",".join(map(str, held))))
        yield batch_of()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, first, ids) in order -> (digest, ends): SHA-256 of a digest's ids, all pieces joined by commas."""
    key, state = None, None
    for batch in rows_of(batches):
        done = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([x for _, x in done])], names=["digest", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["digest", "ends"])


def ends_of(last: DataFrame) -> DataFrame:
    """(digest, c) -> (digest, ends), one row for each digest."""
    width = partitions(last.sparkSession)
    sorted_ = stored(last.select("digest", "c")).repartitionByRange(width, "digest", "c").sortWithinPartitions("digest", "c")
    pieces = sorted_.mapInArrow(_pieces, "digest binary, first long, ids string")
    dealt = pieces.repartition(width, "digest").sortWithinPartitions("digest", "first")
    return dealt.mapInArrow(_ends, "digest binary, ends string")


def _chain_sums(nodes: DataFrame, span: int = SPAN) -> DataFrame:
    """Nodes with ``leaves`` and ``saved`` summed over the node and all deeper ones with the same smallest member."""
    c, values = F.col, ("leaves", "saved")
    spans = nodes.withColumn("span", F.floor(c("depth") / span))
    deeper = Window.partitionBy("conv_id", "span").orderBy(c("depth").desc())
    below = Window.partitionBy("conv_id").orderBy(c("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy("conv_id", "span").agg(*[F.sum(x).alias(x) for x in values])
    # only paths of several spans have such rows
    more = totals.select("conv_id", "span", *[F.sum(x).over(below).alias(f"more_{x}") for x in values]).where("more_leaves is not null")
    summed = spans.withColumns({x: F.sum(x).over(deeper) for x in values}).join(more, ["conv_id", "span"], "left")
    return summed.withColumns({x: c(x) + F.coalesce(f"more_{x}", F.lit(0)) for x in values}).drop("span", "more_leaves", "more_saved")


def trie(paths: DataFrame, ids: DataFrame, span: int = SPAN) -> DataFrame:
    """The nodes of the prefixes ``paths`` (c, depth, digest, parent, words) of the conversations ``ids`` (c, n)."""
    c = F.col
    root = ids.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("digest"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    grouped = paths.groupBy("depth", "digest").agg(
        F.min("parent").alias("parent"), F.max("words").alias("words"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs")
    )
    nodes = stored(grouped.unionByName(root))
    children = nodes.where("parent is not null").groupBy(c("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    valued = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    valued = valued.withColumns({"leaves": (c("n_children") == 0).cast("long"), "saved": (c("n_convs") - 1) * c("words")})
    summed = stored(_chain_sums(valued, span))

    # the lower end of each path goes, as one sum, to every ancestor above it
    tops = summed.groupBy("conv_id").agg(F.min(F.struct("depth", "leaves", "saved")).alias("x"))
    tops = stored(tops.select(c("conv_id").alias("c"), "x.*").where("depth > 0"))
    above = tops.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(c("depth") / span))))
    spread = paths.select("c", c("depth").alias("at"), "digest", F.floor(c("depth") / span).alias("span")).join(above, ["c", "span"]).where("at < depth")
    given = spread.select("digest", "leaves", "saved").unionByName(tops.select(F.lit(ROOT).alias("digest"), "leaves", "saved"))
    given = given.groupBy("digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    last = paths.groupBy("c").agg(F.max(F.struct("depth", "digest")).alias("x")).select("x.digest", "c")
    ends = ends_of(last.unionByName(ids.where("n = 0").select(F.lit(ROOT).alias("digest"), "c")))
    parents = summed.select(c("digest").alias("parent"), c("conv_id").alias("parent_conv_id"))
    whole = summed.join(given, "digest", "left").join(ends, "digest", "left").join(parents, "parent", "left")
    total = lambda x: c(x) + F.coalesce(f"more_{x}", F.lit(0))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """The trie of the rebuilt conversations, one row for each node."""
    small_batches(conversations.sparkSession)
    turns = stored(numbered(stored(turn_digests(conversations)), span))
    rows, ids = rebuilt(turns)
    return trie(stored(prefixes(rows, span)), stored(ids), span)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, {'role': role, 'text': text} AS item,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(unhex(sha256(role)) || unhex(sha256(text)))) AS pos
  FROM t),
own AS (SELECT c, list(item ORDER BY pos) AS items FROM o GROUP BY c),
h AS (
  SELECT c, items,
         xor(list_reduce(
           flatten([[4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
             lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT) % 4 AS h
  FROM own),
r AS (
  SELECT h.c, coalesce(d.items[1:h.h], []) || h.items[h.h + 1:] AS items
  FROM h LEFT JOIN own d ON d.c = h.c - h.c % 20),
p AS (SELECT c, items, unnest(range(0, len(items) + 1)) AS depth FROM r),
q AS (SELECT c, depth, items[1:depth] AS path, len(items) = depth AS ended FROM p),
n AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256
  FROM q GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(n.path[depth].text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) END AS saved
  FROM n LEFT JOIN k USING (path)),
a AS (SELECT path[1:x] AS path, n_children, saved FROM (SELECT *, unnest(range(0, depth + 1)) AS x FROM v)),
s AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY path)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (path) LEFT JOIN v u ON v.depth > 0 AND u.path = v.path[1:v.depth - 1]
"""
