"""The pipeline's stages, each on what its predecessor kept."""

import unicodedata
from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__
from quarry.llm import decontamination, mixing, ngram_jaccard
from quarry.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert all(b <= a for a, b in zip(seen, seen[1:])) and seen[-1] == seen[-2]
    assert docs.select("shard", "slot").distinct().count() == docs.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.contaminations(docs, bench).count() == 0
    again = ngram_jaccard.near_duplicates(docs).where("component_id <> doc_id").count()
    assert again == 0


CLASHING = ["_first", "_doc", "_print", "_h", "_e", "_row", "_cell", "shard", "slot", "_s", "_l", "_t", "_m_mass", "_q_words", "_q_text", "_salt", "label", "cid", "key", "item_id"]


def awkward(spark, sf_dir):
    """Nulls in every column, repeated rows, blanks, a very long text, and columns named like helpers."""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    docs += docs[:10]
    long_text = " ".join(f"word{k % 977}x{k % 31}" for k in range(60_000))
    docs += [(None, docs[0][1], None, None, None), (None, None, None, None, None), (500, "", "en", "s", 0), (501, " \n", None, "s", 2), (502, long_text, "en", None, len(long_text))]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *(f"{c}{k % 3}" for c in CLASHING)) for k, r in enumerate(docs)], schema).repartition(4)


def test_stages_on_awkward_rows(spark, sf_dir):
    docs = stored(awkward(spark, sf_dir))
    columns, texts = docs.columns, {r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert {r.text for r in docs.collect()} <= texts and docs.count() > 0
    assert docs.columns == [c for c in columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert docs.select("shard", "slot").distinct().count() == docs.count()


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    assert docs.count() == 0 and {"shard", "slot"} <= set(docs.columns)


def survivors_by_force(rows, bench):
    """What the first three stages keep, row by row and pair by pair."""
    def words(text):
        return (text or "").encode().split()

    def rejected(text):
        w = [x.decode() for x in words(text)]
        n, t = len(w), text or ""
        letters = [ch for ch in t if unicodedata.category(ch).startswith("L")]
        upper = sum(unicodedata.category(ch) == "Lu" for ch in letters)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        windows = Counter(zip(w, w[1:], w[2:]))
        twice = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for j in range(3)}
        chars = sum(map(len, w))
        return (
            n < 50 or sum(ch in "#*$%&|<>" for ch in t) * 5 > n or upper * 2 > len(letters) or not n * 2 <= chars <= n * 20
            or len(letters) * 2 < chars or (len(lines) - len(set(lines))) * 2 > len(lines) or len(set(w)) * 20 < min(n, 1000) or len(twice) * 2 > n
        )

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    kept = [r for r in sorted(rows, key=lambda r: r.doc_id) if not rejected(r.text)]
    sets, group = [shingles(r.text) for r in kept], list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if group[a] != group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    kept = [r for k, r in enumerate(kept) if group[k] == k]

    def plain(text):
        return (text or "").lower().encode().translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").split()

    def holds(doc, item):
        width = min(decontamination.STRETCH, len(item))
        at = {}
        for k, x in enumerate(doc):
            at.setdefault(x, []).append(k)
        offsets = {k - j for j, x in enumerate(item) for k in at.get(x, ())}
        for offset in offsets:
            first, last = max(0, offset), min(len(doc), offset + len(item))
            equal = [doc[k] == item[k - offset] for k in range(first, last)]
            if width and any(sum(equal[k : k + width]) >= decontamination.SHARE * width for k in range(len(equal) - width + 1)):
                return True
        return False

    items = [plain(b.text) for b in bench]
    return {r.doc_id for r in kept if not any(holds(plain(r.text), item) for item in items)}


def test_first_stages_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = survivors_by_force(docs.collect(), bench)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stored(stage(spark, docs, sf_dir))
    assert {r.doc_id for r in docs.collect()} == want
    # mixing keeps some of these, by the cells' weights; sharding all it gets
    weights = mixing.weighted(docs).collect()
    mixed = {r.doc_id for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()}
    assert mixed == {r.doc_id for r in weights if r._m_kept} and 0 < len(mixed) < len(want)


def test_run_is_registered(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_for_each_operator(number):
    assert len([q for q in __spark_entry__.queries() if q.startswith(f"op{number}_")]) == 1
