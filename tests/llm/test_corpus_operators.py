"""Each corpus operator against brute force on small fixtures with awkward rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, ngram_jaccard, pii, quality_classifier, quality_rules, sharding, substring_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shared int"
BLANK = " \t\n\x0b\x0c\r"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=1):
    """Copies, near copies, shared passages, nulls, blanks, repeated rows, a hot source and a long text."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.choice([1, 3, 4, 5, 19, 20, 21, 60, 150])) for _ in range(40)]
    passage = sentence(rng, 30)
    texts = list(base)
    for t in base[:20]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words), t.upper()]
    texts += [passage + " " + sentence(rng, rng.randrange(12)) for _ in range(12)]
    texts += [sentence(rng, 8) + "\n" + passage + "  " + passage for _ in range(4)]
    texts += ["same hot text of a few words only"] * 60
    texts += [None, "", "   \n\t ", "one", sentence(rng, 4000), "a b c " * 50, "Ünïcode é ß 中文 \U0001f600 word"]
    rows = [(k, t, rng.choice(["en", "fr", None]), "hot" if rng.random() < 0.4 else f"s{k % 5}", len(t or ""), k) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    again = [rows[3], rows[3], (None, base[0], "en", None, 1, 0), (None, None, None, None, None, None)]
    return rows + again


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# 1 ------------------------------------------------------------------------


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def components_by_force(rows):
    nodes = [(2**63 - 1 if r[0] is None else r[0], shingle_set(r[1])) for r in rows]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            x, y = nodes[a][1], nodes[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (doc, s) in enumerate(nodes):
        least[find(k)] = min(least.get(find(k), doc), doc)
    out = []
    for k, (doc, s) in enumerate(nodes):
        comp = least[find(k)] if s else doc
        out.append(tuple(None if x == 2**63 - 1 else x for x in (doc,)) + (len(s), None if comp == 2**63 - 1 else comp))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = awkward_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = as_rows(ngram_jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id"))
    assert got == components_by_force(rows)


def test_near_copies_linked_through_chains(spark):
    """A chain in which only neighbours are similar, and a star whose leaves are not."""
    rng = random.Random(5)
    words = sentence(rng, 200, 10**6).split()
    chain, rows = list(words), []
    for k in range(12):
        rows.append((k, " ".join(chain)))
        at = 10 + 15 * k
        chain[at : at + 8] = [f"x{k}_{j}" for j in range(8)]
    for k in range(30):
        leaf = words[100:] + sentence(rng, 60, 10**6).split()[:0]
        at = rng.randrange(len(leaf))
        leaf[at] = f"leaf{k}"
        rows.append((100 + k, " ".join(leaf)))
    rows = [(a, b, None, None, None, None) for a, b in rows]
    got = as_rows(ngram_jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id"))
    assert got == components_by_force(rows)


def test_split_hot_tokens(spark, monkeypatch):
    """Postings of frequent tokens dealt to several tasks give the same components."""
    monkeypatch.setattr(ngram_jaccard, "SPLIT_FROM", 1)
    rows = awkward_rows(3)
    got = as_rows(ngram_jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_shingles", "component_id"))
    assert got == components_by_force(rows)


def test_one_of_each(docs, rows):
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    force = components_by_force(rows)
    assert sorted(ids, key=repr) == sorted({c for _, _, c in force}, key=repr)


def test_one_of_each_loses_no_unlinked_text(spark):
    rng = random.Random(11)
    a, b, c, d, e, f, g = (sentence(rng, 60, 10**6) for _ in range(7))
    near = c.replace(c.split(" ")[-1], "changed")
    rows = [
        (None, a), (None, b), (None, b + " "), (None, near),  # two components without an id, one of document 3
        (3, c), (7, d), (7, near), (4, e), (4, f), (4, f), (9, e),
        (None, None), (None, " "), (5, ""), (5, ""), (5, g),
    ]
    for n in (1, 4):
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _doc int").repartition(n)
        kept = ngram_jaccard.one_of_each(df)
        assert kept.columns == df.columns
        got = [(r.doc_id, r.text and r.text.strip()) for r in kept.collect()]
        want = [(None, a), (None, b), (3, c), (7, d), (4, e), (4, f), (None, None), (None, ""), (5, ""), (5, g)]
        assert sorted(got, key=repr) == sorted(want, key=repr)


# 2, 10 ----------------------------------------------------------------------


def test_toxicity_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.op2_toxicity(spark, big).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic = [r.score for r in out if r.toxic]
    clean = [r.score for r in out if not r.toxic]
    better = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert better > 0.85
    assert sum(r.predicted for r in out if not r.toxic) <= 0.03 * len(clean)
    assert docs.count() == toxicity.op2_toxicity(spark, big).count()


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(k, 1, int(k % 2)) for k in range(0, 60)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, toxicity.remainder(F.col("doc_id"), 3) != 1)
    out = toxicity.toxicity(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    assert {r.doc_id for r in out if r.held_out} == {k for k in by if zlib.crc32(str(k if k is not None else "").encode()) % 3 == 1}
    assert toxicity.toxicity(nothing, model).count() == 0
    unlabelled = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.toxicity(docs, unlabelled).collect()} == {toxicity.scores([""], *unlabelled)[0]}


def test_ids_with_different_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", {1: 9, 0: 9}, F.lit(True)).collect()
    assert sorted((r.label, r.text) for r in sample) == [(0, "text 2"), (1, "text 1")]


def test_features_are_distinct_grams():
    places, edges = toxicity.features(["aaaa aaaa", "", "ab", "xyz xyz"])
    assert edges[0] == 0 and edges[1] - edges[0] > 0 and edges[2] == edges[1] < edges[3]
    assert len(set(places[: edges[1]].tolist())) == edges[1]


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    out = quality_classifier.op10_quality_classifier(spark, big).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.95 * len(out)


def test_quality_rules_compile_to_the_same_score(docs, nothing):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((300, len(quality_classifier.NAMES)))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    model = quality_classifier.fitted(x, y)
    assert np.mean((model.logit(x) > 0) == (y > 0)) > 0.95
    stats = quality_classifier.with_statistics(docs.select("doc_id", "text")).select(*quality_classifier.NAMES, model.score().alias("score")).collect()
    data = np.array([tuple(r) for r in stats], float)
    assert np.allclose(1 / (1 + np.exp(-model.logit(data[:, :-1]))), data[:, -1])
    assert quality_classifier.quality(nothing, model).count() == 0


# 3 ------------------------------------------------------------------------


def test_sharding(docs, rows, nothing):
    out = sharding.shard_by_bytes(docs, shards=6).collect()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 8
    total, largest = sum(size(r.text) for r in out), max(size(r.text) for r in out)
    loads = {}
    for r in out:
        loads.setdefault(r.shard, []).append(r)
    assert set(loads) <= set(range(6))
    for own in loads.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    # each splitter is as near to its target as whole rows allow
    before = 0
    for k in range(5):
        before += sum(size(r.text) for r in loads.get(k, []))
        assert abs(before - total * (k + 1) / 6) <= largest / 2 + sharding.TOLERANCE * total / 6 + 200
    assert sharding.shard_by_bytes(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs.withColumn("shard", F.lit(1)))


def test_sharding_cuts_a_hot_text(spark):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k}") for k in range(3000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).groupBy("shard").agg(F.sum(F.octet_length("text") + 8).alias("n")).collect()
    loads = [r.n for r in out]
    assert len(loads) == 24 and max(loads) - min(loads) <= 64


def test_sharding_in_small_cells_and_with_clashing_names(spark):
    rows = [(k if k % 7 else None, "hot text" if k % 3 == 0 else f"text {k % 50}", k, 1, 2, 3, 4) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h int, _e int, _row int, slot int, _Shard int").repartition(3)
    out = sharding.shard_by_bytes(df, shards=5, replace=True, cell_rows=20)
    assert out.columns == ["doc_id", "text", "_h", "_e", "_row", "_Shard", "shard", "slot"]
    slots = {}
    for r in out.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(5)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert [sharding.cell_bits(n, 100) for n in (0, 100, 1600, 1601, 10**9)] == [4, 4, 4, 5, 16]


def test_op3_columns(spark, sf_dir):
    out = sharding.op3_sharding(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(out) == len(docs)
    for r in out:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()), "bytes", None)


# 4 ------------------------------------------------------------------------


def statistics_by_force(text):
    words = (text or "").encode().split()
    decoded = [w.decode() for w in words]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return len(words), sum(map(len, decoded)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark):
    rng = random.Random(4)
    texts = [sentence(rng, rng.randrange(80), 6) for _ in range(60)] + ["x\ny\n\nx\n x\nx", "#*$ <a> |&%", "a a a", "a a a a", "é ß z", None, "", " \n"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    w = quality_rules.words_of(F.col("text"))
    out = df.select("doc_id", F.size(w), quality_rules.word_chars(w), quality_rules.n_symbols(F.col("text")), quality_rules.n_dup_lines(F.col("text")), quality_rules.n_repeat_words(w)).collect()
    for r in out:
        assert tuple(r)[1:] == statistics_by_force(texts[r.doc_id]), texts[r.doc_id]


def test_cascade_order_never_changes_the_verdict(docs, nothing):
    rules = quality_rules.default_rules()
    kept = quality_rules.quality_rules(docs, rules)
    assert kept.columns == docs.columns
    other = quality_rules.with_words(docs).where(quality_rules.verdict(rules[::-1], F.col("text"), F.col("_q_words")).isNull())
    assert sorted(r.shared for r in kept.collect()) == sorted(r.shared for r in other.collect())
    assert quality_rules.quality_rules(nothing).count() == 0
    ordered, estimates = quality_rules.plan(docs, rules)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules)
    assert [e.rank for e in estimates] == sorted((e.rank for e in estimates), reverse=True)


def test_cascade_sample_is_read_from_few_files(spark, tmp_path):
    """Any number of files, odd names and clashing columns; the sample holds rows of the table only."""
    path = str(tmp_path / "a b.parquet")
    df = spark.createDataFrame([(k, f"text number {k} " * 30, "x") for k in range(300)], "doc_id long, text string, _q_words string")
    df.repartition(12).write.parquet(path)
    own = spark.read.parquet(path)
    sample = quality_rules.sampled(own, sample_rows=50)
    texts = {r._q_text for r in sample.collect()}
    assert texts and texts <= {r.text for r in df.collect()}
    assert quality_rules.quality_rules(own).columns == own.columns


# 5 ------------------------------------------------------------------------


def test_mixing(docs, rows, nothing):
    out = mixing.weighted(docs)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r._m_weight <= 1 for r in got)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(nothing).count() == 0
    assert {r._m_weight for r in got if r._m_mass} != {mixing.KEEP}
    frames = {(r._m_source, r._m_lang, r._m_topic): r._m_weight for r in mixing.weighted(docs, most_cells=0).collect()}
    for r in got:
        assert abs(frames[r._m_source, r._m_lang, r._m_topic] - r._m_weight) < 1e-6


def test_raking_meets_feasible_targets():
    cells = [(s, lang, t, 100.0 + 50 * (s == "a") + 20 * (lang == "x") + 10 * (t == "q")) for s in "abc" for lang in "xy" for t in "pq"]
    targets = {"source": {"a": 0.3, "b": 0.3, "c": 0.4}, "lang": {"x": 0.45, "y": 0.55}, "topic": {"p": 0.5, "q": 0.5}}
    w = mixing.raked(cells, 0.5, targets)
    total = sum(c[3] for c in cells)
    for k, d in enumerate(mixing.DIMENSIONS):
        for value, share in targets[d].items():
            assert abs(sum(x * c[3] for x, c in zip(w, cells) if c[k] == value) - share * 0.5 * total) < 1e-2 * total


def test_sampling_follows_the_weights(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 15000, "big").otherwise("small").alias("source"))
    kept = mixing.mix(df, targets={"source": {"big": 0.5, "small": 0.5}}).groupBy("source").count().collect()
    counts = {r.source: r["count"] for r in kept}
    assert abs(counts["big"] - 5000) < 300 and counts["small"] == 5000


def test_mixing_with_clashing_names(spark, rows):
    names = ["_s", "_l", "_t", "_m_mass", "_salt", "_m_kept"]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], SCHEMA + "".join(f", {n} int" for n in names)).repartition(3)
    plain = spark.createDataFrame(rows, SCHEMA)
    for most in (mixing.MOST_CELLS, 0):
        kept = mixing.weighted(df, most_cells=most).where("__m_kept").select(*df.columns)
        assert sorted((r.shared for r in kept.collect()), key=repr) == sorted((r.shared for r in mixing.mix(plain).collect()), key=repr)
    assert mixing.mix(df).columns == df.columns


def test_shortfalls_of_targets_that_cannot_be_met(spark):
    rows = [(k, "some words here", "en", "big" if k else "small", 0, 0) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.dimension, r.value): r for r in mixing.shortfalls(df, targets={"source": {"big": 0.5, "small": 0.5}}).collect()}
    assert got["source", "small"].target == 0.5 and got["source", "small"].reached < 0.1
    assert abs(got["lang", "en"].reached - 1) < 1e-9


# 6 ------------------------------------------------------------------------


def test_permutations():
    for n in (1, 2, 3, 10, 97, 1000):
        p = pii.Permutation(b"key", n, "t")
        values = [p(k) for k in range(n)]
        assert sorted(values) == list(range(n)) and (n == 1 or all(a != b for a, b in enumerate(values)))


def test_surrogates(spark, nothing):
    texts = [
        "Write to Jane.Doe+x@Mail7.example.com or +1 (017) 555-7713, not 555.",
        "jane.doe+x@mail7.example.com and 10.1.2.3 and 4111 1111 1111 1111",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" DE89 3704 0044 0532 0130 00',
        "Mrs. Anna Schmidt met Mr. John Miller; Mrs. Anna Schmidt left.",
        "A clean text, with 12 numbers 3.14 and 2024-01-01.",
        None,
        "",
    ]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, entities int")
    out = pii.surrogate_texts(df)
    got = {r.doc_id: r for r in out.collect()}
    assert got[4].text == texts[4] and got[5].text is None and got[6].text == ""
    for k in range(4):
        for e in got[k].entities:
            assert e.value not in got[k].text and e.surrogate in got[k].text
            assert [c.isdigit() for c in e.value] == [c.isdigit() for c in e.surrogate] or e.kind in ("secret", "ip", "name")
    assert got[0].n_entities == 2 and got[1].n_entities == 3 and got[2].n_entities == 2 and got[3].n_entities == 3
    a, b = got[0].entities[0].surrogate, got[1].entities[0].surrogate
    assert a.lower() == b and a.endswith(".com")
    names = [e.surrogate for e in got[3].entities]
    assert names[0] == names[2] and names[0].split()[0] in pii.GIVEN["f"] and names[1].split()[0] in pii.GIVEN["m"]
    card = got[1].entities[2].surrogate.replace(" ", "")
    assert pii._check_digit(card[:-1]) == int(card[-1])
    assert pii.collisions(out).count() == 0
    assert pii.surrogate_texts(nothing).count() == 0


def test_surrogates_in_other_scripts_and_later_mentions(spark):
    texts = [
        "Mr. 王伟明 came, 王伟明 left", "Mme بنعلي", "call +٢١٢ ٦٦١ ٢٣٤ ٥٦٧ now", "Mr. Łukasz Řehoř",
        "Mr. John Miller came. Miller said so, and Miller's dog too; John Miller left.",
        "Mr. O'Brien and Ms. Smith-Jones, said O'Brien", "Mrs. Smith's house", "Dear Sir and friends, you and I",
    ]
    out = pii.surrogate_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    got = {r.doc_id: r for r in out.collect()}
    for word in ("王", "بنعلي", "٢٣٤", "Łukasz", "Řehoř", "Miller", "O'Brien", "Smith", "Jones"):
        assert not any(word in r.text for r in got.values()), word
    assert [got[k].n_entities for k in range(8)] == [2, 1, 1, 1, 4, 3, 1, 1]
    assert got[6].text.endswith("'s house") and got[7].text.endswith("friends, you and I")
    name = got[0].entities[0].surrogate
    assert got[0].text == f"Mr. {name} came, {name} left" and all("一" <= ch <= "鿿" for ch in name)
    assert pii.collisions(out).count() == 0


def test_words_of_names_are_mapped_one_to_one():
    own = pii.Surrogates("key")
    names = [x for known in pii.GIVEN.values() for x in known]
    words = names + ["".join(x) for x in ("Ezqa", "Ejta", "Umma", "Abca", "Idka")] + [a + b + c + d for a in "EIO" for b in "bcd" for c in "fgh" for d in "aeo"]
    made = [own.of("name", w) for w in words]
    assert len(set(made)) == len(set(words)) and all(a != b for a, b in zip(words, made))
    for known in pii.GIVEN.values():
        assert {own.of("name", w) for w in known} == set(known)
    full = own.of("name", "Anna Schmidt").split(" ")
    assert full == [own.of("name", "Anna"), own.of("name", "Schmidt")]
    assert pii.collided([("name", "a", "x"), ("name", "b", "x"), ("name", "a", "x")]) == 1
    assert pii.collided([("name", "a", "x"), ("name", "a", "y"), ("ip", "b", "x")]) == 1


def test_long_secrets_and_many_entities():
    import time

    own = pii.Surrogates("key")
    for n in (32, 128, 160, 5000):
        secret = "0123456789abcdef" * (n // 16)
        text, made = pii.replaced(f"key={secret}.", own)
        assert len(made) == 1 and secret not in text and len(text) == len(secret) + 5
    many = " ".join(f"u{k}@h{k % 7}.org and Mr. Ab{'abcdefghij'[k % 10]}c Xy{chr(97 + k // 10 % 26)}z" for k in range(6000))
    began = time.perf_counter()
    text, made = pii.replaced(many, own)
    assert len(made) >= 12000 and time.perf_counter() - began < 30


def test_the_key_is_the_sessions(spark):
    df = spark.createDataFrame([(1, "mail jane.doe@mail.org")], "doc_id long, text string")
    with pytest.warns(UserWarning):
        plain = pii.surrogate_texts(df).collect()[0].text
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert pii.surrogate_texts(df).collect()[0].text == pii.surrogate_texts(df, key="another").collect()[0].text != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_surrogates_are_distinct(spark):
    rng = random.Random(9)
    texts = [f"call +1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10000):04d} or mail u{k}@h{k % 7}.org from 10.{k % 250}.3.{k // 250}" for k in range(2000)]
    out = pii.surrogate_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert pii.collisions(out).count() == 0


# 7 ------------------------------------------------------------------------


def test_decontamination(spark, docs, nothing):
    rng = random.Random(6)
    items = [sentence(rng, n, 10**6) for n in (3, 11, 14, 30, 50)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {}
    for k, item in enumerate(items[:5]):
        words = item.split()
        texts[k] = sentence(rng, 40) + " " + item + " " + sentence(rng, 40)
        changed = list(words)
        if len(words) > 12:
            changed[5] = "other"
            changed[-3] = "another"
            texts[10 + k] = sentence(rng, 20) + "\n" + " ".join(changed).upper()
        texts[20 + k] = " ".join(words[::-1]) + " " + sentence(rng, 30)
    texts[30] = sentence(rng, 200)
    df = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(None, items[4], 1), (None, None, 2)], "doc_id long, text string, item_id int")
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminations(df, bench).collect()}
    expected = {(k, k) for k in range(5)} | {(12, 2), (13, 3), (14, 4), (None, 4)}
    assert found == expected
    parts = {(r.doc_id, r.item_id) for r in decontamination.contaminations(df, bench, most_words=10).collect()}
    assert parts == expected
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([20, 21, 22, 23, 24, 30, None], key=repr)
    assert decontamination.contaminations(nothing, bench).count() == 0
    assert decontamination.contaminations(docs, bench.limit(0)).count() == 0


def found_by_force(text, items):
    """Items that some offset finds, comparing all words at all offsets."""
    found, words = set(), text.split()
    for item, own in enumerate(x.split() for x in items):
        width = min(decontamination.STRETCH, len(own))
        for offset in range(-len(own), len(words) + 1):
            first, last = max(0, offset), min(len(words), offset + len(own))
            equal = [words[k] == own[k - offset] for k in range(first, last)]
            if any(sum(equal[k : k + width]) >= decontamination.SHARE * width for k in range(len(equal) - width + 1)):
                found.add(item)
                break
    return found


def test_no_tolerated_substitution_is_missed():
    rng = random.Random(7)
    items = [sentence(rng, n, 10**6) for n in (*range(1, 21), 40, 60, 200)]
    index = decontamination.index_of(list(range(len(items))), [x.encode() for x in items]).as_dict()
    texts = []
    for own in (x.split() for x in items):
        n = len(own)
        spots = [{k for k in range(n) if k % 5 == phase} for phase in range(5)]
        spots += [{k for k in range(n) if rng.random() < 0.2} for _ in range(20)]
        if n <= 14:
            spots += [{a, b} for a in range(n) for b in range(a + 1)]
        for out in spots:
            changed = [f"x{k}" if k in out else w for k, w in enumerate(own)]
            texts.append(" ".join([sentence(rng, rng.randrange(4)), *changed, sentence(rng, rng.randrange(4))]))
    got = [{x[0] for x in decontamination.found_in(w, index)} for w in decontamination.words_in([t.encode() for t in texts])]
    assert got == [found_by_force(t, items) for t in texts]


# 8 ------------------------------------------------------------------------


def test_token_counts(spark, docs, rows, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(token_counts.tokenizer_path())
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'l", "'ll", " ", "  ", "\n", "\t", " ", "　", "a", "Z", "é", "1", "½", "!", "...", "中文", "😀", "<|endoftext|>", "<|end", " the", "\x00", "''", "aaaaaaaa", "    "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30, 700, 1500]))) for _ in range(400)]
    with open(token_counts.tokenizer_path(), encoding="utf-8") as file:
        counter = token_counts.Counter(file.read())
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.counts(texts) == expected
    got = as_rows(token_counts.token_counts(docs))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert got == sorted(((r[0], len((r[1] or "").encode()), count(r[1] or "")) for r in rows), key=repr)
    assert token_counts.token_counts(nothing).count() == 0


def test_token_states_are_finite():
    with open(token_counts.tokenizer_path(), encoding="utf-8") as file:
        merges = token_counts.Counter(file.read()).merges
    before = len(merges.places)
    merges.count("ab" * 40_000)
    assert len(merges.places) - before < 2000


# 9 ------------------------------------------------------------------------


def dedup_by_force(rows):
    docs = sorted({(2**63 - 1 if r[0] is None else r[0], hash(r[1] or ""), r[1] or "") for r in rows})
    seen, out = set(), {}
    for doc, version, text in docs:
        w = text.encode().split()
        cover, fresh = [False] * len(w), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            if window in seen or window in fresh:
                cover[k : k + 20] = [True] * 20
            fresh.add(window)
        seen |= fresh
        kept = b" ".join(x for x, c in zip(w, cover) if not c)
        out[doc, text] = (len(w), sum(cover), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("block,hot,cut", [(50, 1000, 10**5), (10**6, 1000, 10**5), (50, 1, 10), (10**6, 1, 1)])
def test_substring_dedup(docs, rows, nothing, monkeypatch, block, hot, cut):
    """Also where every anchor is hot, and where buckets are extended in small slices."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "SLICE", cut)
    force = dedup_by_force(rows)
    got = as_rows(substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    last = lambda d: 2**63 - 1 if d is None else d
    assert got == sorted(((r[0], *force[last(r[0]), r[1] or ""]) for r in rows), key=repr)
    assert substring_dedup.substring_dedup(nothing).count() == 0


def test_extension_splits_groups_where_words_differ():
    """Windows of one anchor that agree on one side only, on both, or that end at a text's edge."""
    import numpy as np

    rng = random.Random(8)
    texts = []
    for _ in range(60):
        words = [f"c{k}" for k in range(40)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(40)] = f"x{rng.randrange(2)}"
        a = rng.randrange(15)
        texts.append(" ".join(words[a : a + 20 + rng.randrange(20)]).encode())
    force = dedup_by_force([(k, t.decode()) for k, t in enumerate(texts)])
    block = substring_dedup.Block()
    for k, words in enumerate(substring_dedup.word_hashes(texts)):
        block.add(k, 0, words, np.arange(len(substring_dedup.seeds(words)[0])))
    found = {doc: spans for _, blob, doc, _, spans in block.settle(np.empty(0, np.uint64), 4) if blob is None}
    for k, t in enumerate(texts):
        cover = substring_dedup.covered_words(len(t.split()), found.get(k, b""))
        assert int(cover.sum()) == force[k, t.decode()][1]


def test_anchors_are_the_rightmost_least():
    import numpy as np

    x = np.array([5, 3, 3, 9, 1, 1, 7, 8, 2], np.uint64)
    for width in (1, 2, 3, 4, 7, 9):
        expected = [max(range(k, k + width), key=lambda j: (-int(x[j]), j)) for k in range(len(x) - width + 1)]
        assert substring_dedup.anchors(x, width).tolist() == expected
