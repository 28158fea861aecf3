"""Licence scan, filter audit and prefix trie against brute force on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import filter_audit, license_scan, prefix_trie
from quarry.llm.licence_templates import BASE_PHRASES, TEMPLATES

SPACES = "[\\x20\\x09-\\x0D]+"


def words(text):
    return [w for w in re.split(SPACES, text or "") if w]


def as_rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# 11 -----------------------------------------------------------------------


def licence_words(text):
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def places_of(phrase, own, need):
    """(offset, matching words) wherever enough words of a phrase stand at their places."""
    wanted = licence_words(phrase)
    out = []
    for o in range(-len(wanted) + 1, len(own)):
        n = sum(0 <= o + k < len(own) and own[o + k] == w for k, w in enumerate(wanted))
        if n >= need(len(wanted)):
            out.append((o, n))
    return out


def scanned_by_force(text):
    own = licence_words(text)
    whole, most = (lambda n: n), (lambda n: -(-80 * n // 100))
    found = {label: [o for o, _ in places_of(x, own, whole)] for x, label in BASE_PHRASES.items()}
    every = [o for x in found.values() for o in x]
    base = sorted(label for label, x in found.items() if x)
    labels, score = set(base), 1.0 if base else 0.0
    for t in TEMPLATES:
        matched = [max((n for _, n in places_of(x, own, most)), default=0) for x in t.passages]
        if any(matched) and all(places_of(x, own, whole) for x in t.phrases):
            labels.add(t.label)
            score = max(score, sum(matched) / sum(len(licence_words(x)) for x in t.passages))
    return len(own), len(every), min(every, default=None), max(every, default=None), ",".join(base), ",".join(sorted(labels)), round(score, 12)


SCAN = "doc_id n_words n_base first_word last_word base_labels labels score".split()


def licence_texts(seed=4):
    rng = random.Random(seed)
    common = "the of and a software license in to you copy is copyright".split()
    out = [None, "", " \n\t", "MIT", "mit license", "The MIT-License, then the mit license", "mit\x85license", "MİT license", "Apache\nLicense General Public License"]
    for t in TEMPLATES:
        for passage in t.passages:
            for share in (0, 0.1, 0.2, 0.3):
                w = passage.split()
                for k in rng.sample(range(len(w)), int(share * len(w))):
                    w[k] = rng.choice(common)
                noise = [rng.choice(common) for _ in range(rng.randrange(40))]
                out.append(" ".join([*noise, *w, *(t.phrases if rng.random() < 0.5 else ()), *noise]))
    whole = "\n\n".join(x for t in TEMPLATES for x in t.passages)
    out += [whole, "// " + whole.replace("\n", "\n// ").upper(), "the software " * 3000, " ".join(rng.choice(common) for _ in range(20000)), "the mit license " * 500]
    return out


def test_license_scan_equals_brute_force(spark):
    texts = licence_texts()
    rows = [(k if k % 7 else None, x, "s", k) for k, x in enumerate([*texts, *texts[3:8]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score int").repartition(3)
    expected = sorted(((k, *scanned_by_force(x)) for k, x, *_ in rows), key=repr)
    found = license_scan.license_scan(df).withColumn("score", F.round("score", 12))
    assert as_rows(found, SCAN) == expected
    assert any("bsd" in r[6] for r in expected) and any(r[6] == "" for r in expected)


def test_license_scan_of_nothing(spark):
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rank_of_words_changes_no_licence(spark):
    index, rng = license_scan.Index(), np.random.default_rng(1)
    ids = [index.looked_up(w) for w in license_scan.words_of([(x or "").encode() for x in licence_texts(9)])]
    have = index.present(ids)
    likely = have @ index.held >= index.need
    n = len(index.vocabulary)
    ranks = [np.arange(n), np.arange(n)[::-1], rng.permutation(n)]
    results = [[license_scan._scan_one(index, rank, *x) for x in zip(ids, have, likely)] for rank in ranks]
    assert results[0] == results[1] == results[2]


# 12 -----------------------------------------------------------------------

AUDIT = ["part", "filter_order", "step", *filter_audit.STEP_COLUMNS]


def audited_by_force(docs, labels):
    text = [r[1] or "" for r in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    order = [(i is None, i or 0) for i, *_ in docs]
    least = {}
    for t, o in zip(text, order):
        least[t] = min(o, least.get(t, o))
    fails = []
    for t, o in zip(text, order):
        w = words(t)
        capitals = sum("A" <= x <= "Z" for x in t)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * capitals > 5 * len(t), "D": any(x in "#$%&*|" for x in t), "E": o > least[t]})
    out = []
    for part in {r[2] or "" for r in docs}:
        own = [k for k, r in enumerate(docs) if (r[2] or "") == part]
        steps, shapley = [], Counter()
        for p in map("".join, permutations("ABCDE")):
            left = own
            for s, f in enumerate(p, 1):
                gone = [k for k in left if fails[k][f]]
                left_after = [k for k in left if not fails[k][f]]
                late = sum(fails[k][f] for k in own) - len(gone)
                only = sum(fails[k][f] and sum(fails[k].values()) == 1 for k in own)
                steps.append((p, s, len(left_after), len(gone), late, only, sum(docs[k][0] in good for k in gone), sum(docs[k][0] in toxic for k in gone)))
                shapley[f] += len(gone)
                left = left_after
        out += [(part, *x, shapley[x[0][x[1] - 1]]) for x in steps]
    return sorted(out, key=repr)


def audit_tables(seed=2):
    rng = random.Random(seed)
    texts = [None, "", "x", "#1", "ALL CAPITALS HERE"]
    texts += [" ".join(f"w{rng.randrange(m)}" for _ in range(rng.choice([10, 49, 50, 80]))) for m in (3, 40, 4000) for _ in range(6)]
    texts += [t + " | &" for t in texts[5:12]] + [(t or "").upper() for t in texts[8:14]] + ["\x0bw1\x0b" * 60, "v " * 5000]
    docs = [(k, rng.choice(texts), rng.choice(["hot", "hot", "a", None, ""])) for k in range(160)]
    docs += [docs[5], docs[5], (None, texts[9], "a"), (None, texts[9], "a"), (None, "only here", "hot"), (None, "only here", "b"), (7, texts[12], "a"), (-3, docs[8][1], "hot")]
    rng.shuffle(docs)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10_000, 1, 1)]
    return docs, labels


def test_filter_audit_equals_brute_force(spark):
    docs, labels = audit_tables()
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert as_rows(filter_audit.filter_audit(df, marks), AUDIT) == audited_by_force(docs, labels)


def test_filter_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    rows = filter_audit.filter_audit(one, marks).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and sum(r["removed"] for r in rows) == 120


def test_lattice_has_80_edges_and_600_steps(spark):
    counted = spark.createDataFrame([("p", 0, 1, 0, 0)], "part string, mask int, n long, good long, toxic long")
    edges = {(r["applied"], r["next"]) for r in filter_audit.edges(counted).collect()}
    steps = filter_audit.steps(spark).collect()
    assert len(edges) == 80 and len(steps) == 600 and {(r["applied"], r["next"]) for r in steps} == edges


# 13 -----------------------------------------------------------------------

NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_by_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(hashlib.sha256(role.encode()).digest() + hashlib.sha256(text.encode()).digest()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, digest, (role, text)))
    turns = {c: [x[3] for x in sorted(xs)] for c, xs in own.items()}
    built = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = turns.get(c - c % 20 if c >= 0 else c + -c % 20, [])
        built[c] = donor[:h] + x[h:]
    nodes = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(words(p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversation_rows(seed=3):
    rng = random.Random(seed)
    texts = ["hello there", "a  b\tc", "", None, "one", "what is it then", "long " * 400]
    rows = []
    for c in [*range(0, 90), -7, -20, -33, 400, 401, 419, 10**12]:
        if c % 11 == 4:
            continue  # some donors and borrowers are absent
        for turn in range(rng.randrange(1, 7)):
            same = rng.random() < 0.6
            rows.append((c, turn, "system" if same and not turn else rng.choice(["user", "assistant", None]), texts[turn % 3] if same else rng.choice(texts)))
    rows += [(c, turn, "user", f"turn {min(turn, 7)}") for c in (500, 501, 502, 520) for turn in range(30 + c % 3)]
    rows += [(600, None, "user", "null first"), (600, None, None, None), (600, 2, "b", "tie"), (600, 2, "b", "eit"), (600, 2, "a", "tie"), (600, -5, "a", "below")]
    rows += [rows[10], rows[10], (None, 1, "user", "nowhere"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [2, 3, 4096])
def test_prefix_trie_equals_brute_force(spark, span):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    assert as_rows(prefix_trie.prefix_trie(df, span), NODE) == trie_by_force(rows)


def test_prefix_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, 1, "user", "x")]
    assert prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).count() == 0


def test_members_of_one_node_in_pieces(spark):
    ids = list(range(-50, 9500, 1))
    last = spark.range(-50, 9500).select(F.col("id").alias("c"), F.lit(b"x").alias("digest")).repartition(5)
    last = last.unionByName(spark.createDataFrame([(5, bytearray(b"y"))], "c long, digest binary"))
    found = {bytes(r["digest"]): r["ends"] for r in prefix_trie.ends_of(last).collect()}
    joined = ",".join(map(str, ids))
    assert found == {b"x": hashlib.sha256(joined.encode()).hexdigest(), b"y": hashlib.sha256(b"5").hexdigest()}
