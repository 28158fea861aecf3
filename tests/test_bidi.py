"""Visual order of lines."""

import random

from pyspark.sql import functions as F

from quarry.functions import bidi
from quarry.functions import text as T


def test_visual():
    # capital letters of the examples are Hebrew here: the first letter decides the line's direction
    he = lambda s: "".join(chr(0x5D0 + ord(c) - 65) if c.isupper() else c for c in s)
    for line, seen in [
        ("", ""), ("abc", "abc"), ("ABC", "CBA"), ("car is THE CAR in arabic", "car is RAC EHT in arabic"), ("THE CAR is red.", ".is red RAC EHT"),
        ("A 12 B", "B 12 A"), ("a A1,5 b", "a 1,5A b"), ("(A)", "(A)"), ("A (b) C", "C (b) A"), ("A 5% B", "B 5% A"), ("x AB ", "x BA "), ("AB ", " BA"), ("12", "12"), ("A-1", "1-A"),
    ]:
        assert bidi.visual(he(line)) == he(seen), line
    # behind Arabic letters digits are Arabic numbers: separators of European ones do not join them
    assert bidi.visual("ب 1+2") == "2+1 ب"
    assert bidi.visual("ب 12/05") == "12/05 ب"
    assert bidi.visual("ابت") == "تبا"


def test_runs_equal_brute_force():
    """With letters and blanks only: runs of one direction, each with the blanks inside it, are laid out in turn."""
    rng = random.Random(2)
    for _ in range(500):
        words = ["".join(rng.choice("abc" if latin else "ابت") for _ in range(rng.randrange(1, 4))) for latin in [rng.random() < 0.5 for _ in range(rng.randrange(1, 7))]]
        runs = []
        for w in words:
            if runs and runs[-1][0] == w.isascii():
                runs[-1][1].append(w)
            else:
                runs.append((w.isascii(), [w]))
        shown = [" ".join(ws) if latin else " ".join(ws)[::-1] for latin, ws in runs]
        expected = " ".join(shown if words[0].isascii() else shown[::-1])
        assert bidi.visual(" ".join(words)) == expected


def test_only_arabic_lines_are_turned(spark):
    texts = ["abc\nابت abc\n\nonly latin (x)\nمرحبا", "no arabic", "", None, "abcdefghijklmnop ا", "ا\n\nب\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    got = dict(df.select("k", bidi.visual_lines(F.col("t"))).collect())
    share = dict(df.select("k", F.transform(F.split("t", "\n", -1), T.arabic_ratio)).collect())
    for k, t in enumerate(texts):
        assert got[k] == (None if t is None else "\n".join(bidi.visual(x) if s > bidi.LEAST else x for x, s in zip(t.split("\n"), share[k])))
    assert got[4] == texts[4]
