"""Queued documents dealt to workers."""

from quarry.operators import registry


def test_claims_are_disjoint(spark):
    rows = [(f"d{k}", "queued" if k % 3 else "indexed", k // 4) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, status string, created_at int").repartition(3)
    got = [tuple(r) for r in registry.claims(df, ["a", "b", "a"], 3).collect()]
    oldest = sorted((r for r in rows if r[1] == "queued"), key=lambda r: (r[2], r[0]))[:6]
    assert sorted(got) == sorted(("ab"[p % 2], r[0], p // 2) for p, r in enumerate(oldest))
    assert len({r[1] for r in got}) == 6
    assert registry.claims(df.where("status = 'indexed'"), ["a"]).count() == 0
