import __spark_entry__
from quarry.plans import registry


def test_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and registry.FLAGSHIP in queries
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_runs(spark, sf_dir):
    for name, query in registry.QUERIES.items():
        assert query(spark, sf_dir).columns, name


def test_nothing_else_needs_the_corpus_operators():
    import pathlib

    root = pathlib.Path(__spark_entry__.__file__).parent / "quarry"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quarry.llm" not in path.read_text() and "from .llm" not in path.read_text() and "..llm" not in path.read_text(), path
