"""Whole documents go to Python by few rows, not by Arrow batches of 10,000."""

from quarry.operators import chunking


def test_documents_are_sent_by_rows(spark):
    texts = ["Un paragraphe du document.\n\n" * 200, "court mais assez long pour rester utile dans un index de passages", None]
    df = spark.createDataFrame([(k, 0, "1", t) for k, t in enumerate(texts)], "doc_id long, page_seq int, page string, text string")
    found = chunking.chunks(df)
    assert {r["doc_id"] for r in found.collect()} == {0, 1}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
