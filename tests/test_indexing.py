"""Indexing becomes visible as a whole or not at all."""

import pytest

from quarry.operators import access
from quarry.plans import engine, models

ME = access.Policy("u", "analyst", "A")
TEXT = "Objet : Acquisition de serveurs et de licences pour le siège.\n\nLa date limite de remise est fixée au 3 mai 2024. " + "Des mots sur le paiement. " * 10


@pytest.mark.parametrize("fails_at", ["chunks", "facts", "commits"])
def test_a_run_that_fails_leaves_nothing_and_loses_nothing(spark, tmp_path, monkeypatch, fails_at):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.txt").write_text(TEXT)
    (folder / "none.txt").write_text(" \n ")
    put, create = engine._put, spark.createDataFrame
    index = lambda: engine.index_folder(spark, str(folder), store, ME, models.hashing_embedder)

    def failing(rows, where, name, batch):
        if name == fails_at:
            raise RuntimeError("killed")
        put(rows, where, name, batch)

    def refusing(rows, schema=None, **more):
        if fails_at == "commits" and schema == "batch string, n_files long":
            raise RuntimeError("killed")
        return create(rows, schema, **more)

    monkeypatch.setattr(engine, "_put", failing)
    monkeypatch.setattr(spark, "createDataFrame", refusing)
    with pytest.raises(RuntimeError, match="killed"):
        index()
    assert all(engine.committed(spark, store, name) is None for name in ("files", "chunks", "facts"))
    monkeypatch.undo()
    assert index() == 2 and index() == 0
    chunks, known = engine.committed(spark, store, "chunks"), engine.committed(spark, store, "facts")
    assert chunks.count() == chunks.dropDuplicates(["id"]).count() > 0
    assert sorted(r["field"] for r in known.collect()) == sorted({r["field"] for r in known.collect()}) and known.count() >= 2
    (folder / "b.txt").write_text(TEXT.replace("serveurs", "jardins"))
    assert index() == 1 and {r["source"] for r in engine.committed(spark, store, "chunks").select("source").distinct().collect()} == {"a.txt", "b.txt"}
