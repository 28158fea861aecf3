import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.sources import readers
from quarry.streaming import streams


def docx(parts):
    body = "".join(
        f'<w:tbl><w:tr>{"".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in p)}</w:tr></w:tbl>'
        if isinstance(p, list)
        else f'<w:p>{"<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>" % (chr(34), chr(34)) if p.startswith("#") else ""}<w:r><w:t>{p.lstrip("#")}</w:t></w:r></w:p>'
        for p in parts
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def xlsx():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
        box.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        box.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c/></row></sheetData></worksheet>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("un\r\n\r\ndeux".encode("cp1252"))
    (tmp_path / "b.csv").write_text("x;y\n1; \n2;3\n")
    (tmp_path / "c.json").write_text('{"k":[1]}')
    (tmp_path / "d.docx").write_bytes(docx(["before", "#Title", "text", ["a", "b"]]))
    (tmp_path / "e.xlsx").write_bytes(xlsx())
    (tmp_path / "f.bin").write_bytes(b"x")
    found = readers.files(spark, str(tmp_path))
    assert found.count() == 5
    assert [(r.path[-5:], r.reason) for r in readers.rejected(spark, str(tmp_path)).collect()] == [("f.bin", "no reader for .bin")]
    got = {(r.path[-6:].split("/")[-1], r.page_seq): r.text for r in readers.page_entries(found).collect()}
    assert got[("a.txt", 0)] == "un\n\ndeux" and got[("b.csv", 0)] == "x | y\n1\n2 | 3" and '"k": [' in got[("c.json", 0)]
    assert got[("d.docx", 0)] == "before" and got[("d.docx", 1)] == "Title\ntext\na | b"
    assert got[("e.xlsx", 0)] == "[Sheet: One]\nname | 3"
    known = spark.createDataFrame([("a.txt",)], "source string")
    assert readers.not_indexed(found, known).count() == 4


def test_text_entries():
    parts = readers.entries_of_text("a" * 3000 + "\n\n" + "b" * 3000 + "\n\n" + "c" * 10000)
    assert [len(p) for p in parts] == [3000, 3000, 4500, 4500, 1000]
    assert readers.decoded(b"\xff\xfe\x81") == "\xff\xfe\x81"


def test_cached_pages(spark):
    cache = spark.createDataFrame([("f", "[Page 1]\none\n[Page 2]\ntwo — Page 2 — more"), ("g", "plain")], "filename string, content string")
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in readers.cached_pages(cache).collect()) == [("f", "1", "one"), ("f", "2", "two more"), ("g", "1", "plain")]


@pytest.mark.parametrize(("deltas", "shown"), [(["a<thi", "nk>x</th", "ink>b"], "ab"), (["a<think>x"], "a"), (["a < b", "<", "c"], "a < b<c"), (["<THINK>x</Think>y"], "y")])
def test_reasoning_is_stripped(spark, deltas, shown):
    held, inside, out = "", False, ""
    for d in deltas:
        text, held, inside = streams.feed(held, inside, d)
        out += text
    assert out + streams.flush(held, inside) == shown
    df = spark.createDataFrame([("s", k, d) for k, d in enumerate(deltas)], "stream_id string, seq int, delta string")
    assert streams.stripped_batch(df).collect()[0].text == shown


def test_stateful_stream(spark, tmp_path):
    rows = [("s", 0, "a<thi", False), ("s", 1, "nk>x</th", False), ("s", 2, "ink>b", True), ("t", 0, "z", True)]
    spark.createDataFrame(rows, "stream_id string, seq int, delta string, last boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("stream_id string, seq int, delta string, last boolean").parquet(str(tmp_path / "in"))
    query = streams.stripped_stream(source).writeStream.format("memory").queryName("stripped").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    # timers keep the query going, so it never counts as having processed all
    for _ in range(60):
        if spark.table("stripped").select("stream_id").distinct().count() == 2:
            break
        time.sleep(0.5)
    query.stop()
    got = {}
    for r in spark.table("stripped").orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {"s": "ab", "t": "z"}


def test_ingestion_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []

    def index(batch, number):
        seen.extend(r.text for r in readers.page_entries(batch).collect())

    for k in range(2):
        streams.ingest(spark, str(tmp_path / "in"), str(tmp_path / "ck"), index, once=True).awaitTermination(60)
        if not k:
            time.sleep(0.1)
            (tmp_path / "in" / "b.txt").write_text("two")
    assert sorted(seen) == ["one", "two"]


def test_windows_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    query = streams.tumbling(stream, "1 hour", late="3650 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = streams.tumbling(events, "1 hour")
    assert spark.table("tumbled").agg(F.sum("n")).collect() == batch.agg(F.sum("n")).collect()
