"""File sources: every reader gives page entries (path, page_seq, page, text, source_type).

Files are read through Spark, so any file system works; parsing runs where the
bytes are. Formats that need a library that is not installed raise ``ImportError``
in the task that meets such a file.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules

ENTRIES = "path string, page_seq int, page string, text string, source_type string"
SUFFIXES = (".pdf", ".txt", ".md", ".csv", ".json", ".docx", ".xlsx")
MOST_BYTES = 50 * 1024 * 1024


def _found(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return read.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, modificationTime, length, content, suffix, sha256) of the accepted kinds and size; ``rejected`` lists the others."""
    read = _found(spark, path)
    return read.where((F.col("length") <= MOST_BYTES) & F.col("suffix").isin(*SUFFIXES)).withColumn("sha256", F.sha2("content", 256))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """Files (path, length, reason) that ``files`` leaves out; their contents are not read."""
    reason = F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("no reader for "), "suffix")).when(F.col("length") > MOST_BYTES, F.lit(f"over {MOST_BYTES} bytes"))
    return _found(spark, path).select("path", "length", reason.alias("reason")).where(F.col("reason").isNotNull())


def decoded(data: bytes) -> str:
    """Text of bytes by the first encoding that fits; the last always does."""
    for encoding in ("utf-8-sig", "utf-8", "cp1252"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def json_text(text: str) -> str:
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2)
    except ValueError:
        return text


def csv_text(text: str) -> str:
    """Rows with their cells joined by bars; the dialect is told from the first characters."""
    try:
        dialect: object = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    rows = ([c.strip() for c in row if c.strip()] for row in csv.reader(io.StringIO(text), dialect))
    return "\n".join(" | ".join(r) for r in rows if r)


def entries_of_text(text: str, most: int = rules.PLAIN_ENTRY_CHARS) -> list[str]:
    """Paragraphs packed up to ``most`` characters."""
    out, held = [], ""
    for part in (p.strip() for p in re.split(r"\n\s*\n", re.sub(r"\r\n?", "\n", text))):
        if not part:
            continue
        joined = f"{held}\n\n{part}" if held else part
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        if len(part) <= most:
            held = part
        else:
            out += [piece for piece in (part[k : k + most].strip() for k in range(0, len(part), most)) if piece]
            held = ""
    return [*out, held] if held else out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_HEADING = re.compile(r"(?i)^(?:article|chapitre|section)\s+\d+")


def entries_of_docx(data: bytes) -> list[str]:
    """One entry for each heading and what follows it, in document order; tables flattened by rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        body = ElementTree.fromstring(box.read("word/document.xml")).find(f"{_W}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    blocks: list[list[str]] = [[]]
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            text = text_of(node)
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "").lower() if style is not None else ""
            if text and (name.startswith(("heading", "titre")) or _HEADING.match(text)):
                blocks.append([])
            if text:
                blocks[-1].append(text)
        elif node.tag == f"{_W}tbl":
            for row in node.iter(f"{_W}tr"):
                cells = [c for c in map(text_of, row.iter(f"{_W}tc")) if c]
                if cells:
                    blocks[-1].append(" | ".join(cells))
    return ["\n".join(b) for b in blocks if b]


def entries_of_xlsx(data: bytes) -> list[str]:
    """One entry for each sheet: its title and the non-empty cells of each row."""
    with zipfile.ZipFile(io.BytesIO(data)) as box:
        names = set(box.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(box.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        for k, title in enumerate(titles, 1):
            if f"xl/worksheets/sheet{k}.xml" not in names:
                continue
            lines = [f"[Sheet: {title}]"]
            for row in ElementTree.fromstring(box.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value = c.find(f"{_S}v")
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text or "")
                if any(x.strip() for x in cells):
                    lines.append(" | ".join(x.strip() for x in cells if x.strip()))
            out.append("\n".join(lines))
    return out


def entries_of_pdf(data: bytes) -> list[str]:
    import pypdf

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages]


def entries_of(suffix: str, data: bytes) -> list[str]:
    """The entries of one file by its suffix."""
    if suffix == ".docx":
        return entries_of_docx(data)
    if suffix == ".xlsx":
        return entries_of_xlsx(data)
    if suffix == ".pdf":
        return entries_of_pdf(data)
    text = decoded(data)
    if suffix == ".json":
        text = json_text(text)
    elif suffix == ".csv":
        text = csv_text(text)
    elif suffix not in (".txt", ".md"):
        raise ValueError(f"no reader for {suffix}")
    return entries_of_text(text)


def page_entries(found: DataFrame) -> DataFrame:
    """Files (path, suffix, content) -> page entries; numbered as they stand in the file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, k, str(k + 1), text, suffix[1:])
                for path, suffix, data in zip(batch["path"], batch["suffix"], batch["content"])
                for k, text in enumerate(entries_of(suffix, data))
            ]
            yield pd.DataFrame(rows, columns=["path", "page_seq", "page", "text", "source_type"])

    return found.select("path", "suffix", "content").mapInPandas(run, ENTRIES)


def not_indexed(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files whose name no chunk has as its source."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return found.withColumn("source", name).join(chunks.select("source").distinct(), "source", "left_anti")


def cached_pages(cache: DataFrame) -> DataFrame:
    """Cached texts (filename, content) with ``[Page N]`` lines -> (filename, page_seq, page, text); without lines one page."""
    marker = r"(?imU)^\s*\[Page\s+([^\]]+)\]\s*$"
    labels, pieces = F.regexp_extract_all("content", F.lit(marker), F.lit(1)), F.split("content", marker)
    marked = F.zip_with(labels, F.slice(pieces, F.lit(2), F.size(labels)), lambda p, t: F.struct(p.alias("page"), F.trim(F.regexp_replace(t, r"(?iU)\s*[-—]\s*Page\s+\d+\s*[-—]\s*", " "), F.lit(" \n\t\r")).alias("text")))
    own = F.when(F.size(labels) > 0, marked).otherwise(F.array(F.struct(F.lit("1").alias("page"), F.col("content").alias("text"))))
    return cache.select("filename", F.posexplode(own).alias("page_seq", "_p")).select("filename", "page_seq", "_p.page", "_p.text").where("text <> ''")


def fresh(cache: DataFrame, sources: DataFrame) -> DataFrame:
    """Cache rows (filename, cached_at, content) that are not older than their source and hold at least 40 characters."""
    joined = cache.join(sources.select("filename", F.col("modificationTime").alias("_m")), "filename")
    late = F.col("cached_at") + F.expr("INTERVAL 1 SECOND") >= F.col("_m")
    return joined.where(late & (F.char_length("content") >= 40)).drop("_m")
