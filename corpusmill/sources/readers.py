"""Files to DOCUMENT rows: text and Markdown by built-in functions, Word and PDF with a helper for each file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import document_id, text_sha256
from ..functions.text import page_verdict, stem, title
from .routing import get_loader, register_loader, registered_source_types, resolve

PRODUCER = "corpusmill"
OLE = bytes.fromhex("D0CF11E0A1B11AE1")
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, content, source_type, sniffed, error) of files, by Spark's binary reader, which leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    found = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    return found.select("*", F.inline(F.array(resolve(F.col("path"), F.col("content")))))


def as_documents(files: DataFrame, kind: str, version: str, text: Column, name: Column, verdict: Column, pages: Column | None = None, error: Column | None = None) -> DataFrame:
    """Rows of DOCUMENT. A file that was only taken for text is of low confidence."""
    path = F.col("path")
    ok = F.when(F.col("sniffed") & (verdict == "ok"), F.lit("low_confidence")).otherwise(verdict)
    return files.select(
        path.alias("source_id"), F.lit(kind).alias("source_type"), document_id(path, path).alias("document_id"), path.alias("document_path"),
        text_sha256(text).alias("document_sha256"), name.alias("title"), F.lit(PRODUCER).alias("producer"), text.alias("raw_text"), ok.alias("loader_verdict"),
        F.lit(version).alias("loader_version"), (F.lit(None).cast("array<string>") if pages is None else pages).alias("page_texts"), (F.lit(None).cast("string") if error is None else error).alias("error"),
    )


def load_markdown(files: DataFrame) -> DataFrame:
    """UTF-8, else Latin-1; the title is the first heading, else the file's stem."""
    raw = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    decoded = files.withColumn("~text", text)
    return as_documents(decoded, "markdown", "text:1.0", F.col("~text"), title(F.col("~text"), F.col("path")), F.lit("ok"))


def heading_level(style_name: str, style_id: str) -> int:
    """1 to 6 for heading styles, 1 for titles, else 0; the id counts before the name."""
    for style in (style_id, style_name):
        if style.strip().lower() == "title":
            return 1
        if found := re.fullmatch(r"(?i)heading\s*([1-9])", style.strip()):
            return min(6, int(found[1]))
    return 0


def docx_markdown(data: bytes) -> str:
    """The body of a Word file as Markdown blocks in order. Raises BadZipFile, KeyError or ParseError."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = ElementTree.fromstring(z.read("word/styles.xml")) if "word/styles.xml" in z.namelist() else ElementTree.Element("none")
    names = {s.get(f"{W}styleId", ""): n.get(f"{W}val", "") for s in styles.iter(f"{W}style") if (n := s.find(f"{W}name")) is not None}

    def text(node: ElementTree.Element) -> str:
        marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{W}t" else marks.get(x.tag, "") for x in node.iter())

    def cell(node: ElementTree.Element) -> str:
        return "\n".join(map(text, node.iter(f"{W}p"))).replace("\n", " ").replace("|", "\\|").strip()

    out = []
    for block in body if body is not None else ():
        if block.tag == f"{W}p":
            style = block.find(f"{W}pPr/{W}pStyle")
            kind = "" if style is None else style.get(f"{W}val", "")
            level, line = heading_level(names.get(kind, ""), kind), text(block).strip()
            if line:
                out.append("#" * level + " " * bool(level) + line)
        elif block.tag == f"{W}tbl":
            rows = [[cell(c) for c in r.findall(f"{W}tc")] for r in block.findall(f"{W}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
    return "\n\n".join(out)


def load_docx(files: DataFrame) -> DataFrame:
    """Word files. An old binary or encrypted file is "encrypted"; one that cannot be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for data in batch.column(2).to_pylist():
                text, error = "", None
                if data[:8] != OLE:
                    try:
                        text = docx_markdown(data)
                    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError) as e:
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[:8] for d in batch.column(2).to_pylist()], pa.binary()), pa.array(texts), pa.array(errors, pa.string())], ["path", "sniffed", "head", "text", "error"])

    made = files.select("path", "sniffed", "content").mapInArrow(run, "path string, sniffed boolean, head binary, text string, error string")
    first = F.get(F.filter(F.split("text", "\n"), lambda x: x.startswith("#")), F.lit(0))
    name = F.coalesce(F.nullif(F.trim(F.regexp_replace(first, "^#+", "")), F.lit("")), stem(F.col("path")))
    full = F.length(F.regexp_replace("text", r"\s", "")) >= 20
    verdict = F.when(F.col("head") == F.lit(OLE), "encrypted").when(F.col("error").isNotNull(), "error").when(full, "ok").otherwise("low_confidence")
    return as_documents(made, "docx", "docx:1.0", F.col("text"), name, verdict, error=F.col("error"))


def pdf_pages(data: bytes) -> tuple[str | None, list[str] | None, str | None, bool]:
    """Title, page texts, error, encrypted. Needs the optional package pypdf."""
    try:
        import pypdf
    except ImportError:
        return None, None, "pypdf is not installed", False
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        if reader.is_encrypted:
            return None, None, None, True
        return reader.metadata.title if reader.metadata else None, [p.extract_text() or "" for p in reader.pages], None, False
    except Exception as e:  # the reader raises many kinds for broken files
        return None, None, f"{type(e).__name__}: {e}", False


def load_pdf(files: DataFrame) -> DataFrame:
    """PDF files: encrypted; scanned (next to no text, or unreadable); low_confidence; or ok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pdf_pages(d) for d in batch.column(2).to_pylist()]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["path", "sniffed", "name", "pages", "error", "encrypted"])

    made = files.select("path", "sniffed", "content").mapInArrow(run, "path string, sniffed boolean, name string, pages array<string>, error string, encrypted boolean")
    made = made.withColumn("~text", F.coalesce(F.array_join("pages", "\n\n"), F.lit("")))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), stem(F.col("path")))
    verdict = F.when(F.col("encrypted"), "encrypted").otherwise(page_verdict(F.col("~text")))
    return as_documents(made, "pdf", "pdf:1.0", F.col("~text"), name, verdict, F.col("pages"), F.col("error"))


for _kind, _loader in (("markdown", load_markdown), ("docx", load_docx), ("pdf", load_pdf)):
    register_loader(_kind, _loader, replace=True)


def read_documents(files: DataFrame) -> DataFrame:
    """DOCUMENT rows of files of every type that has a loader. Files without a type are left out."""
    return reduce(DataFrame.unionByName, (get_loader(k)(files.where(F.col("source_type") == k)) for k in registered_source_types()))


def override_source(docs: DataFrame, source_id: str, root: str | None = None) -> DataFrame:
    """``docs`` under a given source id. One path: the document's path is the source id. Many, below
    ``root``: the source id and the path from ``root`` on."""
    path = F.lit(source_id) if root is None else F.concat(F.lit(source_id.rstrip("/") + "/"), F.expr(f"substring(document_path, {len(root.rstrip('/')) + 2})"))
    moved = docs.withColumns({"source_id": F.lit(source_id), "document_path": path})
    return moved.withColumn("document_id", document_id(F.col("source_id"), F.col("document_path")))
