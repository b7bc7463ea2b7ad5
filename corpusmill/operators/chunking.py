"""Chunking: word windows and heading ancestry in built-in functions; Markdown blocks with a Python helper.

Every operator is a narrow transformation of its input rows, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.text import let, words

CHUNKER_VERSION = "chunker:1.0"


def windows(n: Column, window: int = 220, overlap: int = 40, least_tail: int = 80) -> Column:
    """Half-open word ranges [start, end) that cover ``n`` words, as an array of structs.

    Steps of ``window - overlap`` words (1 at least) until the end is reached; a last
    range of fewer than ``least_tail`` words joins the one before. No words: no range.
    """
    step = max(1, window - overlap)
    many = F.when(n <= 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / F.lit(step)).cast("int") + 1)
    joined = ((many > 1) & (n - (many - 1) * step < least_tail)).cast("int")
    last = many - joined - 1
    ranges = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * step).cast("int").alias("start"), F.when(i == last, n).otherwise(i * step + window).cast("int").alias("end")))
    return F.when(last >= 0, ranges).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def slice_words(split: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(split, start + 1, end - start), " ")


def chunk_prose(docs: DataFrame, text_col: str = "raw_text", window: int = 220, overlap: int = 40, least_tail: int = 80) -> DataFrame:
    """``docs`` without its text, times chunks: chunk_index, chunk_start_word, chunk_end_word, text.

    A null or blank text has no chunk.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    split = docs.select(*rest, words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("~words"))
    ranged = split.select("*", F.posexplode(windows(F.size("~words"), window, overlap, least_tail)).alias("chunk_index", "~range"))
    start, end = F.col("~range.start"), F.col("~range.end")
    return ranged.select(*rest, "chunk_index", start.alias("chunk_start_word"), end.alias("chunk_end_word"), slice_words(F.col("~words"), start, end).alias("text"))


def chunk_pages(docs: DataFrame, pages_col: str = "page_texts", window: int = 220, overlap: int = 40, least_tail: int = 80) -> DataFrame:
    """Windows of each page; word offsets and chunk numbers run on over the pages. Adds pdf_page.

    Pages without words have no chunk; null pages count as empty.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != pages_col]
    split = docs.select(*rest, F.transform(F.col(f"`{pages_col}`"), lambda p: words(F.coalesce(p, F.lit("")))).alias("~pages"))
    sizes = F.transform("~pages", lambda p: F.size(p))
    starts = F.aggregate(sizes, F.array(F.lit(0)), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))
    ranges = F.flatten(
        F.transform(
            "~pages",
            lambda p, i: F.transform(
                windows(F.size(p), window, overlap, least_tail),
                lambda r: F.struct(i.alias("page"), (F.get(F.col("~starts"), i) + r["start"]).alias("start"), (F.get(F.col("~starts"), i) + r["end"]).alias("end"), slice_words(p, r["start"], r["end"]).alias("text")),
            ),
        )
    )
    out = split.withColumn("~starts", starts).select(*rest, F.posexplode(ranges).alias("chunk_index", "~r"))
    return out.select(*rest, "chunk_index", F.col("~r.page").alias("pdf_page"), F.col("~r.start").alias("chunk_start_word"), F.col("~r.end").alias("chunk_end_word"), F.col("~r.text").alias("text"))


def blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """(kind, level, text) of a Markdown text's top blocks, see :mod:`..functions.markdown`."""
    for b in markdown.blocks(text):
        yield b.kind, b.level, b.text


def with_blocks(docs: DataFrame, text_col: str = "raw_text", out: str = "~blocks") -> DataFrame:
    """``docs`` with its text's blocks: kind, level, text, words, and the lines they come from. Null: none."""
    text_at = docs.columns.index(text_col)
    piece = {"kind": pa.string(), "level": pa.int32(), "text": pa.string(), "words": pa.int32(), "first_line": pa.int32(), "last_line": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                made = [list(markdown.blocks(t or "")) for t in some.column(text_at).to_pylist()]
                flat = [(b.kind, b.level, b.text, len(b.text.split()), b.first, b.last) for m in made for b in m]
                told = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate(piece.values())], list(piece))
                ends = pa.array(list(accumulate(map(len, made), initial=0)), pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(ends, told)], [*some.schema.names, out])

    kinds = "".join(f"`{c}` {t}, " for c, t in docs.dtypes)
    return docs.mapInArrow(run, kinds + f"`{out}` array<struct<kind:string,level:int,text:string,words:int,first_line:int,last_line:int>>")


def heading_path(path: Column) -> Column:
    """The headings above, outermost first; none: null."""
    return F.when(F.size(path) > 0, F.array_join(F.transform(path, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"])), " | "))


def gathered(found: Column, window: int) -> Column:
    """The chunks of an array of blocks, before windows: text, path, at (its first word), whole (never cut).

    A fold over the blocks. Its state is the headings above, the word count so far, and the
    prose gathered since the last heading, code or table, which is put out when the next block would
    not fit a window. A heading counts its mark as a word.
    """
    heading = "struct<level:int,text:string>"
    piece = "struct<text:string,path:string,at:int,whole:boolean>"
    none = lambda kind: F.array().cast(f"array<{kind}>")
    start = F.struct(none(heading).alias("path"), F.lit(0).alias("at"), none("string").alias("prose"), F.lit(0).alias("size"), F.lit(0).alias("since"), none(piece).alias("out"))

    def state(path: Column, at: Column, prose: Column, size: Column, since: Column, out: Column) -> Column:
        return F.struct(path.alias("path"), at.cast("int").alias("at"), prose.alias("prose"), size.cast("int").alias("size"), since.cast("int").alias("since"), out.cast(f"array<{piece}>").alias("out"))

    def made(text: Column, s: Column, at: Column, whole: bool) -> Column:
        return F.array(F.struct(text.alias("text"), heading_path(s["path"]).alias("path"), at.alias("at"), F.lit(whole).alias("whole")).cast(piece))

    def put_out(s: Column) -> Column:
        """What is out, with the gathered prose."""
        return F.when(F.size(s["prose"]) > 0, F.concat(s["out"], made(F.array_join(s["prose"], " "), s, s["since"], False))).otherwise(s["out"])

    def step(s: Column, b: Column) -> Column:
        above = F.filter(s["path"], lambda h: h["level"] < b["level"])
        headed = state(F.concat(above, F.array(F.struct(b["level"].alias("level"), b["text"].alias("text")))), s["at"] + b["words"] + 1, none("string"), F.lit(0), F.lit(0), put_out(s))
        alone = state(s["path"], s["at"] + b["words"], none("string"), F.lit(0), F.lit(0), F.concat(put_out(s), made(b["text"], s, s["at"], True)))
        full = (s["size"] > 0) & (s["size"] + b["words"] > window)
        fresh = state(s["path"], s["at"] + b["words"], F.array(b["text"]), b["words"], s["at"], put_out(s))
        more = state(s["path"], s["at"] + b["words"], F.concat(s["prose"], F.array(b["text"])), s["size"] + b["words"], s["since"], s["out"])
        said = F.when(b["words"] == 0, s).when(full | (s["size"] == 0), fresh).otherwise(more)
        return F.when(b["kind"] == "heading", headed).when(b["kind"].isin("code", "table"), alone).otherwise(said)

    return F.aggregate(found, start, step, put_out)


def chunk_markdown(docs: DataFrame, text_col: str = "raw_text", window: int = 220, overlap: int = 40, least_tail: int = 80) -> DataFrame:
    """Chunks by blocks, with heading_path. Code and tables are never cut. No block but headings, yet words: prose windows."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = F.array(F.struct(text.alias("text"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("at"), F.lit(False).alias("whole")))
    found = with_blocks(docs, text_col).withColumn("~found", gathered(F.col("~blocks"), window))
    pieces = found.select(*rest, F.when(F.size("~found") > 0, F.col("~found")).otherwise(plain).alias("~pieces"))

    def cut(p: Column) -> Column:
        return let(words(p["text"]), lambda split: cut_words(p, split))

    def cut_words(p: Column, split: Column) -> Column:
        whole = F.array(F.struct(p["at"].alias("start"), (p["at"] + F.size(split)).alias("end"), p["path"].alias("path"), p["text"].alias("text")))
        ranged = F.transform(windows(F.size(split), window, overlap, least_tail), lambda r: F.struct((p["at"] + r["start"]).alias("start"), (p["at"] + r["end"]).alias("end"), p["path"].alias("path"), slice_words(split, r["start"], r["end"]).alias("text")))
        return F.when(p["whole"], whole).otherwise(ranged)

    out = pieces.select(*rest, F.posexplode(F.flatten(F.transform("~pieces", cut))).alias("chunk_index", "~r"))
    return out.select(*rest, "chunk_index", F.col("~r.path").alias("heading_path"), F.col("~r.start").alias("chunk_start_word"), F.col("~r.end").alias("chunk_end_word"), F.col("~r.text").alias("text"))


def chunk_documents(docs: DataFrame, window: int = 220, overlap: int = 40, least_tail: int = 80) -> DataFrame:
    """Chunks of DOCUMENT rows by source type: blocks for markdown and docx, pages for pdf, windows for the rest.

    A pdf without page texts is one page.
    """
    slim = docs.select("source_id", "source_type", "document_id", "document_path", "document_sha256", "title", "producer", "loader_version", "raw_text", "page_texts")
    settings = {"window": window, "overlap": overlap, "least_tail": least_tail}
    by_block = F.coalesce(F.col("source_type").isin("markdown", "docx"), F.lit(False))
    paged = F.coalesce(F.col("source_type") == "pdf", F.lit(False))
    pages = F.when(F.size("page_texts") > 0, F.col("page_texts")).otherwise(F.array("raw_text"))
    none = F.lit(None).cast
    marked = chunk_markdown(slim.where(by_block).drop("page_texts"), **settings).withColumn("pdf_page", none("int"))
    paginated = chunk_pages(slim.where(paged).withColumn("page_texts", pages).drop("raw_text"), **settings).withColumn("heading_path", none("string"))
    prose = chunk_prose(slim.where(~by_block & ~paged).drop("page_texts"), **settings).withColumns({"pdf_page": none("int"), "heading_path": none("string")})
    return marked.unionByName(paginated).unionByName(prose).withColumn("chunker_version", F.lit(CHUNKER_VERSION))
