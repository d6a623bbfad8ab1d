"""Segmentation of documents into pages, sections and chunks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEADING = r"(?m)^#{1,3}\s+(.+)$"
MAX_CHARS, OVERLAP, LEAST_CHARS, SECTION_CHARS = 2000, 250, 50, 6000
#: Characters of chunks that a task gathers before it passes them on.
HELD_CHARS = 1 << 20
_DANDA = re.compile("[।॥]")


def split_pages(docs: DataFrame, key: list[str], text: str = "text", sep: str = "\n---\n", first: int = 1) -> DataFrame:
    """(key, page, text): a text cut at sep, pages numbered from first."""
    cut = F.split(text, r"\Q" + sep + r"\E")
    return docs.select(*key, F.posexplode(cut).alias("pos", "text")).select(*key, (F.col("pos") + first).alias("page"), "text")


def carry_titles(pages: DataFrame, book: str, page: str = "page", heading: str = HEADING) -> DataFrame:
    """pages with section_title: the last heading on this page or an earlier one of the book."""
    found = F.regexp_extract_all("text", F.lit(heading), F.lit(1))
    own = F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))
    w = Window.partitionBy(book).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section_title", F.last(own, ignorenulls=True).over(w))


def sections(pages: DataFrame, book: str, page: str, line: Column, title: Column) -> DataFrame:
    """(book, section, title, page_start, page_end, text): rows of lines in page order, cut before each heading line.

    line: whether a row is a heading; title: its text. Rows before the first heading are section 0 without a title.
    """
    w = Window.partitionBy(book).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("section", F.sum(line.cast("int")).over(w)).withColumn("head", F.when(line, title))
    body = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col("text").alias("t"))))
    return marked.groupBy(book, "section").agg(
        F.max("head").alias("title"), F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_join(F.transform(body, lambda x: x["t"]), "\n").alias("text")
    )


def cut_point(text: str, most: int) -> int:
    """Where a buffer is cut: the last blank line, danda or sentence end past the middle, else the limit."""
    head, middle = text[:most], most // 2
    at = head.rfind("\n\n")
    if at > middle:
        return at
    dandas = [m.end() for m in _DANDA.finditer(head) if m.start() > middle]
    if dandas:
        return dandas[-1]
    at = head.rfind(". ")
    return at + 1 if at > middle else most


def first_cut(c: Column, most: int) -> Column:
    """cut_point as a column, for texts of at least most characters."""
    back = F.reverse(F.left(c, F.lit(most)))

    def last(mark: str) -> Column:  # 0-based position of the last occurrence, -1 without one
        found = F.instr(back, mark[::-1])
        return F.when(found > 0, F.least(F.length(c), F.lit(most)) - found - len(mark) + 1).otherwise(-1)

    danda = F.greatest(last("।"), last("॥"))
    blank, stop = last("\n\n"), last(". ")
    return F.when(blank > most // 2, blank).when(danda > most // 2, danda + 1).when(stop > most // 2, stop + 1).otherwise(most)


def windows(pages: Iterable[tuple[int, str]], most: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(page_start, page_end, text) of a section's pages: cut while the buffer is full, each cut keeping an overlap."""
    buffer, start, page = "", None, None
    for page, text in pages:
        start = page if start is None else start
        buffer = f"{buffer}\n\n{text}" if buffer else text
        while len(buffer) >= most:
            at = cut_point(buffer, most)
            yield start, page, buffer[:at]
            buffer, start = buffer[max(0, at - overlap) :].lstrip() if overlap else buffer[at:].lstrip(), page
    if buffer.strip() and page is not None:
        yield start, page, buffer


def window_chunks(sections: DataFrame, key: list[str], most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk, page_start, page_end, text) of sections (key, pages array<struct<page, text>>).

    A section's cuts depend on each other, sections do not, so this is one pass without a shuffle.
    """
    if not 0 <= overlap < most // 2:
        raise ValueError("overlap must be at least 0 and less than half of the chunk size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(batch: pa.RecordBatch, rows: list[tuple], at: list[int]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 4
            picked = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(key))]
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays(picked + made, [*key, "chunk", "page_start", "page_end", "text"])

        for batch in batches:
            rows, at, held = [], [], 0
            for i, section in enumerate(batch.column(len(key))):  # one section in Python at a time
                pages = ((p["page"], p["text"] or "") for p in section.as_py() or ())
                for n, (a, b, text) in enumerate(windows(pages, most, overlap)):
                    rows.append((n, a, b, text))
                    at.append(i)
                    held += len(text)
                    if held >= HELD_CHARS:
                        yield told(batch, rows, at)
                        rows, at, held = [], [], 0
            if rows:
                yield told(batch, rows, at)

    kinds = {f.name: f.dataType.simpleString() for f in sections.schema.fields}
    shape = F.transform("pages", lambda p: F.struct(p["page"].cast("int").alias("page"), p["text"].alias("text"))).alias("pages")
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", chunk int, page_start int, page_end int, text string"
    return sections.select(*key, shape).mapInArrow(run, schema)


def split_large(found: DataFrame, key: list[str], most: int = SECTION_CHARS) -> DataFrame:
    """Sections (key, page_start, page_end, text) as chunks: short ones as they are, long ones through the cutter."""
    short = found.where(F.length("text") <= most).select(*key, F.lit(0).alias("chunk"), "page_start", "page_end", "text")
    long = found.where(F.length("text") > most)
    pages = F.array(F.struct(F.col("page_start").alias("page"), "text")).alias("pages")
    cut = window_chunks(long.select(*key, pages), key, most, 0).drop("page_start", "page_end")
    return short.unionByName(cut.join(long.select(*key, "page_start", "page_end"), key).select(*short.columns))


def emit(chunks: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """chunks with trimmed text of at least `least` characters and its hash."""
    return chunks.withColumn("text", F.trim("text")).where(F.length("text") >= least).withColumn("text_hash", F.sha2("text", 256))


def pairing(inputs: DataFrame, outputs: DataFrame, key: str, book: str) -> DataFrame:
    """(key, book, inputs, outputs, error): how often each id went into a stage and came out of it, and what is wrong.

    error is null where both counts agree, else missing, doubled or foreign (an output without an input, whose book is
    not known). Null ids count like any other.
    """
    went = inputs.groupBy(F.col(key).alias("__k"), book).agg(F.count("*").alias("inputs"))
    came = outputs.groupBy(key).agg(F.count("*").alias("outputs"))
    both = went.join(came, F.col("__k").eqNullSafe(F.col(key)), "full")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("inputs", "outputs")}
    error = F.when(n["inputs"] == 0, "foreign").when(n["outputs"] > n["inputs"], "doubled").when(n["outputs"] < n["inputs"], "missing")
    return both.select(F.coalesce("__k", key).alias(key), book, n["inputs"].alias("inputs"), n["outputs"].alias("outputs"), error.alias("error"))


def count_guard(paired: DataFrame, book: str) -> DataFrame:
    """(book, inputs, outputs, missing, doubled, foreign, failed) of pairing's rows: a book fails if any id is not 1:1."""
    told = [F.count(F.when(F.col("error") == e, 1)).alias(e) for e in ("missing", "doubled", "foreign")]
    return paired.groupBy(book).agg(F.sum("inputs").alias("inputs"), F.sum("outputs").alias("outputs"), *told, (F.count("error") > 0).alias("failed"))
