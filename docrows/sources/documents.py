"""Reading documents: a folder or a file, decoded in tasks by a decoder that can be exchanged."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import clean_tables, filter_tables
from ..operators.layout import document_tables, find_tables
from . import pdf_text
from .pages import RULE, WORD, known_store, register_page_source
from .shared import materialize

#: Schema of binaryFile, which streams have to name.
BINARY = "path string, modificationTime timestamp, length long, content binary"
_COLUMNS = ("path", "file_name", "text", "tables", "extraction_method", "n_pages", "truncated", "layout", "error")
DECODED = (
    "path string, file_name string, text string, tables array<array<array<string>>>, extraction_method string, n_pages int, truncated boolean, "
    f"layout array<struct<page_ord: int, words: array<{WORD}>, rules: array<{RULE}>>>, error string"
)
#: Files whose numbers may be broadcast (about 100 bytes each).
FEW = 1_000_000


@dataclass(frozen=True)
class Decoder:
    """Functions from a file's bytes. Texts (a text for each page, blank ones too) and tables have a list each, of which the
    first with a result is used.

    ``paged`` makes of a file's bytes its pages, with a length, text(page) and, if it knows where words and lines stand,
    layout(page); it gives the texts unless other ``texts`` are passed. Where no function gave tables, the layout is asked.
    ``ocr`` is asked where neither gave anything. A function that raises gave nothing. Tables are asked for if
    ``prefer_tables`` holds or ``strategy`` is table_first. Of a file's pages the first ``max_pages`` are read (the default
    is a fixed value); ``truncated`` says of each file whether there were more.
    """

    texts: tuple[Callable[[bytes], list[str]], ...] = (pdf_text.pages,)
    paged: Callable[[bytes], Any] | None = pdf_text.PdfPages
    tables: tuple[Callable[[bytes], list[list[list[str | None]]]], ...] = ()
    ocr: Callable[[bytes], str] | None = None
    max_pages: int = 100
    prefer_tables: bool = True
    ocr_fallback: bool = True
    strategy: str = "auto"

    @property
    def by_page(self) -> Callable[[bytes], Any] | None:
        """What decodes single pages, if that is where texts come from."""
        return self.paged if self.texts == (pdf_text.pages,) else None

    def pages(self, content: bytes) -> list[str]:
        """All pages by the first decoder that finds text; if none does, by the first that finds pages."""
        found: list[str] = []
        for f in (_all_pages(self.by_page),) if self.by_page else self.texts:
            try:
                own = list(f(content))
            except Exception:  # noqa: BLE001  a file that one decoder can't read goes to the next
                continue
            if any(p and p.strip() for p in own[: self.max_pages]):
                return own
            found = found or own
        return found

    def layout(self, content: bytes) -> list[dict[str, Any]]:
        """Words and lines of the first pages; nothing where the decoder knows none."""
        try:
            file = self.paged(content)
            found = [(p, *file.layout(p)) for p in range(min(len(file), self.max_pages))]
        except Exception:  # noqa: BLE001
            return []
        named = lambda names, rows: [dict(zip(names, map(_plain, r))) for r in rows]
        return [{"page_ord": p, "words": named(("x0", "x1", "top", "bottom", "text"), w), "rules": named(("x0", "y0", "x1", "y1"), r)} for p, w, r in found if w]

    def __call__(self, content: bytes) -> tuple[str, list, str, int, bool, list]:
        pages, tables, asked = self.pages(content), [], self.prefer_tables or self.strategy == "table_first"
        text = "\n\n".join(p for p in pages[: self.max_pages] if p and p.strip())
        for f in self.tables if asked else ():
            try:
                tables = f(content)
            except Exception:  # noqa: BLE001
                tables = []
            if tables:
                break
        more = (len(pages), len(pages) > self.max_pages, self.layout(content) if asked and not tables and hasattr(self.paged, "layout") else [])
        if not text and not tables and self.ocr_fallback and self.ocr:
            return self.ocr(content), [], "ocr", *more
        return text, tables, "tables" if tables else "text", *more


def _all_pages(paged: Callable[[bytes], Any]) -> Callable[[bytes], list[str]]:
    return lambda content: [file.text(k) for file in (paged(content),) for k in range(len(file))]


def _plain(value: Any) -> Any:
    return value if isinstance(value, str) else float(value)


@dataclass(frozen=True)
class DocumentSource:
    """Where documents come from. ``pattern`` takes both cases of the suffix, and nothing in between."""

    path: str
    pattern: str = "*.{pdf,PDF}"
    recursive: bool = False
    decode: Decoder = field(default_factory=Decoder)


def files(spark: SparkSession, source: DocumentSource) -> DataFrame:
    """The files themselves; a missing path is an error at once."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(source.recursive).lower())
    if not source.path.lower().endswith(".pdf"):
        reader = reader.option("pathGlobFilter", source.pattern)
    return reader.load(source.path)


def decoded(files: DataFrame, decode: Decoder) -> DataFrame:
    """A row for each file, its tables clean; ``layout`` is where its words and lines stand, where that is asked for.

    A file that can't be decoded has an error instead of content.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    found, error = decode(bytes(content)), None
                except Exception as e:  # noqa: BLE001  the error is the file's result
                    found, error = (None, None, None, 0, False, None), f"{type(e).__name__}: {e}"
                rows.append((path, path.rsplit("/", 1)[-1], *found, error))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return files.select("path", "content").mapInPandas(work, DECODED).withColumn("tables", filter_tables(clean_tables(F.col("tables"))))


def with_found_tables(docs: DataFrame) -> DataFrame:
    """Decoded documents without layout; where they had no tables, those that their pages' layout shows. ``docs`` should be a table."""
    pages = docs.where(F.size("layout") > 0).select("path", F.inline("layout"))
    if pages.isEmpty():
        return docs.drop("layout")
    words, rules = (pages.select("path", "page_ord", F.inline(c)) for c in ("words", "rules"))
    found = document_tables(find_tables(words, None if rules.isEmpty() else rules)).select("path", F.col("tables").alias("found"))
    more = (F.coalesce(F.size("tables"), F.lit(0)) == 0) & (F.coalesce(F.size("found"), F.lit(0)) > 0)
    out = docs.join(found, "path", "left").withColumn("extraction_method", F.when(more, "tables").otherwise(F.col("extraction_method")))
    return out.withColumn("tables", F.when(more, F.col("found")).otherwise(F.col("tables"))).select([c for c in docs.columns if c != "layout"])


def numbered_paths(paths: DataFrame) -> DataFrame:
    """path, file_ord: each path's place from 0. Paths are sorted in ranges; only the ranges' sizes come to the driver."""
    ranges = paths.select("path").repartitionByRange("path").sortWithinPartitions("path")
    ranges = materialize(ranges.withColumn("at", F.monotonically_increasing_id()), "paths")  # the range's number, and the place in it
    ranges = ranges.select("path", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes, begin, begins = ranges.groupBy("range").count().orderBy("range").collect(), 0, []
    for r in sizes:
        begins += [F.lit(r["range"]), F.lit(begin)]
        begin += r["count"]
    first = F.element_at(F.create_map(*begins), F.col("range")) if begins else F.lit(0)
    return ranges.select("path", (first + F.col("place")).cast("int").alias("file_ord"))


def numbered_files(docs: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``docs`` with file_ord: the file's place by path. ``paths``: where they are listed without being decoded."""
    order = materialize(numbered_paths(docs if paths is None else paths), "file-order")
    return docs.join(F.broadcast(order) if order.limit(FEW + 1).count() <= FEW else order, "path")


def read_documents(spark: SparkSession, source: DocumentSource) -> DataFrame:
    """Decoded documents, numbered by path. Each file is decoded once, into a table of the shared folder."""
    found = files(spark, source)
    return numbered_files(with_found_tables(materialize(decoded(found, source.decode), "decoded")), found)


def read_document(spark: SparkSession, path: str, decode: Decoder | None = None) -> DataFrame:
    """One file. Its name must end in .pdf, in any case; a missing file is an error."""
    if not path.lower().endswith(".pdf"):
        raise ValueError(f"not a PDF file: {path}")
    return read_documents(spark, DocumentSource(path, decode=decode or Decoder()))


def read_pages(spark: SparkSession, source: DocumentSource, layout: bool = False) -> DataFrame:
    """A row for each page, blank ones too: path, page_ord (from 0), n_pages, text, with ``layout`` words and rules. Files without pages have none.

    The pages of a large file are decoded by several tasks, and a filter on page_ord keeps others from being decoded. That
    needs a decoder by pages, and a store that Arrow knows; else each file is decoded whole, by the task that reads it.
    """
    columns = ["path", "page_ord", "n_pages", "text", *(("words", "rules") if layout else ())]
    d = source.decode
    if d.by_page and known_store(source.path):
        own = d.by_page is not pdf_text.PdfPages
        kind = register_page_source(spark, d.by_page, f"docpages_{uuid.uuid4().hex}") if own else register_page_source(spark)
        options = {"pattern": source.pattern, "recursive": str(source.recursive).lower(), "layout": str(layout).lower()}
        return spark.read.format(kind).options(**options).load(source.path).select(columns)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                found = d.pages(bytes(content))
                places = {x["page_ord"]: (x["words"], x["rules"]) for x in (replace(d, max_pages=len(found)).layout(bytes(content)) if layout else ())}
                rows += [(path, i, len(found), t or "", *(places.get(i, ([], [])) if layout else ())) for i, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=columns)

    shape = "path string, page_ord int, n_pages int, text string" + (f", words array<{WORD}>, rules array<{RULE}>" if layout else "")
    return files(spark, source).select("path", "content").mapInPandas(work, shape)


def read_page_tables(spark: SparkSession, source: DocumentSource, page: int | None = None) -> DataFrame:
    """path, page_ord, table_ord, grid: ruled tables page by page, or of one page, of two rows and columns at least. Text that is only aligned makes none here."""
    pages = read_pages(spark, source, layout=True)
    pages = materialize(pages if page is None else pages.where(F.col("page_ord") == page), "page-layout")
    words, rules = (pages.select("path", "page_ord", F.inline(c)) for c in ("words", "rules"))
    return find_tables(words, rules, aligned=False)


def page_counts(spark: SparkSession, source: DocumentSource) -> DataFrame:
    """path, n_pages of each file; 0 where it can't be read. Where the decoder knows pages, none is decoded."""
    d = source.decode

    def number(content: bytes) -> int:
        if not d.by_page:
            return len(d.pages(content))
        try:
            return len(d.by_page(content))
        except Exception:  # noqa: BLE001
            return 0

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "n_pages": [number(bytes(c)) for c in b["content"]]})

    return files(spark, source).select("path", "content").mapInPandas(work, "path string, n_pages int")


def read_output(spark: SparkSession, path: str, kind: str, limit: int | None = None) -> DataFrame:
    """An export read back, without internal columns; of JSON, lines of records or one document."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"') if kind == "csv" else spark.read.json(path)
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("_")))
    return df if limit is None else df.limit(limit)


def latest(df: DataFrame, by: str | list[str], when: str, what: str) -> DataFrame:
    """For each group its last ``when``, and ``what`` of the row that has it (of rows at the same time, the largest one)."""
    return df.groupBy(by).agg(F.max(when).alias(when), F.max_by(what, F.struct(when, what)).alias(what))


def latest_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """kind (the suffix), modificationTime, path of the newest file of each kind in a folder of exports. No file is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    return latest(found.withColumn("kind", F.regexp_extract("path", r"\.([A-Za-z]+)(?:/[^/]*)?$", 1)), "kind", "modificationTime", "path")
