"""A data source of pages: the pages of a large file are dealt to several tasks, and only those that are asked for are decoded.

``spark.read.format("docpages")`` reads files by Arrow's file systems (local, HDFS, S3, GCS). Each task opens its file's bytes
and decodes its share of the pages; a filter on ``page_ord`` or ``path`` reaches the source, which then plans no other files
and decodes no other pages.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import pdf_text

WORD = "struct<x0: double, x1: double, top: double, bottom: double, text: string>"
RULE = "struct<x0: double, y0: double, x1: double, y1: double>"
SCHEMA = f"path string, page_ord int, n_pages int, text string, words array<{WORD}>, rules array<{RULE}>"
#: Bytes of a file for each task.
SHARE = 16 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path in it; an error where Arrow knows no such store."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def known_store(path: str) -> bool:
    try:
        file_system(path)
    except Exception:  # noqa: BLE001  whatever keeps Arrow from it
        return False
    return True


def _named(base: str, store: fs.FileSystem, path: str) -> str:
    """A path of the store as Spark names it."""
    if store.type_name == "local":
        return "file:" + path
    return re.match(r"[^:]+://[^/]*", base)[0] + "/" + path.lstrip("/") if store.type_name == "hdfs" else re.match(r"[^:]+://", base)[0] + path


def _patterns(pattern: str) -> list[str]:
    m = re.fullmatch(r"(.*)\{(.*)\}(.*)", pattern)
    return [m[1] + x + m[3] for x in m[2].split(",")] if m else [pattern]


@dataclass
class Share(InputPartition):
    """Of a file's pages those whose number leaves ``k`` when divided by ``of``."""

    path: str
    k: int
    of: int


_TESTS: dict[type[Filter], Callable[[Any, Any], bool]] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
}


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], open_file: Callable[[bytes], Any]):
        self.path, self.open_file = options["path"], open_file
        self.pattern, self.recursive = options.get("pattern", "*.{pdf,PDF}"), options.get("recursive", "false") == "true"
        self.layout, self.share = options.get("layout", "false") == "true", int(options.get("share", SHARE))
        self.tests: list[tuple[str, type[Filter], Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters that compare path or page_ord with values are kept here; the others go back."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _TESTS and column in (("path",), ("page_ord",)):
                self.tests.append((column[0], type(f), f.value))
            else:
                yield f

    def _wanted(self, column: str, value: Any) -> bool:
        return all(_TESTS[kind](value, v) for c, kind, v in self.tests if c == column)

    def partitions(self) -> list[Share]:
        store, root = file_system(self.path)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [
            f for f in store.get_file_info(fs.FileSelector(root, recursive=self.recursive))
            if f.type == fs.FileType.File and any(fnmatch.fnmatchcase(f.base_name, p) for p in _patterns(self.pattern))
        ]
        pages = {p for c, kind, v in self.tests if c == "page_ord" and kind in (EqualTo, In) for p in (v if kind is In else (v,))}
        shares = lambda size: min(-(-size // self.share) or 1, len(pages) or 1 << 30)
        return [Share(f.path, k, n) for f in sorted(files, key=lambda f: f.path) if self._wanted("path", _named(self.path, store, f.path)) for n in (shares(f.size or 0),) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = file_system(self.path)
        path = _named(self.path, store, partition.path)
        with store.open_input_file(partition.path) as f:
            content = f.read()
        try:
            file = self.open_file(content)
        except Exception:  # noqa: BLE001  a file that can't be read has no pages
            return
        wanted = [p for p in range(len(file)) if self._wanted("page_ord", p)]
        for p in wanted[partition.k :: partition.of]:
            words, rules = file.layout(p) if self.layout and hasattr(file, "layout") else ([], [])
            yield path, p, len(file), file.text(p) or "", words, rules


class PageSource(DataSource):
    """``open_file``: makes of a file's bytes an object with a length and text(page), and layout(page) if it knows places."""

    open_file: Callable[[bytes], Any] = staticmethod(pdf_text.PdfPages)

    @classmethod
    def name(cls) -> str:
        return "docpages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> PageReader:
        return PageReader(dict(self.options), type(self).open_file)


def register_page_source(spark: SparkSession, open_file: Callable[[bytes], Any] | None = None, name: str = "docpages") -> str:
    """Make the source known to a session, under a name of its own for a decoder of its own; filters are pushed down from then on."""
    source = PageSource
    if open_file is not None:
        source = type("OwnPageSource", (PageSource,), {"open_file": staticmethod(open_file), "name": classmethod(lambda cls: name)})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source)
    return source.name()
