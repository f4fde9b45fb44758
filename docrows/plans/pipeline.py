"""The pipeline from documents to records and output. Until the sink it is one lazy plan."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import deduplicate
from ..operators.detect import extracted, with_document_type
from ..operators.financial import parse_financials
from ..operators.invoice import parse_invoices
from ..operators.model import entry, text_cell
from ..operators.normalize import normalize
from ..operators.report import parse_reports
from ..operators.template import TemplateParser
from ..operators.validate import validate
from ..sources.documents import Decoder, DocumentSource, read_document, read_documents
from ..sources.shared import materialize
from ..sources.sinks import SINKS, export
from .config import DECLARED, Config

Parser = Callable[[DataFrame, Config], DataFrame]
#: Parsers by name. A parser takes documents and returns records; more can be registered.
PARSERS: dict[str, Parser] = {
    "invoice": lambda docs, c: parse_invoices(docs),
    "report": lambda docs, c: parse_reports(docs, c.max_header_rows, c.min_columns, c.include_metadata),
    "financial_report": lambda docs, c: parse_financials(docs),
}


def get_parser(name: str) -> Parser:
    if name not in PARSERS:
        raise ValueError(f"unknown parser {name!r}; there are {', '.join(PARSERS)}")
    return PARSERS[name]


def register_parser(name: str, parser: Parser) -> None:
    PARSERS[name] = parser


def register_template(template: type[TemplateParser]) -> None:
    """Make a parser that is declared by patterns known to all pipelines, with its required fields and keywords."""
    register_parser(template.PARSER_NAME, lambda docs, c: template.parse(docs))
    DECLARED[template.PARSER_NAME] = tuple(template.REQUIRED_FIELDS), tuple(template.KEYWORDS)


@dataclass(frozen=True)
class Result:
    records: DataFrame
    stats: DataFrame
    output: str | None = None


@dataclass(frozen=True)
class Pipeline:
    """Documents to records: classify, parse, normalize, validate, deduplicate. ``parser``: a name, or None or 'auto'."""

    config: Config = field(default_factory=Config)
    parser: str | None = None
    lineage: bool = False

    def parse(self, docs: DataFrame) -> DataFrame:
        """Normal, validated records of all documents, before duplicates go. No text is shuffled."""
        return self._checked(self._parsed(docs))

    def _parsed(self, docs: DataFrame, seen: Observation | None = None) -> DataFrame:
        """``seen`` counts on the way: files_parsed, those with records, which are numbered from 0, and validation_errors."""
        docs = extracted(docs)
        if self.parser in (None, "auto"):
            docs = with_document_type(docs, self.config.terms())
            names = [n for n in PARSERS if n in ("financial_report", "report", "invoice") or n in self.config.terms()]
        else:
            get_parser(self.parser)
            docs, names = docs.withColumn("doc_type", F.lit(self.parser)), [self.parser]
        out = None
        for name in names:
            records = get_parser(name)(docs.where(F.col("doc_type") == name), self.config).withColumn("doc_type", F.lit(name))
            out = records if out is None else out.unionByName(records)
        c = self.config
        out = normalize(out, c.date_formats, c.date_output, True, c.normalize_unicode, c.lowercase_headers)
        out = validate(out, replace(c.validation, on_error="warn"), {name: c.rules_of(name) for name in names})
        if seen:
            out = out.observe(seen, F.count_if(F.col("rec_ord") == 0).alias("files_parsed"), F.sum(F.size("errors")).alias("validation_errors"))
        if c.validation.on_error == "skip":
            out = out.where(F.size("errors") == 0)
        if self.lineage:
            out = out.withColumn("entries", F.concat("entries", F.array(entry("_source_file", text_cell(F.col("source_file"))))))
        return out

    def _checked(self, out: DataFrame) -> DataFrame:
        """The same records; too many errors stop the run where the configuration says so."""
        if self.config.validation.on_error == "fail" and self.config.validation.enabled:
            self._stop_at(out.agg(F.sum(F.size("errors"))).first()[0] or 0)
        return out

    def _stop_at(self, n: int) -> None:
        v = self.config.validation
        if v.on_error == "fail" and v.enabled and n > v.max_errors:
            raise ValueError(f"{n} validation errors; at most {v.max_errors} are allowed")

    def records(self, docs: DataFrame) -> DataFrame:
        out = self.parse(docs)
        return deduplicate(out, self.config.key_columns, self.config.keep) if self.config.deduplicate else out

    def run(self, docs: DataFrame, folder: str | None = None, name: str | None = None, kind: str = "csv") -> Result:
        """Records and counters, and the output's path. Without a folder nothing is written.

        Documents are parsed once: the parsed records are a table of the shared folder, which is read once, to remove
        duplicates. Counters are observed as the two tables are written.
        """
        seen, before, after = Observation(), Observation(), Observation()
        rows = F.count("*").alias("rows")
        parsed = materialize(self._parsed(docs, seen).observe(before, rows), "parsed")
        self._stop_at(seen.get["validation_errors"] or 0)
        records = deduplicate(parsed, self.config.key_columns, self.config.keep) if self.config.deduplicate else parsed
        records, path = materialize(records.observe(after, rows), "records"), None
        if folder is not None:
            path = self._export(records, folder, name or f"resultado_{datetime.datetime.now():%Y%m%d_%H%M%S}", kind)
        return Result(records, self._counters(docs, {**seen.get, "rows_parsed": before.get["rows"], "rows_output": after.get["rows"]}), path)

    @staticmethod
    def _counters(docs: DataFrame, seen: dict[str, int | None]) -> DataFrame:
        """One row: files, files_parsed, rows_parsed, rows_output, duplicates_removed, errors, warnings (files without records) and validation_errors, those of dropped records too."""
        failed = F.count_if(F.col("error").isNotNull()) if "error" in docs.columns else F.lit(0).cast("long")
        of = {k: F.lit(v or 0).cast("long") for k, v in seen.items()}
        files = docs.agg(F.count("*").alias("files"), failed.alias("errors"))
        return files.select(
            "files", of["files_parsed"].alias("files_parsed"), of["rows_parsed"].alias("rows_parsed"), of["rows_output"].alias("rows_output"),
            (of["rows_parsed"] - of["rows_output"]).alias("duplicates_removed"), "errors", (F.col("files") - of["files_parsed"] - F.col("errors")).alias("warnings"), of["validation_errors"].alias("validation_errors"),
        )

    def _export(self, records: DataFrame, folder: str, name: str, kind: str) -> str | None:
        c = self.config
        options = {"csv": {"options": c.csv}, "json": {"orient": c.json_orient, "internal": c.json_internal}}
        kind = kind if kind in SINKS else "csv"
        return export(records, folder, name, kind, **options.get(kind, {}))

    def decoder(self, decode: Decoder | None = None) -> Decoder:
        c = self.config
        return replace(decode or Decoder(), max_pages=c.max_pages, prefer_tables=c.prefer_tables, ocr_fallback=c.ocr_fallback, strategy=c.strategy)

    def process_directory(self, spark: SparkSession, path: str, folder: str | None = None, kind: str = "csv", decode: Decoder | None = None) -> Result:
        docs = read_documents(spark, DocumentSource(path, decode=self.decoder(decode)))
        return replace(self, lineage=True).run(docs, folder, kind=kind)

    def process_file(self, spark: SparkSession, path: str, folder: str | None = None, kind: str = "csv", decode: Decoder | None = None) -> Result:
        name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return self.run(read_document(spark, path, self.decoder(decode)), folder, name, kind)
