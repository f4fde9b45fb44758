"""Parsers declared by patterns alone: as columns in a pipeline, and as a table function for SQL."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.text import SPACES, first_match
from .model import entry, text_cell


class TemplateParser:
    """A parser for documents of one kind. A subclass names it and gives a pattern for each field, in their order.

    A field is its pattern's first group in the first match, stripped, or null; a document gives one record, also where no
    pattern matches. Patterns are matched in any case, over lines. REQUIRED_FIELDS are validated unless the configuration has
    rules of its own for them. KEYWORDS are terms by which documents of the kind are told, where they aren't configured.
    """

    PARSER_NAME = "base"
    PATTERNS: dict[str, str] = {}
    REQUIRED_FIELDS: tuple[str, ...] = ()
    KEYWORDS: tuple[str, ...] = ()

    @classmethod
    def parse(cls, docs: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        fields = [entry(name, text_cell(first_match(text, pattern))) for name, pattern in cls.PATTERNS.items()]
        return docs.select("file_ord", F.lit(0).alias("rec_ord"), F.col("file_name").alias("source_file"), F.lit(cls.PARSER_NAME).alias("doc_type"), F.array(*fields).alias("entries"))


class TemplateFields:
    """``template_fields(text, name => pattern, ...)``: a row for each text, with a column for each named pattern."""

    @staticmethod
    def analyze(text: AnalyzeArgument, **patterns: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument must be a text")
        if not patterns:
            raise ValueError("name a pattern at least: name => 'pattern'")
        schema = StructType()
        for name, given in patterns.items():
            if not given.isConstantExpression or not isinstance(given.value, str):
                raise ValueError(f"the pattern of {name} must be a constant text")
            re.compile(given.value)
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema)

    def __init__(self, *_: Any):
        self.compiled: dict[str, re.Pattern[str]] = {}

    def eval(self, text: str | None, **patterns: str) -> Any:
        if not self.compiled:
            self.compiled = {k: re.compile(p, re.I | re.M) for k, p in patterns.items()}
        yield tuple(self._field(p, text or "") for p in self.compiled.values())

    @staticmethod
    def _field(pattern: re.Pattern[str], text: str) -> str | None:
        found = pattern.search(text)
        value = found[1 if pattern.groups else 0] if found else None
        return (value or "").strip(SPACES) or None


def register_template_fields(spark: SparkSession, name: str = "template_fields") -> str:
    """Make the table function known to a session's SQL: ``FROM docs, LATERAL template_fields(text, field => 'Label:\\s*(.+)')``."""
    spark.udtf.register(name, F.udtf(TemplateFields))
    return name
