"""Document classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import FINANCIAL_TERMS, PARSER_TERMS
from ..functions.text import blank, count_in, let


def document_type(text: Column, tables: Column, terms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """``financial_report`` by three terms, else the first parser with two of its own, else by whether there are tables."""

    def kind(low: Column) -> Column:
        out = F.when(count_in(low, FINANCIAL_TERMS) >= 3, "financial_report")
        for name, own in (PARSER_TERMS if terms is None else terms).items():
            if own:
                out = out.when(count_in(low, tuple(t.lower() for t in own)) >= 2, name)
        return out.when(F.coalesce(F.size(tables), F.lit(0)) > 0, "report").otherwise("invoice")

    return let(F.lower(F.coalesce(text, F.lit(""))), kind)  # the text is made and lower-cased once


def with_document_type(docs: DataFrame, terms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    return docs.withColumn("doc_type", document_type(F.col("text"), F.col("tables"), terms))


def extracted(docs: DataFrame) -> DataFrame:
    """Documents from which anything was extracted."""
    return docs.where(~blank(F.coalesce("text", F.lit(""))) | (F.coalesce(F.size("tables"), F.lit(0)) > 0))
