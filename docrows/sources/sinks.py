"""Writing records: CSV, JSON and XLSX."""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructField, StructType

from ..functions.lexicon import SHEET_DATES, SHEET_NUMBER
from ..operators.model import cell, number_cell
from ..operators.wide import ordered_names, shown, widen


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    encoding: str = "utf-8"
    include_header: bool = True
    quoting: str = "minimal"
    include_internal_fields: bool = False


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder beside ``path`` to write to. It takes the place of what is there when the block ends well; else it goes, and the old output stays."""
    jvm = spark._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    new, old = (jvm.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}-{kind}") for kind in ("new", "old"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        yield new.toString()
        there = system.exists(target)
        if there and not system.rename(target, old):
            raise OSError(f"{path} can't be replaced")
        if not system.rename(new, target):
            if there:
                system.rename(old, target)
            raise OSError(f"{path} can't be written")
        if there:
            system.delete(old, True)
    finally:
        if system.exists(new):
            system.delete(new, True)


def csv_lines(records: DataFrame, options: CsvOptions = CsvOptions(), names: list[str] | None = None) -> DataFrame:
    """file_ord, rec_ord, line: each record as a CSV line. The header is not among them."""
    names = ordered_names(records, options.include_internal_fields) if names is None else names
    return records.select("file_ord", "rec_ord", F.concat_ws(options.delimiter, *(quoted(cell("entries", n), options) for n in names)).alias("line"))


def quoted(v: Column, options: CsvOptions) -> Column:
    text = shown(v)
    twice = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    needs = text.rlike('["\\r\\n]') | F.contains(text, F.lit(options.delimiter))
    if options.quoting == "all":
        return twice
    if options.quoting == "none":
        return text
    if options.quoting == "nonnumeric":
        return F.when(F.coalesce(v["t"] == "n", F.lit(False)), text).otherwise(twice)
    return F.when(needs, twice).otherwise(text)


def write_csv(records: DataFrame, path: str, options: CsvOptions = CsvOptions()) -> str:
    """A folder of part files in the records' order, each with the header if there is one; nothing passes through the driver."""
    names = ordered_names(records, options.include_internal_fields)
    wide = widen(records, names, text=True).orderBy("file_ord", "rec_ord").drop("file_ord", "rec_ord") if names else None
    if wide is not None:
        writer = wide.write.mode("overwrite").option("header", options.include_header).option("sep", options.delimiter).option("encoding", options.encoding)
        writer = writer.option("escape", '"').option("emptyValue", "").option("quoteAll", options.quoting in ("all", "nonnumeric"))
        with staged(records.sparkSession, path) as new:
            (writer.option("quote", "\u0000") if options.quoting == "none" else writer).csv(new)
    return path


def json_value(v: Column) -> Column:
    """A cell as JSON text."""
    text = F.regexp_replace(F.to_json(F.array(v["s"])), "^\\[|\\]$", "")
    number = F.when(v["n"].isNotNull(), F.regexp_replace(F.to_json(F.array(v["n"])), "^\\[|\\]$", ""))
    return F.coalesce(F.when(v["t"] == "s", text).when(v["t"] == "n", number).when(v["t"].isin("j", "b"), v["s"]), F.lit("null"))


def json_rows(records: DataFrame, internal: bool = False) -> DataFrame:
    """file_ord, rec_ord, json: each record as a JSON object, its fields in their order, nulls kept."""
    own = F.col("entries") if internal else F.filter("entries", lambda e: ~F.startswith(e["k"], F.lit("_")))
    name = lambda k: F.regexp_replace(F.to_json(F.array(k)), "^\\[|\\]$", "")
    pairs = F.transform(own, lambda e: F.concat(name(e["k"]), F.lit(": "), json_value(e["v"])))
    return records.select("file_ord", "rec_ord", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("json"))


def variant_rows(records: DataFrame, internal: bool = False) -> DataFrame:
    """file_ord, rec_ord, record: each record as one VARIANT, whatever fields it has; nested cells are nested values."""
    return json_rows(records, internal).select("file_ord", "rec_ord", F.parse_json("json").alias("record"))


def variant_schema(rows: DataFrame) -> StructType:
    """The fields of all records of ``rows``, by name, with the narrowest type that holds their values. One aggregate; its one row comes to the driver."""
    told = rows.agg(F.schema_of_variant_agg("record").alias("schema")).first()["schema"] or ""
    inner = re.fullmatch(r"OBJECT<(.*)>", told, re.S)
    return StructType.fromDDL(re.sub(r"\bOBJECT<", "STRUCT<", inner[1])) if inner and inner[1] else StructType()


def widen_variants(rows: DataFrame, schema: StructType | None = None) -> DataFrame:
    """A typed column for each field of records as VARIANT: numbers are doubles, texts and truth values themselves, other values JSON."""

    def column(f: StructField) -> Column:
        kind = "string" if isinstance(f.dataType, StringType) else "boolean" if isinstance(f.dataType, BooleanType) else "double" if isinstance(f.dataType, NumericType) else None
        mark = next((m for m in "'\"" if m not in f.name), None)
        if mark is None:  # no path can name it
            return F.from_json(F.to_json("record"), "map<string,string>")[f.name].try_cast(kind or "string").alias(f.name)
        value = F.variant_get("record", f"$[{mark}{f.name}{mark}]", kind or "variant")
        return (value if kind else F.when(~F.is_variant_null(value), F.to_json(value))).alias(f.name)

    return rows.select("file_ord", "rec_ord", *(column(f) for f in (variant_schema(rows) if schema is None else schema)))


def write_variants(records: DataFrame, path: str) -> str:
    """A Parquet folder of records as VARIANT, in their order: nothing is widened, and no names are gathered."""
    with staged(records.sparkSession, path) as new:
        variant_rows(records, internal=True).orderBy("file_ord", "rec_ord").write.mode("overwrite").parquet(new)
    return path


def json_columns(records: DataFrame, names: list[str] | None = None, by_file: bool = False) -> DataFrame:
    """name, position, values: a column for each field, as a JSON array in the records' order; missing cells are null.

    ``by_file``: an array for each file's records, and file_ord, so that no row holds a column of all records.
    """
    names = ordered_names(records) if names is None else names
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), json_value(cell("entries", n)).alias("v")) for i, n in enumerate(names))))
    long = records.select("file_ord", "rec_ord", cells.alias("c"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "rec_ord", "c.v"))), lambda x: x["v"])
    key = ["c.name", "c.position", *(["file_ord"] if by_file else [])]
    return long.groupBy(*key).agg(F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")).alias("values"))


def _lines(records: DataFrame, orient: str, internal: bool) -> DataFrame:
    """file_ord, rec_ord, value: what the orient makes of the records, as JSON objects."""
    if orient == "columns":
        c = json_columns(records, ordered_names(records, internal), by_file=True)
        value = F.concat(F.lit('{"name": '), _text(F.col("name")), F.lit(', "file": '), F.col("file_ord").cast("string"), F.lit(', "values": '), "values", F.lit("}"))
        return c.select("file_ord", F.col("position").alias("rec_ord"), value.alias("value"))
    rows = json_rows(records, internal)
    if orient == "index":
        return rows.select("file_ord", "rec_ord", F.concat(F.lit('{"index": "'), F.concat_ws("-", "file_ord", "rec_ord"), F.lit('", "record": '), "json", F.lit("}")).alias("value"))
    return rows.select("file_ord", "rec_ord", F.col("json").alias("value"))


def _text(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), "^\\[|\\]$", "")


def write_json(records: DataFrame, path: str, orient: str = "records", internal: bool = False) -> str:
    """A folder of text files, a JSON object a line: the record (``records``), with its number (``index``), or a file's values
    of one field (``columns``). Nothing passes through one task or the driver."""
    with staged(records.sparkSession, path) as new:
        _lines(records, orient, internal).orderBy("file_ord", "rec_ord").select("value").write.mode("overwrite").text(new)
    return path


def write_json_document(records: DataFrame, path: str, orient: str = "records", internal: bool = False, about: dict[str, object] | None = None) -> str:
    """One JSON document, for results that one reader can hold: an array of records, an object of records by number, or an
    object of arrays by field; with ``about``, an envelope of metadata and data. A folder with one text file, which one task
    writes from sorted lines without holding them.
    """
    if orient == "columns":
        parts = json_columns(records, ordered_names(records, internal)).select(F.lit(0).alias("a"), F.col("position").alias("b"), F.concat(_text(F.col("name")), F.lit(": "), "values").alias("value"))
    else:
        name = F.concat(F.lit('"'), (F.row_number().over(W.orderBy("file_ord", "rec_ord")) - 1).cast("string"), F.lit('": ')) if orient == "index" else F.lit("")
        parts = json_rows(records, internal).select(F.col("file_ord").alias("a"), F.col("rec_ord").alias("b"), F.concat(name, "json").alias("value"))
    spark, (left, right) = records.sparkSession, "[]" if orient == "records" else "{}"
    if about is not None:
        meta = {"generated_at": datetime.datetime.now().isoformat(), "record_count": records.count(), **about}
        left, right = '{"metadata": ' + json.dumps(meta, ensure_ascii=False, default=str) + ', "data": ' + left, right + "}"
    first = parts.agg(F.min(F.struct("a", "b")).alias("first")).first()["first"]
    here = F.struct("a", "b") == F.struct(F.lit(first["a"] if first else 0), F.lit(first["b"] if first else 0))
    body = parts.select(F.lit(1).alias("part"), "a", "b", F.when(here, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    edge = spark.range(2).select(F.when(F.col("id") == 0, 0).otherwise(2).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.when(F.col("id") == 0, F.lit(left)).otherwise(F.lit(right)).alias("value"))
    with staged(spark, path) as new:
        body.unionByName(edge).coalesce(1).sortWithinPartitions("part", "a", "b").select("value").write.mode("overwrite").text(new)
    return path


def with_envelope(records: DataFrame, path: str, **about: object) -> str:
    """One JSON document: metadata (generated_at, record_count and whatever else is given) and data. Internal fields are kept."""
    return write_json_document(records, path, internal=True, about=about)


#: A worksheet's most rows, by the format's definition.
SHEET_ROWS = 1_048_576


def write_xlsx(records: DataFrame, path: str) -> str:
    """One workbook for a result that a worksheet can hold; rows come to the driver one partition after the other."""
    names = ordered_names(records)
    if records.limit(SHEET_ROWS).count() >= SHEET_ROWS:
        raise ValueError(f"a worksheet holds {SHEET_ROWS - 1} records at most; write CSV instead")
    rows = widen(records, names, text=False).orderBy("file_ord", "rec_ord").select(*(sheet_cell(F.col(f"`{n}`")).alias(n) for n in names))
    text = lambda s: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(s)}</t></is></c>'

    def one(v) -> str:
        if v is None or v["t"] is None:
            return "<c/>"
        if v["t"] == "n":
            return f"<c><v>{v['n']!r}</v></c>"
        return text(v["s"])

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'<worksheet xmlns="{ns}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            sheet.write(("<row>" + "".join(text(n) for n in names) + "</row>").encode())
            for row in rows.toLocalIterator():
                sheet.write(("<row>" + "".join(one(v) for v in row) + "</row>").encode())
            sheet.write(b"</sheetData></worksheet>")
    return path


def sheet_cell(v: Column) -> Column:
    """A cell as a worksheet has it: text that looks like a number is one, text that looks like a date is an ISO date, truth values are Yes and No."""
    s = v["s"]
    number = F.when(F.replace(s, F.lit(" ")).rlike(SHEET_NUMBER), F.translate(s, "$, ", "").try_cast("double"))
    day = F.coalesce(
        F.when(s.rlike(SHEET_DATES[0]), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd"))),
        F.when(s.rlike(SHEET_DATES[1]), F.coalesce(F.try_to_timestamp(F.substring(s, 1, 10), F.lit("MM/dd/yyyy")), F.try_to_timestamp(F.substring(s, 1, 10), F.lit("dd/MM/yyyy")))),
    )
    text = F.when(v["t"] == "b", F.when(s == "true", "Yes").otherwise("No")).when((v["t"] == "s") & day.isNotNull(), F.date_format(day, "yyyy-MM-dd")).otherwise(s)
    is_number = F.coalesce((v["t"] == "s") & day.isNull() & number.isNotNull(), F.lit(False))
    return F.when(is_number, number_cell(number)).otherwise(F.struct(v["t"].alias("t"), text.alias("s"), v["n"].alias("n")))


#: Formats by name; more can be registered. An online sheet is not reachable from here, and like any unknown format becomes CSV.
SINKS: dict[str, Callable[..., str]] = {"csv": write_csv, "json": write_json, "xlsx": write_xlsx, "variant": write_variants}


def register_sink(kind: str, write: Callable[..., str]) -> None:
    """A function of records and a path, which returns the path."""
    SINKS[kind] = write


def export(records: DataFrame, folder: str, name: str, kind: str = "csv", **options: object) -> str | None:
    """Write records under their name; null, and no file, if there are none."""
    if records.isEmpty():
        return None
    kind = kind if kind in SINKS else "csv"
    return SINKS[kind](records, f"{folder.rstrip('/')}/{name}.{kind}", **options)


def export_all(datasets: dict[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, str | None]:
    """Several results, each under its name; the paths by name."""
    return {name: export(records, folder, name, kind) for name, records in datasets.items()}
