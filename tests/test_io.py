"""Sources, sinks, watching, jobs and configuration, with files written and read back."""

from __future__ import annotations

import json
import os
import time
import uuid
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from docrows.functions import dates, text
from docrows.operators import invoice, report
from docrows.operators.dedup import deduplicate
from docrows.operators.financial import metadata as financial_metadata
from docrows.operators.model import RECORD, cell, entry, json_cell, number_cell, text_cell
from docrows.operators.normalize import normalize
from docrows.operators.template import TemplateParser, register_template_fields
from docrows.operators.validate import FieldRule, InRange, NonNegative, Required, Validation, renumber, validate, with_errors
from docrows.operators.wide import distinct_values
from docrows.plans.config import DECLARED, from_dict, load, spark_format
from docrows.plans.pipeline import PARSERS, Pipeline, get_parser, register_parser, register_template
from docrows.sources import pdf_text, sinks
from docrows.sources.documents import Decoder, DocumentSource, latest_outputs, numbered_paths, page_counts, read_document, read_documents, read_output, read_pages
from docrows.streaming.jobs import JobManager, NoOutput, UnknownJob, catalog
from docrows.streaming.watch import watch_folder

INVOICE = "Factura No. : INV-{n}\nFecha: 05/03/2024\nProveedor: Acme\nSubtotal: $100.00\nIVA: $16.00\nTotal: $116.00"


def pdf(*pages: str, packed: bool = True) -> bytes:
    """A file with a page tree, whose pages stand in it backwards."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids = [10 + 2 * k for k in range(len(pages))]
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /Count {len(pages)} >>".encode()
    for k, page in reversed(list(zip(kids, pages))):
        show = "".join(f"({line.replace(chr(92), chr(92) * 2).replace('(', chr(92) + '(').replace(')', chr(92) + ')')}) Tj 0 -12 Td " for line in page.split("\n") if line)
        body = f"BT /F1 12 Tf {show}ET".encode("latin-1") if page else b""
        packed_body = zlib.compress(body) if packed else body
        objects[k] = f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>".encode()
        objects[k + 1] = f"<< /Length {len(packed_body)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + packed_body + b"\nendstream"
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + body + b"\nendobj\n" for n, body in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.fixture
def folder(tmp_path):
    inbox = tmp_path / "in"
    (inbox / "deeper").mkdir(parents=True)
    (inbox / "a.pdf").write_bytes(pdf(INVOICE.format(n=1), "", "Nota: final"))
    (inbox / "b.PDF").write_bytes(pdf(INVOICE.format(n=2), packed=False))
    (inbox / "c.txt").write_text("no pdf")
    (inbox / "deeper" / "d.pdf").write_bytes(pdf(INVOICE.format(n=3)))
    return tmp_path


def test_pdf_pages():
    assert pdf_text.pages(pdf("one (1)\ntwo", "", "three")) == ["one (1)\ntwo", "", "three"]
    assert pdf_text.pages(b"no pdf at all") == []
    bare = b"<< /Length 9 >>\nstream\nBT (x) Tj ET\nendstream"
    assert pdf_text.pages(bare) == ["x"]


def test_read_documents(spark, folder):
    got = {r.file_name: r for r in read_documents(spark, DocumentSource(f"{folder}/in")).collect()}
    assert sorted((n, r.file_ord) for n, r in got.items()) == [("a.pdf", 0), ("b.PDF", 1)]
    assert got["a.pdf"].text.startswith("Factura") and got["a.pdf"].text.endswith("\n\nNota: final") and got["a.pdf"].n_pages == 3 and not got["a.pdf"].truncated
    assert read_documents(spark, DocumentSource(f"{folder}/in", recursive=True)).count() == 3
    first = read_documents(spark, DocumentSource(f"{folder}/in/a.pdf", decode=Decoder(max_pages=2))).first()
    assert first.truncated and first.n_pages == 3 and "Nota" not in first.text
    with pytest.raises(ValueError):
        read_document(spark, f"{folder}/in/c.txt")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_document(spark, f"{folder}/in/none.pdf")


def test_decoder_chain(spark, folder):
    def broken(content):
        raise OSError("no")

    grid = lambda content: [[["a", " NaN "], ["b\nc"], []], [["only one row"]]]
    d = Decoder(texts=(broken, lambda c: ["", " "], lambda c: ["second"]), tables=(broken, grid))
    row = read_documents(spark, DocumentSource(f"{folder}/in/a.pdf", decode=d)).first()
    assert row.text == "second" and row.extraction_method == "tables" and row.tables == [[["a", None], ["b c", None]]]
    ocr = Decoder(texts=(broken,), ocr=lambda c: "seen")
    assert read_documents(spark, DocumentSource(f"{folder}/in/a.pdf", decode=ocr)).first().extraction_method == "ocr"
    assert Decoder(texts=(), tables=(grid,), prefer_tables=False)(b"")[1] == [] and Decoder(texts=(), tables=(grid,), prefer_tables=False, strategy="table_first")(b"")[1]
    failing = Decoder(texts=(), ocr=broken)
    assert read_documents(spark, DocumentSource(f"{folder}/in/a.pdf", decode=failing)).first().error == "OSError: no"


def test_pages_and_counts(spark, folder):
    (folder / "in" / "z.pdf").write_bytes(b"broken")
    source = DocumentSource(f"{folder}/in", recursive=True)
    pages = sorted((os.path.basename(r.path), r.page_ord, r.n_pages, r.text[:4]) for r in read_pages(spark, source).collect())
    assert pages == [("a.pdf", 0, 3, "Fact"), ("a.pdf", 1, 3, ""), ("a.pdf", 2, 3, "Nota"), ("b.PDF", 0, 1, "Fact"), ("d.pdf", 0, 1, "Fact")]
    assert sorted((os.path.basename(r.path), r.n_pages) for r in page_counts(spark, source).collect()) == [("a.pdf", 3), ("b.PDF", 1), ("d.pdf", 1), ("z.pdf", 0)]


def test_numbered_paths(spark):
    names = [f"p{(k * 37) % 500:04d}" for k in range(500)]
    got = {r.path: r.file_ord for r in numbered_paths(spark.createDataFrame([(n,) for n in names], "path string").repartition(7)).collect()}
    assert got == {n: k for k, n in enumerate(sorted(names))}
    assert numbered_paths(spark.createDataFrame([], "path string")).count() == 0


@pytest.mark.parametrize("kind", ["csv", "json", "unknown"])
def test_process_directory_decodes_each_file_once(spark, folder, kind):
    seen = str(folder / "seen")
    os.makedirs(seen)

    def count(content):
        open(f"{seen}/{uuid.uuid4().hex}", "w").close()
        return pdf_text.pages(content)

    result = Pipeline().process_directory(spark, f"{folder}/in", f"{folder}/out", kind, Decoder(texts=(count,)))
    stats = result.stats.first()
    assert (stats.files, stats.files_parsed, stats.rows_output, stats.errors, stats.warnings) == (2, 2, 2, 0, 0)
    assert len(os.listdir(seen)) == 2
    back = read_output(spark, result.output, "json" if kind == "json" else "csv")
    assert sorted(r.invoice_id for r in back.collect()) == ["INV-1", "INV-2"] and "_source_file" not in back.columns
    assert os.path.basename(result.output).startswith("resultado_") and result.output.endswith(".json" if kind == "json" else ".csv")
    files = {cell_of(r, "_source_file") for r in result.records.collect()}
    assert files == {"a.pdf", "b.PDF"}
    newest = {r.kind: r.path for r in latest_outputs(spark, f"{folder}/out").collect()}
    assert result.output in newest["json" if kind == "json" else "csv"]


def test_counters_are_observed_as_tables_are_written(spark, folder):
    """A bad invoice among good ones, a repeated one, a file without text: counted in the passes that write, under each way with errors."""
    (folder / "in" / "bad.pdf").write_bytes(pdf("Factura No. : INV-4\nFecha: 05/03/1850\nTotal: -3"))
    (folder / "in" / "copy.pdf").write_bytes(pdf(INVOICE.format(n=2), packed=False))
    (folder / "in" / "blank.pdf").write_bytes(pdf(""))
    docs = read_documents(spark, DocumentSource(f"{folder}/in"))
    run = lambda **v: Pipeline(from_dict({"validation": v})).run(docs).stats.first()
    warn, skip = run(on_error="warn"), run(on_error="skip")
    n = Pipeline().parse(docs).agg(F.sum(F.size("errors"))).first()[0]
    assert n > 0 and (warn.files, warn.files_parsed, warn.rows_parsed, warn.rows_output, warn.duplicates_removed, warn.errors, warn.warnings, warn.validation_errors) == (5, 4, 4, 3, 1, 0, 1, n)
    good = Pipeline(from_dict({"validation": {"on_error": "skip"}})).records(docs).count()
    assert (skip.files_parsed, skip.rows_output, skip.warnings, skip.validation_errors) == (4, good, 1, n) and good < 3
    with pytest.raises(ValueError):
        run(on_error="fail", max_errors=n - 1)
    assert run(on_error="fail", max_errors=n).rows_output == 3


def cell_of(row, name):
    return next((e.v.s if e.v.t != "n" else e.v.n for e in row.entries if e.k == name), None)


def test_process_file_and_dry_run(spark, folder):
    dry = Pipeline().process_file(spark, f"{folder}/in/a.pdf")
    assert dry.output is None and dry.records.count() == 1
    out = Pipeline(parser="invoice").process_file(spark, f"{folder}/in/a.pdf", f"{folder}/out")
    assert out.output == f"{folder}/out/a.csv"
    assert Pipeline(parser="report").process_file(spark, f"{folder}/in/a.pdf", f"{folder}/out", "json").output is None  # no rows, no file
    with pytest.raises(ValueError):
        get_parser("none")
    register_parser("titles", lambda docs, c: docs.select("file_ord", F.lit(0).alias("rec_ord"), F.col("file_name").alias("source_file"), F.lit("titles").alias("doc_type"), F.array(entry("t", text_cell(F.substring("text", 1, 7)))).alias("entries")))
    assert cell_of(Pipeline(parser="titles").process_file(spark, f"{folder}/in/a.pdf").records.first(), "t") == "Factura"


def test_records_as_variants(spark, records, tmp_path):
    """Written and read back: each record as it is, and columns with the types that an aggregate finds."""
    path = sinks.export(records, str(tmp_path), "out", "variant")
    back = spark.read.parquet(path)
    assert back.schema["record"].dataType.simpleString() == "variant"
    kinds = {f.name: f.dataType.simpleString() for f in sinks.variant_schema(back)}
    assert kinds["texto"] == "string" and kinds["b"] == "boolean" and set(kinds) == {"texto", "n", "_oculto", "b", "items"}
    wide = {(r.file_ord, r.rec_ord): r for r in sinks.widen_variants(back).collect()}
    assert wide[(0, 0)].texto == 'uno, "dos"' and wide[(0, 0)].n == 1.5 and wide[(0, 0)].b is True and json.loads(wide[(0, 0)]["items"]) == [{"q": 1}]
    assert wide[(0, 1)].texto is None and wide[(0, 1)].n == 2e12 and wide[(1, 0)].b is None and wide[(1, 0)].texto == "línea\nnueva"
    odd = one_record(spark, **{"it's a \\ name": 2.0, "o o": "x", '\'"': "both"})
    assert sinks.widen_variants(sinks.variant_rows(odd)).drop("file_ord", "rec_ord").first().asDict() == {"it's a \\ name": 2.0, "o o": "x", '\'"': "both"}
    assert len(sinks.variant_schema(sinks.variant_rows(odd.where("false")))) == 0 and "_oculto" not in sinks.variant_schema(sinks.variant_rows(records)).names


class Letter(TemplateParser):
    PARSER_NAME, PATTERNS = "letter", {"field1": r"Label1:\s*(.+)", "field2": r"Label2:\s*(\d+)"}
    REQUIRED_FIELDS, KEYWORDS = ("field1", "field2"), ("label1", "label2")


def test_template_parser(spark, folder, monkeypatch):
    """A parser declared by patterns: found by its keywords, its required fields validated, rules of its own where configured."""
    for registry in (PARSERS, DECLARED):  # it is forgotten after the test
        monkeypatch.setitem(registry, "letter", None)
    register_template(Letter)
    (folder / "in" / "letter.pdf").write_bytes(pdf("Label1:  expected_value\nLABEL2: 17 pages"))
    (folder / "in" / "empty.pdf").write_bytes(pdf("label1 and label2 without values"))
    docs = read_documents(spark, DocumentSource(f"{folder}/in"))
    got = {r.source_file: r for r in Pipeline().parse(docs).where("doc_type = 'letter'").collect()}
    assert sorted(got) == ["empty.pdf", "letter.pdf"] and cell_of(got["letter.pdf"], "field1") == "expected_value" and cell_of(got["letter.pdf"], "field2") == 17.0
    assert [(e.field, e.code) for e in got["letter.pdf"].errors] == [("field2", "type_string")]  # a required field is a text, unless a rule says otherwise
    assert [(e.field, e.code) for e in got["empty.pdf"].errors] == [("field1", "required"), ("field2", "required")]
    c = from_dict({"parsers": {"letter": {"keywords": ["label1", "label2"], "validation": {"field2": {"type": "number", "min": 100}}}}})
    ruled = {r.source_file: [(e.field, e.code) for e in r.errors] for r in Pipeline(c).parse(docs).where("doc_type = 'letter'").collect()}
    assert ruled == {"letter.pdf": [("field2", "min")], "empty.pdf": [("field1", "required")]}
    assert Pipeline(parser="letter").parse(docs.where("false")).count() == 0


def test_template_fields_in_sql(spark):
    name = register_template_fields(spark)
    docs = spark.createDataFrame([(1, "A: x \nb: 2"), (2, None), (3, "a:   \nB: y")], "k int, text string")
    rows = spark.sql(f"SELECT k, first, second, bare FROM {{d}}, LATERAL {name}(text, first => 'A:[ ]*(.*)', second => 'b: (\\\\d)', bare => 'b: .')", d=docs).collect()
    assert sorted(rows) == [(1, "x", "2", "b: 2"), (2, None, None, None), (3, None, None, "B: y")]
    for call in ("text", "text, a => lower(text)", "k, a => 'x'", "text, a => '('"):
        with pytest.raises(Exception, match="pattern|text|parenthesis"):
            spark.sql(f"SELECT * FROM {{d}}, LATERAL {name}({call})", d=docs).collect()


@pytest.mark.parametrize("write", [sinks.write_csv, sinks.write_json, sinks.write_json_document])
def test_an_export_that_fails_leaves_the_old_output(spark, tmp_path, write):
    path = f"{tmp_path}/out.data"
    good = one_record(spark, total=1.0, note="first")
    write(good, path)
    before = {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)}
    fails = F.when(F.col("rec_ord") == 3, F.raise_error(F.lit("half way"))).otherwise(F.lit("f"))
    bad = one_record(spark, total=2.0, note="second").withColumn("rec_ord", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("entries", F.transform("entries", lambda e: F.struct(e["k"].alias("k"), F.struct(e["v"]["t"].alias("t"), F.coalesce(fails, e["v"]["s"]).alias("s"), e["v"]["n"].alias("n")).alias("v"))))
    with pytest.raises(Exception, match="half way"):
        write(bad, path)
    assert {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)} == before and os.listdir(tmp_path) == ["out.data"]
    write(one_record(spark, total=3.0, note="third"), path)
    assert "third" in "".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("part-")) and os.listdir(tmp_path) == ["out.data"]


@pytest.fixture
def records(spark):
    rows = spark.createDataFrame([(0, 0, "uno, \"dos\"", 1.5, "x", True), (0, 1, None, 2e12, "y", False), (1, 0, "línea\nnueva", None, "z", None)], "f int, r int, texto string, n double, oculto string, b boolean")
    flag = F.struct(F.when(F.col("b").isNotNull(), "b").alias("t"), F.col("b").cast("string").alias("s"), F.lit(None).cast("double").alias("n"))
    cells = F.array(entry("texto", text_cell(F.col("texto"))), entry("n", number_cell(F.col("n"))), entry("_oculto", text_cell(F.col("oculto"))), entry("b", flag), entry("items", json_cell(F.lit('[{"q": 1}]'))))
    return rows.select(F.col("f").alias("file_ord"), F.col("r").alias("rec_ord"), F.lit("f").alias("source_file"), F.lit("report").alias("doc_type"), cells.alias("entries"))


def lines_of(path):
    return [x for name in sorted(os.listdir(path)) if name.startswith("part-") for x in open(f"{path}/{name}", encoding="utf-8").read().splitlines()]


def test_csv(spark, records, tmp_path):
    path = sinks.write_csv(records, f"{tmp_path}/a.csv")
    back = spark.read.csv(path, header=True, multiLine=True, escape='"')
    assert back.columns == ["texto", "n", "b", "items"]
    assert sorted(tuple(r) for r in back.fillna("").collect()) == sorted([('uno, "dos"', "1.5", "true", '[{"q": 1}]'), ("", "2000000000000.00", "false", '[{"q": 1}]'), ("línea\nnueva", "", "", '[{"q": 1}]')])
    o = sinks.CsvOptions(delimiter=";", include_header=False, quoting="all", include_internal_fields=True)
    first = lines_of(sinks.write_csv(records.where("rec_ord = 1"), f"{tmp_path}/b.csv", o))
    assert first == ['"";"2000000000000.00";"y";"false";"[{""q"": 1}]"']
    rendered = {q: sinks.csv_lines(records.where("file_ord = 0 AND rec_ord = 0"), sinks.CsvOptions(quoting=q)).first().line for q in ("minimal", "all", "none", "nonnumeric")}
    assert rendered["minimal"].startswith('"uno, ""dos""",1.5,true,') and rendered["all"].startswith('"uno, ""dos""","1.5","true"') and rendered["none"].startswith('uno, "dos",1.5') and rendered["nonnumeric"].startswith('"uno, ""dos""",1.5,"true"')


def test_json(spark, records, tmp_path):
    rows = [json.loads(x) for x in lines_of(sinks.write_json(records, f"{tmp_path}/a.json"))]
    assert rows == [{"texto": 'uno, "dos"', "n": 1.5, "b": True, "items": [{"q": 1}]}, {"texto": None, "n": 2e12, "b": False, "items": [{"q": 1}]}, {"texto": "línea\nnueva", "n": None, "b": None, "items": [{"q": 1}]}]
    index = [json.loads(x) for x in lines_of(sinks.write_json(records, f"{tmp_path}/b.json", "index", True))]
    assert [x["index"] for x in index] == ["0-0", "0-1", "1-0"] and index[0]["record"]["_oculto"] == "x"
    columns = [json.loads(x) for x in lines_of(sinks.write_json(records, f"{tmp_path}/c.json", "columns"))]
    assert {(c["name"], c["file"]): c["values"] for c in columns}["n", 0] == [1.5, 2e12] and len(columns) == 8
    whole = lambda **o: json.loads("\n".join(lines_of(sinks.write_json_document(records, f"{tmp_path}/{uuid.uuid4().hex}", **o))))
    assert whole() == rows and whole(orient="index") == {str(k): r for k, r in enumerate(rows)}
    assert whole(orient="columns") == {k: [r[k] for r in rows] for k in rows[0]}
    assert json.loads("".join(lines_of(sinks.write_json_document(records.where("false"), f"{tmp_path}/e")))) == []
    envelope = json.loads("".join(lines_of(sinks.with_envelope(records, f"{tmp_path}/f", source="here"))))
    assert envelope["metadata"]["record_count"] == 3 and envelope["metadata"]["source"] == "here" and envelope["data"][0]["_oculto"] == "x"
    assert read_output(spark, f"{tmp_path}/a.json", "json", 2).count() == 2


def test_export(spark, records, tmp_path):
    paths = sinks.export_all({"one": records, "none": records.where("false")}, str(tmp_path))
    assert paths == {"one": f"{tmp_path}/one.csv", "none": None}
    sinks.register_sink("count", lambda r, path, **o: f"{path}:{r.count()}")
    assert sinks.export(records, str(tmp_path), "x", "count") == f"{tmp_path}/x.count:3"
    del sinks.SINKS["count"]
    with zipfile.ZipFile(sinks.write_xlsx(records, f"{tmp_path}/s.xlsx")) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert "<v>1.5</v>" in sheet and "Yes" in sheet and sheet.count("<row>") == 4
    shapes = spark.createDataFrame([("$1,200.50",), ("2024-03-05",), ("31/12/2024",), ("word",), ("true",)], "s string").select(sinks.sheet_cell(text_cell(F.col("s"))).alias("v")).collect()
    assert [(r.v.t, r.v.s, r.v.n) for r in shapes] == [("n", None, 1200.5), ("s", "2024-03-05", None), ("s", "2024-12-31", None), ("s", "word", None), ("s", "true", None)]
    assert {r[0] for r in distinct_values(records, "texto").collect()} == {'uno, "dos"', "línea\nnueva"}


def test_watch_folder(spark, folder):
    source, out, log = DocumentSource(f"{folder}/in"), f"{folder}/table", f"{folder}/log"
    watch_folder(spark, source, out, log, once=True).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (folder / "in" / "e.pdf").write_bytes(pdf(INVOICE.format(n=9)))
    watch_folder(spark, source, out, log, once=True).awaitTermination()
    got = spark.read.parquet(out)
    assert sorted(cell_of(r, "invoice_id") for r in got.collect()) == ["INV-1", "INV-2", "INV-9"]
    assert spark.read.parquet(f"{out}-errors").count() == 0


def test_watch_folder_knows_earlier_records(spark, folder):
    """The same invoice in two batches is one record, after a restart too, and again when its key is too old."""
    source, out, log = DocumentSource(f"{folder}/in"), f"{folder}/table", f"{folder}/log"
    run = lambda **more: watch_folder(spark, source, out, log, once=True, **more).awaitTermination()
    run()
    (folder / "in" / "again.pdf").write_bytes(pdf(INVOICE.format(n=2)))
    (folder / "in" / "new.pdf").write_bytes(pdf(INVOICE.format(n=7)))
    run()
    names = lambda: sorted(cell_of(r, "invoice_id") for r in spark.read.parquet(out).collect())
    assert names() == ["INV-1", "INV-2", "INV-7"]
    (folder / "in" / "third.pdf").write_bytes(pdf(INVOICE.format(n=7)))
    run(keep_days=0.0)
    assert names() == ["INV-1", "INV-2", "INV-7", "INV-7"]


def test_watch_folder_waits_until_files_stand_still(spark, folder):
    """A file that grows between triggers is read once, whole."""
    inbox, out = folder / "slow", f"{folder}/slow-table"
    inbox.mkdir()
    whole = pdf(INVOICE.format(n=5), "second page")
    query = watch_folder(spark, DocumentSource(str(inbox)), out, f"{folder}/slow-log", settle=4.0, interval="500 milliseconds")
    try:
        (inbox / "grows.pdf").write_bytes(whole[:300])
        (inbox / "gone.pdf").write_bytes(b"x")
        for k in range(300, len(whole) + 200, 200):
            time.sleep(1.5)
            (inbox / "grows.pdf").write_bytes(whole[: k + 200])
            (inbox / "gone.pdf").unlink(missing_ok=True)
        began = time.time()
        while time.time() < began + 90 and not list((folder / "slow-table-errors").glob("batch=*/_SUCCESS")):  # the last that a batch writes
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.read.parquet(out).collect()
    assert [(cell_of(r, "invoice_id"), r.source_file) for r in rows] == [("INV-5", "grows.pdf")]
    assert spark.read.parquet(f"{out}-errors").count() == 0


def test_jobs(spark, folder):
    jobs, seen = JobManager(spark, f"{folder}/jobs"), []
    good, bad = jobs.submit(f"{folder}/in/a.pdf"), jobs.submit(f"{folder}/in/none.pdf", kind="xlsx")
    for _ in range(600):
        seen.append(jobs.get(good).progress)
        if all(j.status in ("completed", "failed") for j in jobs.list()):
            break
        time.sleep(0.1)
    assert seen == sorted(seen) and len({p for p in seen if 10 < p < 90}) >= 3  # it rises on the way
    with pytest.raises(NoOutput):
        jobs.download(bad)
    for call in (jobs.get, jobs.download, jobs.delete, jobs.preview):
        with pytest.raises(UnknownJob):
            call("nobody")
    assert jobs.download(good) == jobs.get(good).output
    assert (jobs.get(good).status, jobs.get(good).progress, jobs.get(good).rows) == ("completed", 100, 1)
    assert jobs.get(bad).status == "failed" and jobs.get(bad).kind == "csv" and "none.pdf" in jobs.get(bad).error
    assert jobs.preview(good).first().invoice_id == "INV-1"
    with pytest.raises(ValueError):
        jobs.preview(bad)
    path = jobs.get(good).output
    jobs.delete(good)
    assert not os.path.exists(path) and [j.id for j in jobs.list()] == [bad]
    assert {"auto", "invoice", "report", "financial_report"} <= set(catalog()["parsers"])


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text(
        "parsers:\n  invoice:\n    keywords: [factura, nota]\n    validation:\n      total: {type: number, min: 0, required: true}\n  report: {enabled: false, min_columns: 3}\n"
        "normalization:\n  dates: {input_formats: ['%d.%m.%Y'], output_format: '%d/%m/%Y'}\nvalidation: {on_error: fail, max_errors: 2, rules: {valid_dates: false}}\n"
        "deduplication: {key_columns: [invoice_id], keep: last}\noutput:\n  csv: {delimiter: ';'}\n  json: {orient: index}\nextraction: {max_pages: 5}\n"
    )
    c = load(str(tmp_path / "c.yaml"))
    assert c.terms() == {"invoice": ("factura", "nota")} and c.min_columns == 3 and c.date_formats == ("d.M.yyyy",) and c.date_output == "dd/MM/yyyy"
    assert {r.name: r.required for r in c.rules_of("invoice")} == {"total": True, "invoice_id": True, "date": True}
    assert (c.validation.on_error, c.validation.max_errors, c.validation.global_rules.valid_dates) == ("fail", 2, False)
    assert (c.key_columns, c.keep, c.csv.delimiter, c.json_orient, c.max_pages) == (("invoice_id",), "last", ";", "index", 5)
    (tmp_path / "empty.yaml").write_text("# nothing\n")
    assert load(str(tmp_path / "empty.yaml")) == from_dict(None) == from_dict({})
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.yaml"))
    with pytest.raises(ValueError):
        from_dict({"parser": {}})
    assert spark_format("%d de %B de %Y") == "d' de 'MMMM' de 'yyyy"


def one_record(spark, **fields):
    cells = [entry(k, number_cell(F.lit(v)) if isinstance(v, (int, float)) else text_cell(F.lit(v))) for k, v in fields.items()]
    return spark.range(1).select(F.lit(0).alias("file_ord"), F.lit(0).alias("rec_ord"), F.lit("f").alias("source_file"), F.lit("invoice").alias("doc_type"), F.array(*cells).alias("entries"))


def test_validation_modes(spark):
    bad = one_record(spark, total=-1.0, date="soon", flag="x", id=" ")
    assert validate(bad, Validation(enabled=False)).first().errors == []
    with pytest.raises(ValueError):
        validate(bad, Validation(on_error="fail", max_errors=1))
    assert validate(bad, Validation(on_error="fail", max_errors=2)).count() == 1
    codes = lambda *rules, **k: [e.code for e in with_errors(bad, rules, **k).first().errors if not e.code.startswith("global")]
    assert codes(NonNegative("total"), Required("id"), InRange("total", 0, 5)) == ["min", "required", "min"]
    assert codes(FieldRule("flag", type="boolean")) == ["type_boolean"]
    assert codes(typed={"invoice": [FieldRule("none", required=True)], "report": [FieldRule("id", required=True)]}) == ["required"]
    assert [r.rec_ord for r in renumber(bad.withColumn("rec_ord", F.lit(7))).collect()] == [0]


def test_dates_and_texts(spark):
    x = spark.createDataFrame([("5 de marzo de 2024",), ("5 mar 2024",), ("March 5, 2024",), ("no date",), ("05/03/2024",), ("31/02/2024",)], "s string")
    got = [r[0] for r in x.select(dates.normal_date(F.col("s"))).collect()]
    assert got == ["2024-03-05", "2024-03-05", "2024-03-05", "no date", "2024-03-05", "31/02/2024"]
    t = spark.createDataFrame([("Intro\nNOTAS uno\ndos\nActivo tres\nnotas cuatro", "5 de marzo de 2024 x\nEmision 1", "uno 1,200.50\ndos $3")], "a string, b string, c string")
    r = t.select(text.split_sections(F.col("a"), ["^notas", "^activo"]).alias("s"), invoice.header_fields(F.col("b"))["date"].alias("d"), invoice.short_items(F.col("c")).alias("i")).first()
    assert r.s == {"notas": "cuatro", "activo": "tres"} and r.d == "5 de marzo de 2024"
    assert [tuple(i) for i in r.i] == [("uno", "1,200.50"), ("dos", "3")]
    m = spark.createDataFrame([("Reporte de ventas\nFecha: 01/02/2024\nPagina 2 de 7", "Acme Corp.\nal 31 de marzo de 2024\n(cifras en millones)")], "a string, b string")
    r = m.select(report.metadata(F.col("a")).alias("m"), financial_metadata(F.col("b")).alias("f")).first()
    assert (r.m.report_date, r.m.current_page, r.m.total_pages) == ("01/02/2024", "2", "7") and (r.f.report_date, r.f.currency_unit) == ("31 de marzo de 2024", "millones")
    n = normalize(one_record(spark, **{"Fecha": "5 mar 2024", "Año": "ﬁn é"})).first()
    assert cell_of(n, "fecha") == "2024-03-05" and cell_of(n, "año") == "ﬁn é"


def test_dedup_keep(spark):
    a, b = one_record(spark, k="x", v="1"), one_record(spark, k="x", v="2").withColumn("rec_ord", F.lit(1))
    both = a.unionByName(b)
    assert [cell_of(r, "v") for r in deduplicate(both, ("k",)).collect()] == ["1"]
    assert [(r.rec_ord, cell_of(r, "v")) for r in deduplicate(both, ("k",), "last").collect()] == [(0, "2")]
    assert [cell_of(r, "v") for r in deduplicate(both, ("k",), "any other").collect()] == ["1"]
    assert both.select(cell("entries", "k")["s"]).count() == 2 and len(RECORD) > 0
