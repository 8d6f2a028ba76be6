"""Readers, writers and streams on files of their own."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.sources import records
from docketry.streaming import jobs


def test_metadata(spark, tmp_path):
    html = '<button aria-label="Ram v. State pdf">x</button><td class="caseDetailsTD">Decision Date : 01-02-2024 | Case No : C.A. 5 | Disposal Nature : Allowed | Bench : 2 Judges</td>'
    (tmp_path / "a.json").write_text(json.dumps({"raw_html": html, "nc_display": "2024 INSC 1", "path": "p", "citation_year": "2024"}, indent=1))
    (tmp_path / "metadata.index.json").write_text("{}")
    (r,) = records.metadata_scan(spark, str(tmp_path)).collect()
    assert (r.stem, r.case_name, r.decision_date, r.disposal_nature, r.bench) == ("a", "Ram v. State", "01-02-2024", "Allowed", "2 Judges")
    listing = spark.createDataFrame([("a.pdf",), ("a_EN.pdf",)], "file string")
    assert records.find_pdf(spark.createDataFrame([("a",), ("b",)], "stem string"), listing).orderBy("stem").collect() == [("a", "a_EN.pdf"), ("b", None)]


def test_lines(spark, tmp_path):
    p = tmp_path / "cases.jsonl"
    p.write_text('{"case_id": "1"}\n\n{broken\n{"case_id": "2"}\n')
    schema = records.T.StructType([records.T.StructField("case_id", records.T.StringType())])
    assert sorted(r.case_id for r in records.read_lines(spark, str(p), schema, strict=False).collect() if r.case_id) == ["1", "2"]
    assert [r.line for r in records.damaged_lines(spark, str(p), schema).collect()] == ["{broken"]


def test_missing_file(spark, tmp_path):
    schema = records.T.StructType([records.T.StructField("case_id", records.T.StringType())])
    assert records.read_lines(spark, str(tmp_path / "none.jsonl"), schema, strict=False).count() == 0
    assert records.exists(spark, str(tmp_path)) and not records.exists(spark, str(tmp_path / "none"))


def test_lists_and_nested_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"text": "a", "intent": "X", "group": 3}, {"text": "b\nc", "intent": "Y", "group": 4}], indent=1))
    assert {(r.text, r.group) for r in records.read_list(spark, str(tmp_path / "q.json"), "text string, intent string, `group` int").collect()} == {("a", 3), ("b\nc", 4)}
    (tmp_path / "l.json").write_text(json.dumps({"q1": {"c1": {"grade": 2}, "c2": {"grade": 0}}, "q2": {}}))
    got = records.read_nested(spark, str(tmp_path / "l.json")).collect()
    assert {(r.outer, r.inner, json.loads(r.value)["grade"]) for r in got} == {("q1", "c1", 2), ("q1", "c2", 0)}
    run = spark.createDataFrame([("s", "q2", ["c", "a"]), ("s", "q1", ["b"]), ("t", "q1", [])], "system string, qid string, docs array<string>")
    lines = {json.dumps(json.loads(r.value)) for r in records.nested(run, "system", "qid", "docs").collect()}
    assert lines == {'{"s": {"q1": ["b"], "q2": ["c", "a"]}}', '{"t": {"q1": []}}'}


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("first é\fsecond\f".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    pages = records.page_texts(spark, str(tmp_path))
    assert {r.file: r.pages for r in pages.collect()} == {"a.txt": ["first é", "second", ""]}
    assert {(r.file, r.page, r.chars, r.total) for r in records.inspect_pages(pages).collect()} == {("a.txt", 0, 7, 13), ("a.txt", 1, 6, 13), ("a.txt", 2, 0, 13)}
    pdf = spark.createDataFrame([(bytearray(b"%PDF /Type /Pages /Type/Page x /Type /Page /Subtype /Image"),)], "content binary")
    (r,) = records.pdf_images(pdf).collect()
    assert (r.pages, r.images) == (2, 1)


def test_stable_order(spark, tmp_path):
    df = spark.range(2000).repartition(7).withColumn("x", F.col("id") * 7 % 13)
    records.write_records(df, str(tmp_path / "o"), order="id")
    files = sorted((tmp_path / "o").glob("*.parquet"))
    ids = [r.id for f in files for r in spark.read.parquet(str(f)).collect()]
    assert ids == sorted(ids) and len(ids) == 2000


def test_late_events(spark, tmp_path):
    """Rows behind the watermark are dropped; windows close once and hold the rest."""
    from datetime import datetime, timedelta

    start, schema = datetime(2024, 1, 1), "ts timestamp, event_type string"
    for n, days in enumerate(([0, 0, 1], [9, 9], [8], [0, 9], [40])):
        spark.createDataFrame([(start + timedelta(days=d, hours=3), "a") for d in days], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = jobs.windowed_counts(stream).writeStream.outputMode("append").foreachBatch(lambda b, i: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    counts = {(r.start - start).days: r.n for r in out}
    assert counts == {0: 2, 1: 1, 8: 1, 9: 3}


def test_writers(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") / 3)
    for form in ("parquet", "json", "csv"):
        records.write_records(df, str(tmp_path / form), form=form, order="id")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5
    with pytest.raises(ValueError):
        records.markdown_table(spark.range(5), most=4)
    assert records.markdown_table(spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")).splitlines()[2:] == ["| 1 | — |", "| 2 | 0.500 |"]


def test_streams(spark, tmp_path):
    schema = "qid string, doc int, grade int, time int"
    spark.createDataFrame([("q", 1, 0, 1), ("q", 1, 2, 5)], schema).write.parquet(str(tmp_path / "in"))
    s = jobs.start_label_log(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
    s.awaitTermination()
    assert [(r.doc, r.grade) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, 2)]
