"""Readers and writers of records: metadata JSON, JSON lines, index tables, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.operators.corpus import extract_metadata

#: Raw metadata, one JSON file for each judgment.
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("raw_html", "nc_display", "path", "citation_year")])
#: Judgments as they are kept.
JUDGMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("case_id", "case_name", "neutral_citation", "citation_year", "decision_date", "case_number", "disposal_nature", "bench", "scr_citation")]
    + [T.StructField("judges", T.ArrayType(T.StringType())), T.StructField("author", T.StringType()), T.StructField("page_count", T.IntegerType()), T.StructField("source_pdf", T.StringType()), T.StructField("sections", T.MapType(T.StringType(), T.StringType())), T.StructField("text", T.StringType())]
)


def metadata_scan(spark: SparkSession, folder: str) -> DataFrame:
    """METADATA columns, file, stem, and the fields of the page; the index file is no record."""
    raw = spark.read.schema(METADATA).json(f"{folder}/*.json", multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    raw = raw.where("file <> 'metadata.index.json'").withColumn("stem", F.regexp_replace("file", r"\.json$", ""))
    return raw.withColumns(extract_metadata(F.col("raw_html")))


def find_pdf(records: DataFrame, listing: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds pdf: <stem>_EN.pdf if listed, else <stem>.pdf, else null.  listing(file)."""
    en = listing.select(F.col("file").alias("_en"))
    plain = listing.select(F.col("file").alias("_plain"))
    r = records.join(en, F.concat(F.col(stem), F.lit("_EN.pdf")) == F.col("_en"), "left").join(plain, F.concat(F.col(stem), F.lit(".pdf")) == F.col("_plain"), "left")
    return r.withColumn("pdf", F.coalesce("_en", "_plain")).drop("_en", "_plain")


def page_texts(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """file, pages: extracted page texts, separated by form feeds; an empty file has no row."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.split(F.decode("content", "UTF-8"), "\f").alias("pages"))


def inspect_pages(pages: DataFrame) -> DataFrame:
    """file, page, chars and the file's total."""
    p = pages.select("file", F.posexplode("pages").alias("page", "t"), F.aggregate("pages", F.lit(0), lambda s, x: s + F.length(x)).alias("total"))
    return p.select("file", "page", F.length("t").alias("chars"), "total")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p))


def read_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines.  Strict: a damaged line or a missing file fails; else both are left out (see ``damaged_lines``).  Blank lines are skipped."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_list(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON file that holds one array of records: retrieval queries (id, text, intent, split, need) or intent queries (text, intent, group)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """outer, inner, value of a JSON file {outer: {inner: record}}: labels by query and case, runs by system and query."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    return raw.select(F.explode("m").alias("outer", "rest")).select("outer", F.explode("rest").alias("inner", "value"))


def nested(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """value: a run or label table as JSON lines {outer: {inner: [values in order]}}, one line for each ``outer``; ``value`` is a column of arrays."""
    by = df.groupBy(outer).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(inner).cast("string"), F.col(value))))).alias("m"))
    return by.select(F.to_json(F.map_from_arrays(F.array(F.col(outer).cast("string")), F.array("m"))).alias("value"))


def pdf_images(binary: DataFrame, content: str = "content") -> DataFrame:
    """Adds pages and images: how many page and image objects a PDF's uncompressed structure names (0 where it is compressed)."""
    raw = F.decode(content, "ISO-8859-1")
    return binary.withColumn("pages", F.regexp_count(raw, F.lit(r"/Type\s*/Page(?![a-zA-Z])"))).withColumn("images", F.regexp_count(raw, F.lit(r"/Subtype\s*/Image(?![a-zA-Z])")))


def damaged_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that are no record."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record IS NOT NULL").select(F.col("r._corrupt_record").alias("line"))


def write_records(df: DataFrame, path: str, *, form: str = "parquet", order: str | None = None, by: list[str] | None = None) -> None:
    """Overwrites ``path`` in one of parquet, json, csv; rows range-ordered by ``order``, folders by ``by``."""
    out = (df.orderBy(order) if order else df).write.mode("overwrite")
    out = out.partitionBy(*by) if by else out
    (out.option("header", True) if form == "csv" else out).format(form).save(path)


def missing_downloads(wanted: DataFrame, present: DataFrame, limit: int = 100) -> DataFrame:
    """The next files to fetch: wanted(file) not yet present(file, size) with content, by name."""
    return wanted.join(present.where("size > 0").select("file"), "file", "left_anti").orderBy("file").limit(limit)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small report table; null as a dash, numbers with three decimals.  More than ``most`` rows are an error."""
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows: write them as a table")
    lines = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """bin (from 1), n: the numbers behind a histogram figure."""
    return df.select(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
