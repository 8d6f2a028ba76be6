"""From raw records to judgments: page lines, sections, result line, front matter, validation, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.operators.evaluate import ordered


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos (from 0), line, trimmed."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line"))


# Page heads, the line that opens a report, marks of the author.
HEADER = r"^(?:\[\d{4}\]\s+\d+\s+S\.\s?C\.\s?R\.?\s*(?:\d+)?\s*|Digital Supreme Court Reports)$"
TITLE_LINE = r"^\[(\d{4})\]\s+(\d+)\s+S\.\s?C\.\s?R\.?\s+(\d+)\s*:\s*(.+)$"
AUTHOR_MARKS = ("* Author", "*Author")


def clean_lines(docs: DataFrame, key: str, text: str = "text", header: str = HEADER) -> DataFrame:
    """key, pos, line without NUL and BS, running titles, page heads, page numbers near them, marks of the author, and blanks.

    A running title is the same line three times or more, with " v " or " v. " in it and under 160 characters.
    """
    bare = docs.withColumn(text, F.regexp_replace(text, "[\\x00\\x08]", ""))
    w = Window.partitionBy(key, "line")
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-2, 2)
    marked = lines(bare, key, text).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("head", F.col("line").rlike(header).cast("int")).withColumn("close", F.max("head").over(near))
    title = (F.col("n") >= 3) & F.col("line").rlike(r"\sv\.?\s") & (F.length("line") < 160)
    number = F.col("line").rlike(r"^\d{1,4}$") & (F.col("close") == 1)
    return marked.where(~title & (F.col("head") == 0) & ~number & (F.col("line") != "") & ~F.col("line").isin(*AUTHOR_MARKS)).select(key, "pos", "line")


def report_citation(text: Column) -> Column:
    """"[year] volume SCR page" of the first of a text's first five lines that is a report's title line, else null."""
    first = F.transform(F.slice(F.split(F.regexp_replace(text, "[\\x00\\x08]", ""), "\n", -1), 1, 5), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    line = F.get(F.filter(first, lambda x: x.rlike(TITLE_LINE)), F.lit(0))
    part = lambda i: F.regexp_extract(line, TITLE_LINE, i)
    return F.when(line.isNotNull(), F.concat(F.lit("["), part(1), F.lit("] "), part(2), F.lit(" SCR "), part(3)))


def join_lines(docs: DataFrame, key: str) -> DataFrame:
    """Paragraph text from cleaned lines(key, pos, line).

    "12." and "(iv)" start a new line.  A hyphen at a line's end joins; it goes if the joined word occurs elsewhere in
    the document.
    """
    rows = docs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("a"))
    words = F.array_distinct(F.flatten(F.transform("a", lambda x: F.split(F.lower(x["line"]), r"[^\p{L}]+"))))

    def step(acc: Column, x: Column) -> Column:
        line = x["line"]
        starts = line.rlike(r"^(?:\d{1,3}\.|\([ivxlc]+\))\s")
        tail, head = F.regexp_extract(acc, r"([\p{L}]+)-$", 1), F.regexp_extract(line, r"^([\p{L}]+)", 1)
        whole = F.array_contains(F.col("vocab"), F.lower(F.concat(tail, head)))
        hyphen = (tail != "") & (head != "")
        return F.when(acc == "", line).when(starts, F.concat(acc, F.lit("\n"), line)).when(hyphen & whole, F.concat(F.regexp_replace(acc, "-$", ""), line)).when(hyphen, F.concat(acc, line)).otherwise(F.concat(acc, F.lit(" "), line))

    return rows.withColumn("vocab", words).select(key, F.aggregate("a", F.lit(""), step).alias("text"))


# Section headings of the reports, in order, in lower case.
SECTIONS = (
    ("issue", r"^issues? for consideration\b"),
    ("headnotes", r"^head\s?notes?\s*†?\s*$"),
    ("case_law_cited", r"^case laws? cited\b"),
    ("acts", r"^list of acts\b"),
    ("keywords", r"^list of keywords\b"),
    ("case_arising_from", r"^case arising from\b"),
    ("appearances", r"^appearances for parties\b"),
    ("other_details", r"^other case details\b"),
    ("judgment", r"^judgment\s*/\s*order of the supreme court\b"),
)


def split_sections(cleaned: DataFrame, key: str, sections=SECTIONS) -> DataFrame:
    """key, section, text: each heading's first occurrence opens its section; a repeated heading is content.

    Lines before the first heading are the front matter; without a judgment heading they are the judgment.
    """
    low, name = F.lower(F.trim("line")), F.lit(None).cast("string")
    for label, pattern in reversed(sections):
        name = F.when(low.rlike(pattern), label).otherwise(name)
    rows = cleaned.withColumn("heading", name)
    rows = rows.withColumn("first", (F.row_number().over(Window.partitionBy(key, "heading").orderBy("pos")) == 1) & F.col("heading").isNotNull())
    running = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(F.col("first"), F.col("heading")), ignorenulls=True).over(running), F.lit("front_matter")))
    whole = F.max((F.col("heading") == "judgment").cast("int")).over(Window.partitionBy(key))
    rows = rows.withColumn("section", F.when((F.col("section") == "front_matter") & (F.coalesce(whole, F.lit(0)) == 0), "judgment").otherwise(F.col("section")))
    return rows.where(~F.col("first")).groupBy(key, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


# Credits of editors that stand among the words of a result, and the phrases of an outcome.
CREDITS = (r"[^.]*Hony\.?\s*(?:Associate Editor)?", r"\(Verified by[^)]*\)")
OUTCOME_PHRASE = r"(?i)((?:[A-Z][\w()’']*\s){0,6}?(?:allowed|dismissed|disposed of|answered|issued|referred to [^.]{0,80}|withdrawn|closed|quashed|set aside|remanded|rejected|granted|modified)(?:\s(?:with directions|in part|accordingly))?)"


def extract_result(text: Column) -> Column:
    """What follows the last "Result of the case:": without editors' credits the first outcome phrase of its 220 characters, else the first clause."""
    window = F.substring(F.element_at(F.split(text, r"Result of the [Cc]ase\s*:\s*"), -1), 1, 220)
    for credit in CREDITS:
        window = F.regexp_replace(window, credit, " ")
    found = F.regexp_extract(window, OUTCOME_PHRASE, 1)
    clause = F.regexp_extract(window, r"^\s*([^†.]+?)\s*(?:\.|†|Headnotes prepared|$)", 1)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(text.rlike(r"Result of the [Cc]ase\s*:"), F.when(found != "", F.regexp_replace(tidy(found), r"\.+$", "")).otherwise(tidy(clause))).otherwise("")


def parse_bench(text: Column) -> Column:
    """Struct(judges, author) of "[A, B* and C, JJ.]": an asterisk marks the author."""
    inner = F.regexp_extract(text, r"\[([^\]]*?),?\s*JJ?\.\]", 1)
    names = F.filter(F.transform(F.split(inner, r",|\band\b"), lambda x: F.trim(x)), lambda n: n != "")
    starred = F.filter(names, lambda n: n.contains("*"))
    clean = lambda n: F.trim(F.regexp_replace(F.regexp_replace(n, r"\*", ""), r",?\s*(?:CJI|JJ?\.?)$", ""))
    return F.struct(F.transform(names, clean).alias("judges"), F.when(F.size(starred) > 0, clean(starred[0])).alias("author"))


def extract_metadata(html: Column, labels: tuple[str, ...] = ("Decision Date", "Case No", "Disposal Nature", "Bench")) -> dict[str, Column]:
    """Case name from the first button whose aria-label ends in pdf; labelled fields of the details cell, each up to the next label."""
    button = F.regexp_extract(html, r"""(?is)<button[^>]*aria-label\s*=\s*["']([^"']*?)\s*pdf["']""", 1)
    cell = F.regexp_extract(html, r"""(?is)class\s*=\s*["'][^"']*caseDetailsTD[^"']*["'][^>]*>(.*?)</td>""", 1)
    plain = F.trim(F.regexp_replace(F.regexp_replace(cell, r"(?s)<[^>]*>", " "), r"\s+", " "))
    stop = "|".join(labels)
    out = {"case_name": F.nullif(F.trim(button), F.lit(""))}
    for label in labels:
        value = F.regexp_extract(plain, rf"{label}\s*:\s*(.*?)\s*\|?\s*(?:(?:{stop})\s*:|$)", 1)
        out[label.lower().replace(" ", "_")] = F.nullif(F.trim(value), F.lit(""))
    return out


def neutral_order(rows: DataFrame, neutral: str, path: str) -> DataFrame:
    """doc_ord from 0 by (year, number) of the neutral citation, (9999, 0) without one, then path."""
    y, n = F.regexp_extract(neutral, r"(\d{4})\s*INSC\s*(\d+)", 1), F.regexp_extract(neutral, r"(\d{4})\s*INSC\s*(\d+)", 2)
    keyed = rows.withColumn("_y", F.when(y != "", y.cast("int")).otherwise(9999)).withColumn("_n", F.when(n != "", n.cast("int")).otherwise(0))
    return ordered(keyed, "_y", "_n", path, name="doc_ord").drop("_y", "_n")


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def corpus_report(docs: DataFrame, text: str = "text", short: int = 1500) -> DataFrame:
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return docs.select(n.alias("n"), F.length(text).alias("c")).agg(
        F.count(F.lit(1)).alias("docs"), F.min("n").alias("min_words"), F.floor(F.percentile("n", F.lit(0.5))).alias("median_words"),
        F.floor(F.avg("n")).alias("mean_words"), F.max("n").alias("max_words"), F.sum("n").alias("words"), F.count_if(F.col("c") < short).alias("short_docs"),
    )


def section_coverage(sections: DataFrame, key: str, names: tuple[str, ...] = ("issue", "headnotes", "case_law_cited", "acts", "keywords", "judgment", "result")) -> DataFrame:
    """section, n: how many documents of sections(key, section, text) have each section with something in it."""
    wanted = sections.sparkSession.createDataFrame([(n,) for n in names], "section string")
    held = sections.where(F.trim("text") != "").groupBy("section").agg(F.count_distinct(key).alias("n"))
    return wanted.join(held, "section", "left").fillna(0, ["n"])


def completeness(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, n: how many rows have something in each field."""
    counts = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in fields])).alias("x")).select("x.*")


def validate(rows: DataFrame, key: str, required: tuple[str, ...], valid: dict[str, Column] | None = None) -> DataFrame:
    """Rows, distinct keys, duplicate keys, empty values of each required field, and rows that break each rule of ``valid`` (null: not judged)."""
    valid = valid or {}
    checks = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"empty_{c}") for c in required]
    checks += [F.count_if(~rule).alias(f"invalid_{name}") for name, rule in valid.items()]
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *checks)
    totals = [F.sum(c).alias(c) for c in (*[f"empty_{c}" for c in required], *[f"invalid_{c}" for c in valid])]
    return n.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("duplicate_keys"), *totals)
