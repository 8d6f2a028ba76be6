"""Cross-site boilerplate lines, in DataFrame operations only.

A HyperLogLog sketch of the sites on which each line occurs is built per line hash and merged by aggregation.
Lines whose estimate lies clearly over or under the limit are settled by it; those near it get an exact
distinct count.  Of a line on so many sites one document keeps its lines, that of the smallest key; all others lose them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dealt_join

MIN_SITES, NEAR, LG_K, MOST = 10, 0.2, 12, 50_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _worthy(line: Column, min_words: int) -> Column:
    """Whether a line has ``min_words`` words or more; blank lines are never boilerplate."""
    word, gap = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
    return line.rlike(word + (gap + word) * (max(1, min_words) - 1))


def line_hashes(text: Column, min_words: int = 1) -> Column:
    """Distinct hashes of the lines that can be boilerplate."""
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: _worthy(x, min_words)), lambda x: F.xxhash64(x)))


def spread_lines(docs: DataFrame, *, text: str = "text", site: str = "source", key: str = "doc_id", min_sites: int = MIN_SITES, near: float = NEAR, lg_k: int = LG_K, min_words: int = 1) -> DataFrame:
    """``h``, ``first``, ``docs``: hashes of lines on ``min_sites`` distinct sites or more, the smallest key that has them, on how many rows.

    A null site is one site of its own.
    """
    seen = docs.select(F.explode(line_hashes(F.col(text), min_words)).alias("h"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.col(key).alias("k"))
    est = seen.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("n"), F.min("k").alias("first"), F.count(F.lit(1)).alias("docs"))
    est = est.where(F.col("n") >= min_sites * (1 - near))
    sure = est.where(F.col("n") > min_sites * (1 + near)).select("h", "first", "docs")
    unsure = est.where(F.col("n") <= min_sites * (1 + near)).select("h", "first", "docs")
    # distinct first: a line on a third of all documents shrinks to its sites before it meets the others
    exact = seen.select("h", "site").distinct().join(unsure.select("h"), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h")
    return sure.union(unsure.join(exact, "h"))


def clean_lines(docs: DataFrame, *, text: str = "text", site: str = "source", key: str = "doc_id", leave: float | None = None, min_words: int = 1, most: int = MOST, **options) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, whatever their names), ``kept`` (what is left of the text), n_lines, n_spread, n_removed.

    Lines are split at U+000A.  n_spread: lines that another document keeps.  With ``leave`` (off by default) a document that would
    lose more than this share of its characters stays as it is, for a later stage that judges copies as wholes; n_spread still says so.
    Null and empty texts and blank lines stay as they are.  Repeated rows are treated alike; a row without a key loses the lines that
    some document with a key keeps.
    """
    spread = Scratch(docs.sparkSession, "lines").put(spread_lines(docs, text=text, site=site, key=key, min_words=min_words, **options))
    # a line may be on a third of all documents: its occurrences are dealt to several tasks; sum(docs) / most such lines at most
    total = spread.agg(F.sum("docs")).first()[0] or 0
    limit = max(most, total // 100_000)
    hot = [(r.h, r.tasks) for r in spread.where(F.col("docs") > limit).select("h", F.ceil(F.col("docs") / limit).cast("int").alias("tasks")).collect()]
    marked = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.explode(line_hashes(F.col(text), min_words)).alias("h"))
    later = dealt_join(marked, spread.select("h", "first"), "h", hot).where("first IS NOT NULL AND (k IS NULL OR k > first)")
    bad = later.groupBy("k", "th").agg(F.collect_set("h").alias("bad"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.xxhash64(text).alias("rh"))
    body = F.col("row")[text]
    both = rows.join(bad, F.col("row")[key].eqNullSafe(F.col("k")) & (F.col("rh") == F.col("th")), "left")
    left = F.filter(_lines(body), lambda x: ~(_worthy(x, min_words) & F.array_contains("bad", F.xxhash64(x))))
    both = both.withColumn("left", F.when(F.col("bad").isNotNull(), left)).withColumn("joined", F.array_join("left", "\n"))
    cut = F.col("bad").isNotNull()
    if leave is not None:
        cut = cut & (F.length(body) - F.length("joined") <= leave * F.length(body))
    n = F.size(_lines(body))
    lost = F.coalesce(n - F.size("left"), F.lit(0))
    return both.select(
        "row", F.when(cut, F.col("joined")).otherwise(body).alias("kept"), n.cast("long").alias("n_lines"),
        lost.cast("long").alias("n_spread"), F.when(cut, lost).otherwise(0).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """key, n_lines, n_spread, n_removed, kept_chars, kept_sha256 for every row (a null text counts as empty)."""
    kept = F.coalesce(F.col("kept"), F.lit(""))
    return clean_lines(docs, key=key, **options).select(F.col("row")[key].alias(key), "n_lines", "n_spread", "n_removed", F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"))


#: The same rows by exact counts.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
spread AS (
  SELECT line, min(doc_id) AS first FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 10),
m AS (
  SELECT l.*, s.line IS NOT NULL AND l.doc_id > s.first AS bad FROM l LEFT JOIN spread s ON l.line = s.line),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_spread,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS rest
  FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, n_spread, n_spread AS n_removed, length(rest) AS kept_chars, sha256(rest) AS kept_sha256 FROM d
"""
