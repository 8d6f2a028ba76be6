"""Tables behind a service: health, one case with its links, label cards, search snippets, saved evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.functions.text import split_sentences, tokenize


def health(docs: DataFrame, **tables: DataFrame) -> DataFrame:
    """table, rows: how much of each table a service has loaded."""
    out = docs.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("docs").alias("table"), "rows")
    for name, df in tables.items():
        out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return out


def case(docs: DataFrame, links: DataFrame, wanted, *, key: str = "doc") -> DataFrame:
    """The one row of ``wanted`` with ``cites`` and ``cited_by`` (sorted keys).  Raises KeyError for a key that does not exist."""
    row = docs.where(F.col(key) == F.lit(wanted))
    if row.isEmpty():
        raise KeyError(wanted)
    out = links.where(F.col("src") == F.lit(wanted)).agg(F.sort_array(F.collect_set("dst")).alias("cites"))
    back = links.where(F.col("dst") == F.lit(wanted)).agg(F.sort_array(F.collect_set("src")).alias("cited_by"))
    return row.crossJoin(out).crossJoin(back)


def label_cards(pool: DataFrame, docs: DataFrame, citations: DataFrame, intents: DataFrame, named: DataFrame, *, lines: int = 5, issue: int = 600) -> DataFrame:
    """What an assessor sees of each pair of pool(qid, doc): the document's fields, the issue cut to ``issue`` characters, and up to ``lines`` cited lines.

    citations(doc, pos, key, name, treatment, polarity), intents(qid, intent), named(qid, key).  The lines are those that cite a precedent
    the query names; for precedent intents those whose polarity is not neutral count too.
    """
    rows = pool.select("qid", "doc").join(intents, "qid", "left").join(citations, "doc")
    hit = named.select("qid", "key").distinct().withColumn("hit", F.lit(True))
    rows = rows.join(hit, ["qid", "key"], "left")
    counts = F.coalesce("hit", F.lit(False)) | (F.col("intent").endswith("PRECEDENT") & (F.col("polarity") != "neutral"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "name", "treatment")))
    cited = rows.where(counts).groupBy("qid", "doc").agg(F.transform(F.slice(ordered, 1, lines), lambda x: F.concat_ws(" - ", x["name"], x["treatment"])).alias("cited"))
    fields = docs.withColumn("issue", F.substring("issue", 1, issue)) if "issue" in docs.columns else docs
    out = pool.select("qid", "doc").join(fields, "doc").join(cited, ["qid", "doc"], "left")
    return out.withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))


def snippet(rows: DataFrame, *keys: str, text: str = "text", terms: str = "terms", generic: str = "generic", phrases: str = "phrases", longest: int = 450) -> DataFrame:
    """keys, at, snippet: the best sentence of each text with its neighbours while they fit; always a struct of both.

    A sentence scores 2 for each distinctive term, 0.25 for each generic one, 5 for each phrase (6 for one of over two words), and
    0.25 if it has over eight words.  terms, generic, phrases: arrays of lower-case strings; ties go to the first sentence.
    """
    parts = rows.select(*keys, terms, generic, phrases, F.posexplode(split_sentences(F.col(text))).alias("at", "s"))
    own = parts.withColumn("t", F.array_distinct(tokenize(F.col("s"))))
    hits: Column = F.aggregate(F.filter(phrases, lambda p: F.contains(F.lower("s"), p)), F.lit(0.0), lambda a, p: a + 5.0 + F.when(F.size(F.split(p, " ")) > 2, 1.0).otherwise(0.0))
    score = 2.0 * F.size(F.array_intersect("t", terms)) + 0.25 * F.size(F.array_intersect("t", generic)) + hits + F.when(F.size(F.split("s", " ")) > 8, 0.25).otherwise(0.0)
    w = Window.partitionBy(*keys)
    best = own.withColumn("score", score).withColumn("r", F.row_number().over(w.orderBy(F.col("score").desc(), "at"))).where("r = 1").select(*keys, F.col("at").alias("best"))
    near = parts.join(best, list(keys)).select(*keys, "best", "at", "s")
    # sentences by their distance from the best one, the next before the previous; they are taken while all fit
    order = Window.partitionBy(*keys).orderBy(F.abs(F.col("at") - F.col("best")), F.col("at").desc())
    fits = near.withColumn("sum", F.sum(F.length("s") + 1).over(order)).where((F.col("sum") <= longest + 1) | (F.col("at") == F.col("best")))
    out = fits.groupBy(*keys).agg(F.min("best").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), " ").alias("snippet"))
    return out.withColumn("snippet", F.when(F.length("snippet") > longest, F.concat(F.substring("snippet", 1, longest), F.lit("…"))).otherwise(F.col("snippet")))


def positive_or_any(scores: DataFrame, k: int, *, by: str, tie: str, positive: bool) -> DataFrame:
    """The pilot's two conventions: a search lists positive similarities only, its evaluation the ``k`` best of any sign."""
    from docketry.operators.retrieval import top_k

    return top_k(scores, k, by=by, tie=tie, positive=positive)


def best_model(scores: DataFrame) -> DataFrame:
    """scores(model, f1): the model of greatest F1 (9 places); of equal ones logreg, then the smaller name."""
    order = F.struct(F.round("f1", 9).alias("f"), (F.col("model") == "logreg").alias("plain"))
    top = scores.withColumn("o", order)
    return top.groupBy().agg(F.max_by(F.struct("model", "f1"), F.struct("o", F.transform(F.split("model", ""), lambda c: -F.ascii(c)))).alias("x")).select("x.*")


class Recompute:
    """Runs one recomputation at a time; ``state`` says how the last one went."""

    def __init__(self, job: Callable[[], None]):
        import threading

        self._job, self._lock, self.state = job, threading.Lock(), {"status": "idle", "error": None}

    def start(self) -> bool:
        """Runs the job unless one is running; whether it ran."""
        if not self._lock.acquire(blocking=False):
            return False
        try:
            self.state = {"status": "running", "error": None}
            self._job()
            self.state = {"status": "done", "error": None}
        except Exception as e:  # the state tells the caller, who did not wait
            self.state = {"status": "failed", "error": str(e)}
        finally:
            self._lock.release()
        return True
