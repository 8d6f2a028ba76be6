"""The label log and the case listing behind the service: upserts, confirmations, pages, overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry.config import INTENTS


def latest(log: DataFrame, *keys: str, time: str = "time") -> DataFrame:
    """The last entry of an append-only log for each key (ties by the whole row)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max(F.struct(time, *[c for c in rest if c != time])).alias("_m")).select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest])


def confirm_all(reviewed: DataFrame, draft: DataFrame, *keys: str) -> DataFrame:
    """Reviewed rows and the drafts of pairs that have no review."""
    return reviewed.unionByName(draft.join(reviewed.select(*keys), list(keys), "left_anti"))


def list_cases(cases: DataFrame, needle: str, fields: tuple[str, ...], order: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of the cases whose fields hold ``needle``, with the total."""
    if not 0 < limit <= 200:
        raise ValueError("limit must be 1 to 200")
    hit = F.lower(F.concat_ws(" ", *fields)).contains(needle.lower())
    found = cases.where(hit)
    return found.crossJoin(found.agg(F.count(F.lit(1)).alias("total"))).orderBy(order).offset(offset).limit(limit)


def overview(pool: DataFrame, draft: DataFrame, reviewed: DataFrame) -> DataFrame:
    """candidates, drafted, reviewed, relevant for each query."""
    n = lambda df, name: df.groupBy("qid").agg(F.count(F.lit(1)).alias(name))
    merged = reviewed.select("qid", "doc", F.col("grade").alias("r")).join(draft.select("qid", "doc", "grade"), ["qid", "doc"], "full_outer")
    relevant = merged.groupBy("qid").agg(F.count_if(F.coalesce("r", "grade") >= 1).alias("relevant"))
    out = n(pool, "candidates").join(n(draft, "drafted"), "qid", "left").join(n(reviewed, "reviewed"), "qid", "left").join(relevant, "qid", "left")
    return out.fillna(0)


def rank_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """qid, doc, rank_a, rank_b of two runs side by side."""
    x = a.select("qid", "doc", F.col("rank").alias("rank_a"))
    return x.join(b.select("qid", "doc", F.col("rank").alias("rank_b")), ["qid", "doc"], "full_outer")


def of_query(draft: DataFrame, reviewed: DataFrame, qid) -> DataFrame:
    """doc, grade, source (reviewed or draft) of one query; a review wins."""
    r = reviewed.where(F.col("qid") == F.lit(qid)).select("doc", F.col("grade").alias("r"))
    d = draft.where(F.col("qid") == F.lit(qid)).select("doc", F.col("grade").alias("d"))
    return r.join(d, "doc", "full_outer").select("doc", F.coalesce("r", "d").alias("grade"), F.when(F.col("r").isNotNull(), "reviewed").otherwise("draft").alias("source"))


def validate_search(text: str, system: str, systems: tuple[str, ...], top_k: int = 10, intent: str | None = None) -> None:
    """Raises ValueError for a query of under 2 or over 2,000 characters, an unknown system or intent, or a k outside 1 to 50."""
    if intent is not None and intent not in INTENTS:
        raise ValueError(f"unknown intent {intent}")
    if not 2 <= len(text) <= 2000:
        raise ValueError("a query has 2 to 2000 characters")
    if system not in systems:
        raise ValueError(f"unknown system {system}")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be 1 to 50")


def around(sentences: Column, best: Column, longest: int) -> Column:
    """The best sentence (numbered from 0) with its neighbours, one more on each side a round, as long as they fit in ``longest`` characters.

    A side that does not fit once never does, so as many rounds as there are sentences reach the end.  What is left out shows as "…".
    """
    sizes = F.transform(sentences, lambda s: F.length(s))
    start = F.struct(best.alias("lo"), best.alias("hi"), F.get(sizes, best).alias("size"))

    def widen(span: Column, _: Column) -> Column:
        right = F.get(sizes, span["hi"] + 1)
        more = F.coalesce(span["size"] + right < longest, F.lit(False))
        size = span["size"] + F.when(more, right).otherwise(0)
        left = F.when(span["lo"] > 0, F.get(sizes, F.greatest(span["lo"] - 1, F.lit(0))))
        less = F.coalesce(size + left < longest, F.lit(False))
        return F.struct((span["lo"] - less.cast("int")).alias("lo"), (span["hi"] + more.cast("int")).alias("hi"), (size + F.when(less, left).otherwise(0)).alias("size"))

    span = F.aggregate(sentences, start, widen)
    said = F.array_join(F.slice(sentences, span["lo"] + 1, span["hi"] - span["lo"] + 1), " ")
    short = F.when(F.length(said) > longest + 40, F.regexp_replace(F.substring(said, 1, longest), " [^ ]*$", "")).otherwise(said)
    return F.concat(F.when(span["lo"] > 0, "… ").otherwise(""), short, F.when(span["hi"] < F.size(sentences) - 1, " …").otherwise(""))


def best_passage(docs: DataFrame, terms: DataFrame, phrases: DataFrame | None = None, numbers: DataFrame | None = None, *, doc: str = "doc", query: str = "qid", longest: int = 650, fallback: bool = False) -> DataFrame:
    """The best paragraph of each pair: sum of idf (1 + ln tf), 3 for each phrase and 4 for each provision number in it, divided by 1 + 0.15 ln(1 + words).

    docs(qid, doc, text), terms(qid, term, idf), phrases(qid, phrase) in lower case, numbers(qid, number).  Paragraphs are those of
    ``functions.text.paragraphs``; a text without one has no row, or with ``fallback`` its first ``longest`` characters at place -1.  One of over ``longest`` characters is cut to the sentences round its best one.
    """
    from docketry.functions.text import normalize_space, paragraphs, split_sentences, tokenize

    none = docs.select(query).where("false")
    phrases = none.withColumn("phrase", F.lit("")) if phrases is None else phrases
    numbers = none.withColumn("number", F.lit("")) if numbers is None else numbers
    sought = phrases.groupBy(query).agg(F.collect_set("phrase").alias("_phrases")).join(numbers.groupBy(query).agg(F.collect_set("number").alias("_numbers")), query, "full_outer")

    def best(parts: DataFrame) -> DataFrame:
        """query, doc, at, score of the best of the rows (query, doc, at, part)."""
        t = parts.select(query, doc, "at", F.explode(tokenize(F.col("part"))).alias("term"))
        tf = t.groupBy(query, doc, "at", "term").agg(F.count(F.lit(1)).alias("tf")).join(terms, [query, "term"])
        words = tf.groupBy(query, doc, "at").agg(F.sum(F.col("idf") * (1 + F.log("tf"))).alias("w"))
        extra = parts.join(sought, query, "left").join(words, [query, doc, "at"], "left")
        n = lambda found: F.coalesce(F.size(found), F.lit(0))
        hit = 3.0 * F.when(F.col("_phrases").isNotNull(), n(F.filter("_phrases", lambda x: F.contains(F.lower("part"), x)))).otherwise(0)
        hit = hit + 4.0 * F.when(F.col("_numbers").isNotNull(), n(F.filter("_numbers", lambda x: F.regexp_like("part", F.concat(F.lit(r"\b\Q"), x, F.lit(r"\E\b")))))).otherwise(0)
        score: Column = (F.coalesce("w", F.lit(0.0)) + hit) / (1 + 0.15 * F.log(1 + F.size(tokenize(F.col("part")))))
        w = Window.partitionBy(query, doc).orderBy(F.col("score").desc(), "at")
        return extra.withColumn("score", score).withColumn("r", F.row_number().over(w)).where("r = 1").select(query, doc, "at", "part", "score")

    top = best(docs.select(query, doc, F.posexplode(paragraphs(F.col("text"))).alias("at", "part")))
    top = top.select(query, doc, F.col("at").alias("pos"), normalize_space(F.col("part")).alias("paragraph"), "score")
    cut = split_sentences(F.col("paragraph"))
    long = top.where(F.length("paragraph") > longest)
    inner = best(long.select(query, doc, F.posexplode(cut).alias("at", "part"))).select(query, doc, "at")
    wide = long.withColumn("_s", cut).join(inner, [query, doc]).select(query, doc, "pos", "score", around(F.col("_s"), F.col("at"), longest).alias("paragraph"))
    out = top.where(F.length("paragraph") <= longest).select(query, doc, "pos", "score", "paragraph").unionByName(wide)
    if not fallback:
        return out
    rest = docs.where(F.size(paragraphs(F.col("text"))) == 0).select(query, doc, F.lit(-1).alias("pos"), F.lit(0.0).alias("score"), normalize_space(F.substring("text", 1, longest)).alias("paragraph"))
    return out.unionByName(rest)
