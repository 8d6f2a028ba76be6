"""Inverted index, BM25, TF-IDF, chunk and vector scores.  Queries are a table; nothing loops on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docketry.config import BM25_B, BM25_EPSILON, BM25_K1
from docketry.functions.text import content_tokens, tokenize
from docketry.sources.shared import Scratch


def term_frequencies(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokenize(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """term, df, tokens; the sum of ``tokens`` over all terms is the number of tokens of all documents (each counts at its first term)."""
    t = docs.select(tokenize(F.col(text)).alias("_t")).select(F.size("_t").alias("_len"), F.posexplode(F.array_distinct("_t")).alias("_at", "term"))
    return t.groupBy("term").agg(F.count_if(F.col("_at") >= 0).alias("df"), F.sum(F.when(F.col("_at") == 0, F.col("_len")).otherwise(0)).alias("tokens"))


def bm25_idf(terms: DataFrame, n_docs: DataFrame) -> DataFrame:
    """terms(term, df), n_docs(n): term, df, idf: ln(N - df + 0.5) - ln(df + 0.5); negative ones become epsilon times the mean over the vocabulary."""
    raw = terms.crossJoin(n_docs).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def by_doc(rows: DataFrame, doc: str = "doc") -> DataFrame:
    """All rows of a document in one task, so that sums by query and document need no exchange of pairs.

    In more parts than usual: a row is small here and meets every query that asks for it.
    """
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), doc)


def written_vocabulary(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``vocabulary`` written once; its counts, their mean and the tokens' sum are read several times."""
    return Scratch(docs.sparkSession, "vocabulary").put(vocabulary(docs, key, text))


def _occurrences(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, len, term for each token; outer, as the filter that an inner explode is given would tokenise again, so a text without tokens has a null."""
    return docs.select(doc, tokenize(F.col(text)).alias("_t")).select(doc, F.size("_t").alias("len"), F.explode_outer("_t").alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, *, doc: str = "doc_id", query: str = "item_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """query, doc, score for every pair that shares a term.  Repeated query words count again.

    Texts are tokenised twice: for the vocabulary, which is aggregated where the texts lie and written (``terms``: one that
    is there already), and for the postings of the queries' own terms, which alone are counted and moved.
    """
    terms = written_vocabulary(docs, doc, text) if terms is None else terms
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    average = terms.agg(F.sum("tokens").alias("tokens")).crossJoin(n).select((F.col("tokens") / F.col("n")).alias("avgdl"))
    idf = bm25_idf(terms.select("term", "df"), n)
    asked = term_frequencies(queries, query, text).withColumnRenamed("tf", "qtf")
    held = _occurrences(docs, doc, text).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    postings = held.groupBy(doc, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _bm25_sum(asked.join(idf.select("term", "idf"), "term"), postings, average, doc, query)


def _bm25_sum(asked: DataFrame, postings: DataFrame, average: DataFrame, doc: str, query: str) -> DataFrame:
    """The stated queries' terms go to every task and the postings to their document's, where the queries' sums are made."""
    saturated = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avgdl")))
    parts = by_doc(postings, doc).crossJoin(F.broadcast(average)).select(doc, "term", saturated.alias("_s"))
    return parts.join(F.broadcast(asked), "term").groupBy(query, doc).agg(F.sum(F.col("qtf") * F.col("idf") * F.col("_s")).alias("score"))


def write_index(docs: DataFrame, to: str, *, doc: str = "doc_id", text: str = "text", buckets: int = 64) -> None:
    """Writes an index under ``to``: postings in folders by bucket of the term, terms with idf, and the average length."""
    held = _occurrences(docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc", "text").where("term IS NOT NULL")
    postings = held.groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # a term of most documents is dealt over several files of its bucket
    postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{to}/postings")
    spark = docs.sparkSession
    terms = Scratch(spark, "terms").put(spark.read.parquet(f"{to}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tokens")))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    bm25_idf(terms.select("term", "df"), n).write.mode("overwrite").parquet(f"{to}/terms")
    terms.agg(F.sum("tokens").alias("tokens")).crossJoin(n).select((F.coalesce("tokens", F.lit(0)) / F.col("n")).alias("avgdl"), "n").write.mode("overwrite").parquet(f"{to}/stats")


def search_index(spark: SparkSession, at: str, queries: DataFrame, *, query: str = "item_id", text: str = "text", buckets: int = 64) -> DataFrame:
    """query, doc, score by BM25 from a written index; only the buckets of the queries' terms are read."""
    asked = term_frequencies(queries, query, text).withColumnRenamed("tf", "qtf").join(spark.read.parquet(f"{at}/terms").select("term", "idf"), "term")
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    postings = spark.read.parquet(f"{at}/postings").join(F.broadcast(asked.select("bucket").distinct()), "bucket", "left_semi").drop("bucket")  # at most ``buckets`` rows
    postings = postings.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    return _bm25_sum(asked.drop("bucket"), postings, spark.read.parquet(f"{at}/stats").select("avgdl"), "doc", query)


def top_k(scores: DataFrame, k: int | None, *, by: str, tie: str, score: str = "score", positive: bool = False) -> DataFrame:
    """Rank 1 to k (None: all) for each ``by``, highest score first, ties by the smaller ``tie``."""
    rows = scores.where(F.col(score) > 0) if positive else scores
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def ngrams(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf over words and word pairs, stop words taken out first."""
    t = docs.select(key, content_tokens(F.col(text)).alias("t"))
    pairs = F.when(F.size("t") > 1, F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return t.select(key, F.explode(F.concat("t", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf_vocabulary(tf: DataFrame, docs: DataFrame, *, min_df: int = 2, max_df: float = 0.5) -> DataFrame:
    """term, idf = ln((1+n)/(1+df)) + 1 of the terms on ``min_df`` documents to ``max_df`` of all."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    # a count of tf keeps the shuffle equal to the one that the weights read, so that it runs once
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).where(F.col("df") >= min_df).crossJoin(n).where(F.col("df") <= max_df * F.col("n"))
    return df.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def _raw_weights(tf: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    return tf.join(vocab, "term").select(key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def _lengths(raw: DataFrame, key: str) -> DataFrame:
    return raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))


def tfidf(docs: DataFrame, key: str = "doc_id", *, text: str = "text", min_df: int = 2, max_df: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Weights (key, term, weight; rows of unit length) and the vocabulary (term, idf): 1 + ln(tf) times ln((1+n)/(1+df)) + 1."""
    tf = ngrams(docs, key, text)
    vocab = tfidf_vocabulary(tf, docs, min_df=min_df, max_df=max_df)
    raw = _raw_weights(tf, vocab, key)
    return raw.join(_lengths(raw, key), key).select(key, "term", (F.col("w") / F.col("size")).alias("weight")), vocab


def tfidf_scores(docs: DataFrame, queries: DataFrame, *, doc: str = "doc_id", query: str = "item_id", text: str = "text") -> DataFrame:
    """query, doc, score: the cosine of their TF-IDF rows, for pairs that share a term.

    Only the queries' terms are matched; the lengths of all documents are summed beside.
    """
    tf = ngrams(docs, doc, text)
    vocab = tfidf_vocabulary(tf, docs)
    raw = _raw_weights(tf, vocab, doc)
    asked = _raw_weights(ngrams(queries, query, text), vocab, query)
    asked = asked.join(_lengths(asked, query), query).select(query, "term", (F.col("w") / F.col("size")).alias("q"))
    hits = raw.join(asked, "term").groupBy(query, doc).agg(F.sum(F.col("q") * F.col("w")).alias("s"))
    return hits.join(_lengths(raw, doc), doc).select(query, doc, (F.col("s") / F.col("size")).alias("score"))


#: Pairs of a query and a row that one batch of ``vector_scores`` holds.
PAIRS = 1 << 18


def vector_scores(vectors: DataFrame, queries: DataFrame, *, row: str = "vec_id", query: str = "qid", vec: str = "embedding", qvec: str = "qvec") -> DataFrame:
    """query, row, score: every stated query against all rows, the dot product of their vectors; null where one is null or their lengths differ.

    The stated queries are sent to every task as matrices; rows pass by in batches, which are small where the queries are many.
    """
    asked = queries.select(F.col(query).alias("q"), F.col(qvec).cast("array<double>").alias("v")).orderBy("q").collect()
    ids = pa.array([r.q for r in asked], to_arrow_type(queries.schema[query].dataType))
    of_length: dict[int, list[int]] = {}
    for i, r in enumerate(asked):
        if r.v is not None and None not in r.v:
            of_length.setdefault(len(r.v), []).append(i)
    matrices = {n: (at, np.array([asked[i].v for i in at], np.float64).reshape(len(at), n).T) for n, at in of_length.items()}

    def run(batches):
        step = max(1, PAIRS // max(1, len(asked)))
        for b in batches:
            for start in range(0, b.num_rows if asked else 0, step):
                part = b.slice(start, step)
                held = part.column(1)
                whole = [v is not None and None not in v for v in held.to_pylist()] if held.null_count or held.flatten().null_count else None
                lengths = held.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
                score, known = np.zeros((part.num_rows, len(asked))), np.zeros((part.num_rows, len(asked)), bool)
                for n, (at, matrix) in matrices.items():
                    rows = np.flatnonzero((lengths == n) & (whole if whole is not None else True))
                    flat = held.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                    score[np.ix_(rows, at)], known[np.ix_(rows, at)] = flat @ matrix, True
                who = pa.array(np.repeat(np.arange(part.num_rows), len(asked)))
                mask = None if known.all() else ~known.ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(np.arange(len(asked)), part.num_rows))), part.column(0).take(who), pa.array(score.ravel(), mask=mask)], names=[query, row, "score"])

    schema = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n, df in ((query, queries), (row, vectors))) + ", score double"
    return vectors.select(row, F.col(vec).cast("array<double>").alias("v")).mapInArrow(run, schema)


def best_chunk(sims: DataFrame, *by: str) -> DataFrame:
    """By document: the greatest chunk similarity (max), the mean of the three greatest, the first best start."""
    w = Window.partitionBy(*by).orderBy(F.col("sim").desc(), F.col("start"))
    r = sims.withColumn("r", F.row_number().over(w))
    return r.groupBy(*by).agg(F.max("sim").alias("sim_max"), F.avg(F.when(F.col("r") <= 3, F.col("sim"))).alias("sim_mean3"), F.min(F.when(F.col("r") == 1, F.col("start"))).alias("best_start"))
