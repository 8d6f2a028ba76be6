"""End-to-end search over a table of queries: features, analysis, signals, pool, fusion, ranking, explanation.

Features of the documents are tables of their own (``Corpus``), built once and read by every search.  Signals of all queries are written
before they are fused, so that fusion, ranking and explanation read them instead of computing them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docketry.config import SEMANTIC_VARIANTS
from docketry.functions.legal import outcome_requirements, procedural_outcome, rule_intent
from docketry.operators import entities as E
from docketry.operators import retrieval as R
from docketry.operators import scoring as S
from docketry.sources.shared import Scratch

NO_CONCEPTS = "concept string, phrases array<string>, implied array<string>"


@dataclass
class Corpus:
    """What is known of the documents; an empty table stands for what is not.

    docs(doc, text), acts(doc, act_id, listed, head, body), provisions(doc, act_id, ref, head, body), concepts(doc, concept, head, body),
    outcomes(doc, label, confidence), authorities(doc, key, polarity), links(src, dst), chunks(doc, start, v; unit vectors,
    start -1 for the whole text).
    """

    docs: DataFrame
    acts: DataFrame
    provisions: DataFrame
    concepts: DataFrame
    outcomes: DataFrame
    authorities: DataFrame
    links: DataFrame
    chunks: DataFrame
    dictionary: DataFrame
    act_names: tuple = field(default=E.ACTS)

    TABLES = ("docs", "acts", "provisions", "concepts", "outcomes", "authorities", "links", "chunks", "dictionary")

    def write(self, to: str) -> None:
        """Every table as Parquet under ``to``."""
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{to}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, at: str, **more) -> Corpus:
        return cls(**{name: spark.read.parquet(f"{at}/{name}") for name in cls.TABLES}, **more)


def features(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", concepts: DataFrame | None = None, citations: DataFrame | None = None, links: DataFrame | None = None, chunks: DataFrame | None = None, listed: DataFrame | None = None, acts=E.ACTS) -> Corpus:
    """A corpus from texts.  concepts: the dictionary (concept, phrases, implied); citations(doc, key, pos, polarity);
    links(src, dst); chunks(doc, start, v); listed(doc, act_id, name): the Acts of the editors' lists."""
    spark = docs.sparkSession
    none = lambda schema: spark.createDataFrame([], schema)
    kind = docs.schema[doc].dataType.simpleString()
    held = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    listed = none(f"doc {kind}, act_id string, name string") if listed is None else listed
    dictionary = none(NO_CONCEPTS) if concepts is None else concepts
    # marked once: both tables read what is written
    marks = Scratch(spark, "features").put(E.extract(held, "doc", "text", acts=acts, defaults=E.default_act_map(listed)))
    places = marks.where("kind = 'act'").select("doc", "act_id", F.lit("body").alias("place")).unionByName(listed.select("doc", "act_id", F.lit("listed").alias("place")))
    mentions = marks.where("kind = 'provision'").groupBy("doc", "act_id", "ref").agg(F.lit(0).cast("long").alias("head"), F.count(F.lit(1)).alias("body"))
    found = E.find_concepts(held, dictionary, "doc").select("doc", "concept", F.lit(0).cast("long").alias("head"), F.col("n").cast("long").alias("body")).where("body >= 3")
    ended = held.select("doc", procedural_outcome(F.right(F.col("text"), F.lit(3000)), F.lit(None).cast("string")).alias("label"), F.lit(0.9).alias("confidence")).where("label IS NOT NULL")
    said = E.substantive_outcomes(held.select("doc", F.right(F.col("text"), F.lit(3000)).alias("tail"), F.lit("").alias("held")), "doc", "tail", "held")
    return Corpus(
        docs=held, acts=E.merge_acts(places, "doc", "act_id"), provisions=E.resolve_unattributed(mentions, listed, "head", "body"), concepts=found, outcomes=said.unionByName(ended),
        authorities=S.collapse_polarity(citations) if citations is not None else none(f"doc {kind}, key string, polarity string"),
        links=links if links is not None else none(f"src {kind}, dst {kind}"), chunks=chunks if chunks is not None else none(f"doc {kind}, start int, v array<double>"),
        dictionary=dictionary, act_names=acts,
    )


def analyze(queries: DataFrame, *, query: str = "item_id", text: str = "text", override: str | None = None) -> DataFrame:
    """query, text, intent, requirements: the analysed form of each query (``override`` names an intent column)."""
    intent = F.coalesce(F.col(override), rule_intent(F.col(text))) if override else rule_intent(F.col(text))
    return queries.select(query, text, intent.alias("intent"), outcome_requirements(F.col(text)).alias("requirements"))


def analysis(corpus: Corpus, queries: DataFrame, *, query: str = "item_id", text: str = "text", override: str | None = None) -> dict[str, DataFrame]:
    """Tables by qid: queries (text, intent, requirements, and what is asked for), acts, provisions, concepts, implied provisions, precedents."""
    qa = analyze(queries, query=query, text=text, override=override).withColumnRenamed(query, "qid").withColumnRenamed(text, "text")
    marks = E.extract(qa, "qid", "text", acts=corpus.act_names)
    provisions = marks.where("kind = 'provision'").select("qid", "act_id", "ref").distinct()
    acts = marks.where("kind = 'act'").select("qid", "act_id").union(provisions.where("act_id <> '?'").select("qid", "act_id")).distinct()
    concepts = E.find_concepts(qa, corpus.dictionary, "qid").select("qid", "concept")
    implied = E.implied_provisions(concepts, corpus.dictionary).select("qid", F.split("provision", ":")[0].alias("act_id"), F.split("provision", ":")[1].alias("ref")).distinct()
    implied = implied.join(provisions.select("qid").distinct(), "qid", "left_anti")
    named = S.match_precedents(qa.withColumn("asked", E.named_precedents(F.col("text"))), corpus.authorities, text="text").select("qid", "key")
    has = lambda df, name: df.select("qid").distinct().withColumn(name, F.lit(True))
    for df, name in ((acts, "has_acts"), (provisions, "has_sections"), (implied, "has_implied"), (concepts, "has_concepts")):
        qa = qa.join(has(df, name), "qid", "left")
    return {"queries": qa.fillna(False, ["has_acts", "has_sections", "has_implied", "has_concepts"]), "acts": acts, "provisions": provisions, "concepts": concepts, "implied": implied, "precedents": named}


def semantic_signal(corpus: Corpus, vectors: DataFrame, variant: str = "chunked_max") -> DataFrame:
    """qid, doc, raw of the queries' vectors(qid, v) against all chunks: whole texts, the best chunk, or the mean of the three best.

    The stated queries are sent to every task as one matrix; chunks pass by in batches.
    """
    if variant not in SEMANTIC_VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    whole = variant == "whole"
    rows = corpus.chunks.where("start = -1" if whole else "start >= 0").select("doc", "start", "v")
    sims = similarities(rows, vectors)
    if whole:
        return sims.select("qid", "doc", F.col("sim").alias("raw"))
    return R.best_chunk(sims, "qid", "doc").select("qid", "doc", F.col("sim_mean3" if variant == "chunked_mean3" else "sim_max").alias("raw"))


def similarities(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, doc, start, sim: every query of vectors(qid, v) against every row (doc, start, v); null vectors have no similarity."""
    asked = vectors.where("v IS NOT NULL").select("qid", F.col("v").cast("array<double>").alias("v")).orderBy("qid").collect()  # the stated queries
    types = {"qid": vectors.schema["qid"].dataType, "doc": rows.schema["doc"].dataType, "start": rows.schema["start"].dataType}
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in types.items()) + ", sim double"
    ids = pa.array([r.qid for r in asked], to_arrow_type(types["qid"]))
    matrix = np.array([r.v for r in asked], np.float64) if asked else np.zeros((0, 0))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows if len(matrix) else 0, 1000):
                part = b.slice(at, 1000)
                v = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                sim = v @ matrix.T
                who = pa.array(np.repeat(np.arange(part.num_rows), len(matrix)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.tile(np.arange(len(matrix)), part.num_rows))), part.column(0).take(who), part.column(1).take(who), pa.array(sim.ravel())], names=["qid", "doc", "start", "sim"])

    return rows.where("v IS NOT NULL").select("doc", "start", F.col("v").cast("array<double>").alias("v")).mapInArrow(run, schema)


def compute_signals(corpus: Corpus, asked: dict[str, DataFrame], *, vectors: DataFrame | None = None, variant: str = "chunked_max", scratch: Scratch | None = None) -> DataFrame:
    """signals(qid, intent, doc, signal, raw) of all queries; a signal that does not apply to a query has no rows.

    vectors(qid, v): the queries' vectors; without them no query has the semantic signal.
    """
    spark = corpus.docs.sparkSession
    scratch = scratch or Scratch(spark, "signals")
    qa, docs = scratch.put(asked["queries"]), corpus.docs
    one = lambda df, name: df.select("qid", "doc", F.lit(name).alias("signal"), F.col("score").alias("raw"))
    lexical = one(R.bm25(docs, qa, doc="doc", query="qid"), "bm25")
    issue = R.tfidf_scores(docs, qa, doc="doc", query="qid")
    legal = S.legal_scores(
        issue, asked=qa, acts=S.act_scores(asked["acts"], corpus.acts), sections=S.section_scores(asked["provisions"], corpus.provisions),
        implied=S.section_scores(asked["implied"], corpus.provisions, implied=True), concepts=S.concept_scores(asked["concepts"], corpus.concepts),
    )
    first = scratch.put(lexical.unionByName(one(legal, "legal")))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = S.authority_stats(corpus.authorities, n)
    cited = S.citation_signal(corpus.authorities, stats, corpus.links, qa.select("qid", "intent"), asked["precedents"], S.seeds(first, n))
    required = qa.select("qid", F.posexplode("requirements").alias("pos", "label"))
    # documents without a row count 0.5 where the pool is fused
    ended = one(S.outcome_scores(required, corpus.outcomes, spark), "outcome")
    rows = first.unionByName(one(cited, "citation")).unionByName(ended)
    if vectors is not None:
        rows = rows.unionByName(semantic_signal(corpus, vectors, variant).select("qid", "doc", F.lit("semantic").alias("signal"), "raw"))
    return scratch.put(rows.join(qa.select("qid", "intent"), "qid").select("qid", "intent", "doc", "signal", "raw"))


def rank(signals: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """config, qid, doc, rank, score, strongest (the two signals that carry most, in that order) of the ``k`` best."""
    parts = S.contributions(signals, weights)
    fused = parts.groupBy("config", "qid", "doc").agg(F.round(F.sum(F.col("eff") * F.col("norm")), 9).alias("score"), F.collect_list(F.struct((-F.round(F.col("eff") * F.col("norm"), 4)).alias("p"), "signal")).alias("parts"))
    top = R.top_k(fused.withColumn("by", F.struct("config", "qid")), k, by="by", tie="doc")
    lead = F.slice(F.filter(F.sort_array("parts"), lambda x: x["p"] < 0), 1, 2)
    return top.select("config", "qid", "doc", "rank", "score", F.concat_ws("; ", F.transform(lead, lambda x: x["signal"])).alias("strongest"))


def matched(corpus: Corpus, asked: dict[str, DataFrame], top: DataFrame) -> DataFrame:
    """For the rows (qid, doc) of ``top``: acts, provisions, concepts (sorted arrays) that the query asks for and the document holds, and a reason."""
    pairs = top.select("qid", "doc").distinct()

    def those(df: DataFrame, name: str, what) -> DataFrame:
        return pairs.join(df, ["qid", "doc"], "left").groupBy("qid", "doc").agg(F.sort_array(F.collect_set(what)).alias(name))

    acts = those(asked["acts"].join(corpus.acts, "act_id"), "acts", F.col("act_id"))
    wanted = asked["provisions"].unionByName(asked["implied"])
    provisions = those(S.match_provisions(wanted, corpus.provisions), "provisions", F.concat("d_act", F.lit(":"), "ref"))
    concepts = those(asked["concepts"].join(corpus.concepts.select("doc", "concept"), "concept"), "concepts", F.col("concept"))
    out = acts.join(provisions, ["qid", "doc"]).join(concepts, ["qid", "doc"])
    listing = lambda c, n: F.concat_ws(", ", F.slice(c, 1, n))
    law = F.when(F.size("provisions") > 0, F.concat(F.lit("discusses "), listing("provisions", 3))).when(F.size("acts") > 0, F.concat(F.lit("deals with "), listing("acts", 3)))
    topic = F.when(F.size("concepts") > 0, F.concat(F.lit("addresses "), listing("concepts", 4)))
    return out.withColumn("reason", F.concat_ws("; ", law, topic))


def search(corpus: Corpus, queries: DataFrame, config: str = "A1_pdf_table", k: int = 10, *, query: str = "item_id", text: str = "text", override: str | None = None, vectors: DataFrame | None = None, variant: str = "chunked_max") -> DataFrame:
    """qid, doc, rank, score, strongest, acts, provisions, concepts, reason of every query at once."""
    scratch = Scratch(corpus.docs.sparkSession, "search")
    asked = {name: scratch.put(df) for name, df in analysis(corpus, queries, query=query, text=text, override=override).items()}
    signals = compute_signals(corpus, asked, vectors=vectors, variant=variant, scratch=scratch)
    weights = S.resolve_weights(corpus.docs.sparkSession).where(F.col("config") == config)
    top = scratch.put(rank(signals, weights, k).drop("config"))
    return top.join(matched(corpus, asked, top), ["qid", "doc"]).select("qid", "doc", "rank", "score", "strongest", "acts", "provisions", "concepts", "reason")
