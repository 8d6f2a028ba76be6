"""Legal, citation and outcome scores; weights, fusion and ranking.  All over long tables keyed by query and document."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docketry import config as C
from docketry.functions.legal import CONFLICTS, act_salience, key_match, normalize_party, provision_salience
from docketry.functions.vectors import minmax
from docketry.operators.retrieval import by_doc


def resolve_weights(spark: SparkSession) -> DataFrame:
    """config, intent, signal, weight for every fixed, pairwise and adaptive configuration."""
    rows = []
    for name, row in C.FIXED.items():
        rows += [(name, i, s, float(w)) for i in C.INTENTS for s, w in zip(C.SIGNALS, row, strict=True)]
    for name, options in C.PAIRWISE.items():
        rows += [(f"{name}_{k}", i, s, float(w)) for k, row in enumerate(options) for i in C.INTENTS for s, w in zip(C.SIGNALS, row, strict=True)]
    for name, (base, lam) in C.ADAPTIVE.items():
        for i in C.INTENTS:
            other = C.FIXED[base] if base else (0.0,) * 5
            rows += [(name, i, s, (1 - lam) * t + lam * b) for s, t, b in zip(C.SIGNALS, C.TABLE[i], other, strict=True)]
    return spark.createDataFrame(rows, "config string, intent string, signal string, weight double")


def match_provisions(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked(qid, act_id, ref) against held(doc, act_id, ref, head, body): pairs with factor and salience.

    Same reference, and the same Act or one side unattributed ('?'); an unattributed mention counts 0.7.  Asked provisions are those of
    stated queries and go to every task; both sides are looked up by reference and Act, so that only pairs that match are made.
    """
    any_act = F.lit("*")  # where a mention without an Act finds all that is asked of its reference
    h = held.select("doc", F.col("act_id").alias("d_act"), "ref", "head", "body")
    h = h.withColumn("_k", F.explode(F.when(F.col("d_act") == "?", F.array(any_act)).otherwise(F.array("d_act", F.lit("?")))))
    both = h.join(F.broadcast(asked.withColumn("_k", F.explode(F.array("act_id", any_act)))), ["ref", "_k"]).drop("_k")
    factor = F.when((F.col("act_id") == "?") | (F.col("act_id") == F.col("d_act")), 1.0).otherwise(0.7)
    return both.withColumn("value", factor * provision_salience(F.col("head"), F.col("body")))


def section_scores(asked: DataFrame, held: DataFrame, implied: bool = False) -> DataFrame:
    """qid, doc, score: the best match of each asked provision, averaged over all (implied ones: the best of all).

    A match is the same for every query that asks for the provision: it is found once and then meets the queries.
    """
    of_query = Window.partitionBy("qid")
    who = asked.groupBy("qid", "act_id", "ref").agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.sum("c").over(of_query)).drop("c")
    best = by_doc(match_provisions(asked.select("act_id", "ref").distinct(), held)).groupBy("doc", "act_id", "ref").agg(F.max("value").alias("v"))
    score = F.max("v") if implied else F.sum("v") / F.max("n")
    return best.join(F.broadcast(who), ["act_id", "ref"]).groupBy("qid", "doc").agg(score.alias("score"))


def _mean_of_asked(asked: DataFrame, held: DataFrame, key: str, value: Column) -> DataFrame:
    """qid, doc, score: the mean of ``value`` over the distinct asked(qid, key), an absent one 0; what is asked goes to every task."""
    who = asked.select("qid", key).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    return by_doc(held).join(F.broadcast(who), key).groupBy("qid", "doc").agg((F.sum(value) / F.max("n")).alias("score"))


def act_scores(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked(qid, act_id), held(doc, act_id, listed, head, body): qid, doc, score, the mean salience of the asked Acts (an absent one: 0)."""
    return _mean_of_asked(asked, held, "act_id", act_salience(F.col("listed"), F.col("head"), F.col("body")))


def concept_scores(asked: DataFrame, held: DataFrame) -> DataFrame:
    """asked(qid, concept), held(doc, concept, head, body): qid, doc, score, the mean over asked concepts of 1 (in the head) or 0.5."""
    return _mean_of_asked(asked, held, "concept", F.when(F.col("head") > 0, 1.0).otherwise(0.5))


def legal_scores(issue: DataFrame, *, acts: DataFrame | None = None, sections: DataFrame | None = None, implied: DataFrame | None = None, concepts: DataFrame | None = None, asked: DataFrame) -> DataFrame:
    """qid, doc, score: the weighted mean of a query's applicable parts; a part without a row for a document counts 0 there.

    issue, acts, sections, implied, concepts: (qid, doc, score) of each part; ``asked`` (qid, has_acts, has_sections, has_implied,
    has_concepts) says what the queries ask for.  The issue part is the cosine over the query's greatest, halved with the concepts'
    coverage where concepts are asked; sections that concepts only imply weigh half.
    """
    weight = C.LEGAL_PARTS
    flags = asked.select("qid", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("has_acts", "has_sections", "has_implied", "has_concepts")])
    half = F.when(F.col("has_concepts"), 0.5).otherwise(1.0)
    top = issue.groupBy("qid").agg(F.max("score").alias("top"))
    parts = issue.join(top, "qid").join(flags, "qid").select("qid", "doc", F.when(F.col("top") > 0, weight["issue"] * half * F.col("score") / F.col("top")).otherwise(0.0).alias("part"))
    if concepts is not None:
        parts = parts.unionByName(concepts.select("qid", "doc", (weight["issue"] * 0.5 * F.col("score")).alias("part")))
    for name, rows, w in (("act", acts, weight["act"]), ("section", sections, weight["section"]), ("implied", implied, weight["section"] / 2)):
        if rows is not None:
            parts = parts.unionByName(rows.select("qid", "doc", (w * F.col("score")).alias("part")))
    total = weight["issue"] + F.when(F.col("has_acts"), weight["act"]).otherwise(0.0) + F.when(F.col("has_sections"), weight["section"]).when(F.col("has_implied"), weight["section"] / 2).otherwise(0.0)
    return parts.groupBy("qid", "doc").agg(F.sum("part").alias("s")).join(flags, "qid").select("qid", "doc", (F.col("s") / total).alias("score"))


def weighted_parts(parts: DataFrame) -> DataFrame:
    """parts(qid, doc, part, value, weight) of applicable parts only: their weighted mean as ``score``."""
    return parts.groupBy("qid", "doc").agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("score"))


def authority_stats(links: DataFrame, n_docs: DataFrame) -> DataFrame:
    """links(doc, key): key, df (documents), idf = ln(1 + N / df)."""
    df = links.select("doc", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(n_docs).select("key", "df", F.log(1 + F.col("n") / F.col("df")).alias("idf"))


def collapse_polarity(citations: DataFrame) -> DataFrame:
    """citations(doc, key, pos, polarity): per document and key the last polarity that is not neutral, else neutral."""
    last = F.max_by("polarity", F.when(F.col("polarity") != "neutral", F.col("pos")))
    said = F.max(F.when(F.col("polarity") != "neutral", 1).otherwise(0)) == 1
    return citations.groupBy("doc", "key").agg(F.when(said, last).otherwise("neutral").alias("polarity"))


def _polarity_weight(intent: str) -> Column:
    row = C.POLARITY_WEIGHTS.get(intent, C.POLARITY_WEIGHTS["other"])
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*row.items())]), F.col("polarity"))


def named_scores(authorities: DataFrame, named: DataFrame, intent: str = "other") -> DataFrame:
    """Named mode: the best polarity weight among the named keys that a document cites."""
    return authorities.join(named, "key", "left_semi").groupBy("doc").agg(F.max(_polarity_weight(intent)).alias("score"))


def shared_scores(authorities: DataFrame, stats: DataFrame, seeds: DataFrame, edges: DataFrame, intent: str = "other") -> DataFrame:
    """Shared mode: ln(1 + sum of seed votes x idf x polarity + 2 x links with seeds); a seed's own vote is taken out.

    authorities(doc, key, polarity), stats(key, df, idf), seeds(doc), edges(src, dst).
    """
    known = stats.where("df >= 2")
    votes = authorities.join(seeds, "doc", "left_semi").join(known, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("votes"))
    is_seed = seeds.select("doc", F.lit(1).alias("own"))
    rows = authorities.join(votes, "key").join(stats, "key").join(is_seed, "doc", "left")
    left = F.col("votes") - F.coalesce("own", F.lit(0))
    from_keys = rows.where(left > 0).select("doc", (left * F.col("idf") * _polarity_weight(intent)).alias("part"))
    both = edges.select(F.col("src").alias("doc"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    linked = both.join(seeds.withColumnRenamed("doc", "other"), "other", "left_semi").select("doc", F.lit(2.0).alias("part"))
    return from_keys.union(linked).groupBy("doc").agg(F.log1p(F.sum("part")).alias("score"))


def _polarity_table(spark: SparkSession) -> DataFrame:
    rows = [(i, p, float(w)) for i in C.INTENTS for p, w in C.POLARITY_WEIGHTS.get(i, C.POLARITY_WEIGHTS["other"]).items()]
    return spark.createDataFrame(rows, "intent string, polarity string, pw double")


def citation_signal(authorities: DataFrame, stats: DataFrame, edges: DataFrame, queries: DataFrame, named: DataFrame, seeds: DataFrame) -> DataFrame:
    """qid, doc, score of all queries at once; queries(qid, intent), named(qid, key), seeds(qid, doc).

    A query that names authorities scores the documents that cite them, by the best polarity weight.  The others score
    ln(1 + sum of seed votes x idf x polarity weight + 2 x links with seeds), a seed's own vote taken out; only authorities
    of two documents or more vote, and a query whose seeds share none has no rows.
    """
    spark = authorities.sparkSession
    weights = F.broadcast(_polarity_table(spark))
    by_name = named.distinct().join(authorities, "key").join(queries, "qid").join(weights, ["intent", "polarity"])
    by_name = by_name.groupBy("qid", "doc").agg(F.max("pw").alias("score")).where("score > 0")
    free = queries.join(named.select("qid").distinct(), "qid", "left_anti")
    mine = seeds.join(free.select("qid"), "qid", "left_semi").distinct()
    known = stats.where("df >= 2").select("key", "idf")
    votes = mine.join(authorities, "doc").join(known, "key").groupBy("qid", "key", "idf").agg(F.count(F.lit(1)).alias("votes"))
    own = mine.withColumn("own", F.lit(1))
    rows = votes.join(authorities, "key").join(own, ["qid", "doc"], "left").withColumn("left", F.col("votes") - F.coalesce("own", F.lit(0))).where("left > 0")
    shared = rows.join(free, "qid").join(weights, ["intent", "polarity"]).select("qid", "doc", (F.col("left") * F.col("idf") * F.col("pw")).alias("part"))
    both = edges.select(F.col("src").alias("doc"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    linked = mine.select("qid", F.col("doc").alias("other")).join(both, "other").join(votes.select("qid").distinct(), "qid", "left_semi").select("qid", "doc", F.lit(2.0).alias("part"))
    by_seed = shared.union(linked).groupBy("qid", "doc").agg(F.log1p(F.sum("part")).alias("score"))
    return by_name.unionByName(by_seed)


def match_precedents(queries: DataFrame, keys: DataFrame, *, query: str = "qid", asked: str = "asked", text: str | None = None, least: float = 0.75, slack: float = 0.05, most_words: int = 6) -> DataFrame:
    """query, key, score: the authorities that a query names.

    queries(query, asked: array of case keys, text).  For each asked key the candidates of at least ``least`` that are within ``slack`` of
    its best; candidates share a word of the first party, which a match needs.  A query without an asked key
    matches the authorities whose first party, of two words or more and no generic one, stands in its text.
    """
    first = lambda c: F.split(F.col(c), " v ")[0]
    words = lambda c: F.explode(F.array_distinct(F.split(first(c), " ")))
    keys = keys.select("key").distinct()
    wanted = queries.select(query, F.explode(asked).alias("_asked")).distinct()
    pairs = wanted.select(query, "_asked", words("_asked").alias("_w")).join(keys.select("key", words("key").alias("_w")), "_w").select(query, "_asked", "key").distinct()
    scored = pairs.withColumn("score", key_match(F.col("_asked"), F.col("key"))).where(F.col("score") >= least)
    best = scored.groupBy(query, "_asked").agg(F.max("score").alias("_best"))
    out = scored.join(best, [query, "_asked"]).where(F.col("score") >= F.col("_best") - slack).groupBy(query, "key").agg(F.max("score").alias("score"))
    if text is None:
        return out
    said = queries.where(F.size(asked) == 0).select(query, F.filter(F.split(normalize_party(F.col(text)), " "), lambda w: w != "").alias("_t"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(most_words)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("_t") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("_t", i, n), " "))))
    parties = keys.select("key", first("key").alias("_p")).where(F.col("_p").contains(" ") & ~F.col("_p").isin(*C.GENERIC_PARTIES))
    short = said.select(query, F.explode(F.array_distinct(spans)).alias("_p")).join(parties, "_p").select(query, "key", F.lit(1.0).alias("score")).distinct()
    return out.unionByName(short)


def seeds(signals: DataFrame, n_docs: DataFrame, k: int = C.SEEDS) -> DataFrame:
    """qid, doc: the ``k`` documents of greatest min-max BM25 plus min-max legal score over all documents (those without a row have 0)."""
    rows = signals.where(F.col("signal").isin("bm25", "legal"))
    range_ = rows.groupBy("qid", "signal").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count(F.lit(1)).alias("c")).crossJoin(n_docs)
    range_ = range_.select("qid", "signal", F.when(F.col("c") < F.col("n"), F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"), F.when(F.col("c") < F.col("n"), F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"))
    value = F.when(F.col("hi") - F.col("lo") < 1e-12, 0.0).otherwise((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    summed = rows.join(range_, ["qid", "signal"]).groupBy("qid", "doc").agg(F.round(F.sum(value), 9).alias("v"))
    w = Window.partitionBy("qid").orderBy(F.col("v").desc(), "doc")
    return summed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("qid", "doc")


def padded(signals: DataFrame, docs: DataFrame, k: int = C.CANDIDATES) -> DataFrame:
    """``signals`` with rows of raw 0 for the first documents, so that a signal with fewer than ``k`` rows nominates as many as any other.

    docs(doc).  The documents that fill a signal up are the smallest ones without a row; 2 k of them are enough.
    """
    first = docs.select("doc").orderBy("doc").limit(2 * k)
    grid = signals.where(F.col("signal").isin("bm25", "semantic", "legal")).groupBy("qid", "intent", "signal").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < k).drop("_n")
    more = grid.crossJoin(F.broadcast(first)).join(signals.select("qid", "signal", "doc"), ["qid", "signal", "doc"], "left_anti").withColumn("raw", F.lit(0.0))
    return signals.unionByName(more.select(*signals.columns))


def in_corpus_links(citations: DataFrame, corpus: DataFrame) -> DataFrame:
    """citations(doc, scr) to corpus(doc, scr): distinct edges src, dst without self links."""
    c = corpus.select(F.col("doc").alias("dst"), "scr")
    return citations.select(F.col("doc").alias("src"), "scr").join(c, "scr").where("src <> dst").select("src", "dst").distinct()


def outcome_scores(required: DataFrame, labels: DataFrame, spark: SparkSession, all_docs: DataFrame | None = None) -> DataFrame:
    """required(qid, label, pos), labels(doc, label, confidence): qid, doc, score, reason for pairs that match or conflict.

    A match gives 0.5 + 0.5 confidence, the best counts (then the first requirement); else a conflict gives 0.5 - 0.5 confidence, that
    of the first requirement by ``pos``.  All other pairs have 0.5: with all_docs(doc) they are rows too, for every query that requires
    something.
    """
    clash = spark.createDataFrame([(r, o) for r, o in CONFLICTS], "label string, other string")
    say = lambda c: F.regexp_replace(c, "_", " ")
    match = required.join(labels, "label").select("qid", "doc", "label", "pos", (0.5 + 0.5 * F.col("confidence")).alias("match"))
    best = match.groupBy("qid", "doc").agg(F.max(F.struct("match", (-F.col("pos")).alias("p"), "label")).alias("m"))
    best = best.select("qid", "doc", "m.match", F.concat(F.lit("outcome '"), say("m.label"), F.lit("' matches request")).alias("matches"))
    conflict = required.join(clash, "label").join(labels.withColumnRenamed("label", "other"), "other")
    first = conflict.groupBy("qid", "doc").agg(F.min(F.struct("pos", "other", (0.5 - 0.5 * F.col("confidence")).alias("clash"))).alias("c"))
    first = first.select("qid", "doc", "c.clash", F.concat(F.lit("outcome '"), say("c.other"), F.lit("' conflicts with request")).alias("conflicts"))
    out = best.join(first, ["qid", "doc"], "full_outer").select("qid", "doc", F.coalesce("match", "clash").alias("score"), F.coalesce("matches", "conflicts").alias("reason"))
    if all_docs is None:
        return out
    grid = required.select("qid").distinct().crossJoin(all_docs.select("doc"))  # the few queries that ask, against all documents
    full = grid.join(out, ["qid", "doc"], "left")
    return full.select("qid", "doc", F.coalesce("score", F.lit(0.5)).alias("score"), F.coalesce("reason", F.lit("outcome could not be determined")).alias("reason"))


def candidate_pool(signals: DataFrame, k: int = C.CANDIDATES) -> DataFrame:
    """signals(qid, doc, signal, raw): distinct qid, doc among the k best of any nominating signal.

    Citation nominates positive scores only, outcome never; ties go by document.
    """
    rows = signals.where(F.col("signal").isin(*C.NOMINATING) & ((F.col("signal") != "citation") | (F.col("raw") > 0)))
    w = Window.partitionBy("qid", "signal").orderBy(F.col("raw").desc(), "doc")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("qid", "doc").distinct()


def _sum_by(order: str, value: Column) -> Column:
    """The sum of ``value`` over a group in the order of ``order``: the same double wherever the rows come from."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("double").alias("v"))))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x["v"])


def contributions(signals: DataFrame, weights: DataFrame, k: int = C.CANDIDATES) -> DataFrame:
    """config, qid, doc, signal, raw, norm, eff for the pool of every configuration at once.

    signals(qid, intent, doc, signal, raw) holds applicable signals; a missing row means raw 0 (see ``padded`` for nominations by such
    rows).  Weights of applicable signals are made to sum to 1; all signals but outcome are min-max normalised within the pool.
    """
    used = signals.select("qid", "intent", "signal").distinct().join(weights.where("weight > 0"), ["intent", "signal"])
    total = used.groupBy("config", "qid").agg(_sum_by("signal", F.col("weight")).alias("total"))
    eff = used.join(total, ["config", "qid"]).select("config", "qid", "signal", (F.col("weight") / F.col("total")).alias("eff"))
    rows = signals.where(F.col("signal").isin(*C.NOMINATING) & ((F.col("signal") != "citation") | (F.col("raw") > 0)))
    w = Window.partitionBy("qid", "signal").orderBy(F.col("raw").desc(), "doc")
    nominated = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("qid", "signal", "doc")
    pool = nominated.join(eff.select("config", "qid", "signal"), ["qid", "signal"]).select("config", "qid", "doc").distinct()
    unseen = F.when(F.col("signal") == "outcome", 0.5).otherwise(0.0)  # an outcome that is not known neither fits nor clashes
    grid = pool.join(eff, ["config", "qid"]).join(signals.select("qid", "doc", "signal", "raw"), ["qid", "doc", "signal"], "left").withColumn("raw", F.coalesce("raw", unseen))
    norm = F.when(F.col("signal") == "outcome", F.col("raw")).otherwise(minmax(F.col("raw"), F.lit(True), "config", "qid", "signal"))
    return grid.withColumn("norm", norm)


def fuse(signals: DataFrame, weights: DataFrame, k: int = C.CANDIDATES) -> DataFrame:
    """config, qid, doc, score for every configuration at once (see ``contributions``).

    Parts are added in the order of their signals and the sum is rounded to 15 places: a score does not depend on the order in which rows
    arrive, and one that lies halfway between two shorter numbers is rounded up by whoever shortens it.
    """
    score = F.round(_sum_by("signal", F.col("eff") * F.col("norm")), 15)
    return contributions(signals, weights, k).groupBy("config", "qid", "doc").agg(score.alias("score"))


def explain(contributions: DataFrame) -> DataFrame:
    """contributions(qid, doc, signal, norm, eff): each signal's share, the two strongest, and a sentence."""
    c = contributions.withColumn("part", F.round(F.col("eff") * F.col("norm"), 4))
    w = Window.partitionBy("qid", "doc").orderBy(F.col("part").desc(), "signal")
    r = c.withColumn("r", F.row_number().over(w))
    ordered = F.sort_array(F.collect_list(F.when((F.col("r") <= 2) & (F.col("part") > 0), F.struct("r", "signal"))))
    return r.groupBy("qid", "doc").agg(F.sum("part").alias("score"), F.concat_ws("; ", F.transform(ordered, lambda x: x["signal"])).alias("strongest"))
