"""The registry of evaluated systems and a runner that ranks all queries with each of them from shared signals."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import config as C
from docketry.operators import retrieval as R
from docketry.operators import scoring as S


@dataclass(frozen=True)
class System:
    """A ranking: one signal alone, or weights by intent; ``source`` says whose intents the signals were computed with."""

    id: str
    signal: str | None = None
    config: str | None = None
    row: tuple[float, ...] | None = None
    variant: str = "chunked_max"
    disabled: tuple[str, ...] = ()
    source: str = "predicted"


def baseline_systems() -> list[System]:
    return [
        System("B1_bm25", signal="bm25"), System("B2_embedding_whole", signal="semantic", variant="whole"), System("B3_embedding_chunked_max", signal="semantic"),
        System("B3b_embedding_chunked_mean3", signal="semantic", variant="chunked_mean3"), System("X_legal_only", signal="legal"),
    ]


def hybrid_systems(variants: tuple[str, ...] = C.SEMANTIC_VARIANTS, fixed: tuple[str, ...] | None = None, adaptive: tuple[str, ...] | None = None, pairwise: bool = True) -> list[System]:
    """BM25 with the legal signal once for each weight row; all that use vectors once for each variant."""
    out = [System(f"B4_bm25_legal_w{j}", config=f"bm25_legal_{j}") for j in range(len(C.PAIRWISE["bm25_legal"]))] if pairwise else []
    for v in variants:
        if pairwise:
            out += [System(f"B5_bm25_sem_w{j}__{v}", config=f"bm25_semantic_{j}", variant=v) for j in range(len(C.PAIRWISE["bm25_semantic"]))]
        out += [System(f"B6_fixed_{n}__{v}", config=n, variant=v) for n in fixed or tuple(C.FIXED)]
        out += [System(f"B7_adaptive_{n}__{v}", config=n, variant=v) for n in adaptive or tuple(C.ADAPTIVE)]
    return out


def ablation_systems(adaptive: str, variant: str) -> list[System]:
    """The full system, without each signal, with the mean row of its table, with the gold intent, and with the rules' intent."""
    out = [System("FULL", config=adaptive, variant=variant)]
    out += [System(f"FULL_minus_{s}", config=adaptive, variant=variant, disabled=(s,)) for s in C.SIGNALS]
    base, lam = C.ADAPTIVE[adaptive]
    other = C.FIXED[base] if base else (0.0,) * len(C.SIGNALS)
    table = [[(1 - lam) * t + lam * b for t, b in zip(C.TABLE[i], other, strict=True)] for i in C.INTENTS]
    out.append(System("FULL_fixed_weights", row=tuple(sum(col) / len(table) for col in zip(*table, strict=True)), variant=variant))
    return out + [System("FULL_oracle_intent", config=adaptive, variant=variant, source="gold"), System("FULL_rule_intent", config=adaptive, variant=variant, source="rule")]


def weights_of(spark: SparkSession, systems: list[System]) -> DataFrame:
    """config (the system's id), intent, signal, weight; disabled signals left out."""
    rows = []
    known = {(r.config, r.intent, r.signal): r.weight for r in S.resolve_weights(spark).collect()}  # a few hundred constants
    for x in systems:
        for i in C.INTENTS:
            for n, s in enumerate(C.SIGNALS):
                w = x.row[n] if x.row else known[x.config, i, s]
                if s not in x.disabled:
                    rows.append((x.id, i, s, float(w)))
    return spark.createDataFrame(rows, "config string, intent string, signal string, weight double")


def run_systems(signals: dict[tuple[str, str], DataFrame], systems: list[System], depth: int = C.RUN_DEPTH) -> DataFrame:
    """system, qid, doc, rank up to ``depth``.  signals by (variant, source): the tables of ``search.compute_signals``.

    Systems of the same signals are fused together.  A single signal ranks its documents by raw score; BM25 only those over 0.
    """
    runs = None
    for key in sorted({(x.variant, x.source) for x in systems}):
        mine, rows = [x for x in systems if (x.variant, x.source) == key], signals[key]
        found = []
        for x in (x for x in mine if x.signal):
            one = rows.where(F.col("signal") == x.signal).select("qid", "doc", F.round("raw", 9).alias("score"))
            found.append(R.top_k(one, depth, by="qid", tie="doc", positive=x.signal == "bm25").select(F.lit(x.id).alias("system"), "qid", "doc", "rank"))
        if fused := [x for x in mine if not x.signal]:
            scores = S.fuse(rows, weights_of(rows.sparkSession, fused)).withColumn("score", F.round("score", 9)).withColumn("by", F.struct("config", "qid"))
            found.append(R.top_k(scores, depth, by="by", tie="doc").select(F.col("config").alias("system"), "qid", "doc", "rank"))
        for f in found:
            runs = f if runs is None else runs.unionByName(f)
    return runs


def comparisons(main: str, systems: list[str]) -> list[tuple[str, str]]:
    """The paired tests of a report: the main system against each other one, in order, without itself and repeats."""
    return [(main, x) for x in dict.fromkeys(systems) if x != main]


def select_config(summary: DataFrame, prefix: str, *, first: str = "ndcg5", then: str = "mrr5") -> DataFrame:
    """system: the best of those whose id begins with ``prefix``; equal in both metrics (9 places): the greater id."""
    best = F.max(F.struct(F.round(first, 9).alias("a"), F.round(then, 9).alias("b"), F.col("system").alias("system")))
    return summary.where(F.col("system").startswith(prefix)).agg(best.alias("x")).where("x IS NOT NULL").select("x.system")


def with_defaults(overrides: str | None = None) -> dict[str, str]:
    """The selected configuration; ``overrides`` is JSON of a selection made on validation queries."""
    out = {"semantic_variant": "chunked_max", "fixed": "F1_pdf_column_mean", "adaptive": "A1_pdf_table"}
    return out | (json.loads(overrides) if overrides else {})
