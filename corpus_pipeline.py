"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Every stage takes rows as they come: null and empty texts are texts without words, rows without a doc_id and repeated rows are rows
of their own, other columns pass through whatever their names (n_chars follows where the text changed), and an empty table gives an empty one.
Where documents tie, the one of the smallest doc_id stays or keeps its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import linededup, nearcopies, packing, suffix, toxicity
from docketry.llm.common import Scratch, table

#: Chunks whose ids a worker keeps: half of what packing alone may, as workers live through all stages beside their tasks.
KEPT_CHUNKS = 300_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_text(cleaned: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents from (row, kept); n_chars follows where the text changed."""
    changed = ~F.col("kept").eqNullSafe(F.col("row.text"))
    out = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in columns else None}
    return cleaned.select(*[(out[c] if c in out else F.col("row")[c]).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score as toxic go.

    Null and empty texts score as texts in which no sentence offends; null labels, and labels of unknown documents, teach nothing; without
    labels of both kinds nothing goes.
    """
    return toxicity.reject(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: cross-site boilerplate lines go, but for the one document that keeps them.

    Documents that lines on ten sites or more make up by over half are left whole: such a one is most often a copy of a page that
    went to many sites, and the next stage keeps one of each; cut here, its near copies would leave their odd lines behind.
    Null texts stay null, blank lines stay; rows without a doc_id lose the lines that a document with one keeps; repeated rows are
    treated alike.
    """
    return _with_text(linededup.clean_lines(docs, leave=0.5), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each near-duplicate component (five-word shingles, similarity 0.8) stays, that of the smallest id.

    SimHash of 256 bits with pigeonring filtering, and the exact similarity of what passes (see ``nearcopies``).  Texts without words are
    copies of each other; rows without a doc_id stay, and rows that repeat a kept doc_id do.
    """
    return nearcopies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: byte strings of 50 or more that a document of smaller id holds too are cut out.

    Null texts stay null, rows without a doc_id stay as they are, rows of one doc_id do not cut each other.
    """
    return _with_text(suffix.clean(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: power-of-two sequences; a null or empty text is the one token that ends a document."""
    return packing.pack(docs, keep=KEPT_CHUNKS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: Learned scores, fingerprints and token ids have no SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again as the next stage's input."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
