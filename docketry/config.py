"""Constants of the retrieval engine."""

from __future__ import annotations

# Signals, intents, weights, polarity weights and thresholds of the scoring model.
SIGNALS = ("bm25", "semantic", "legal", "citation", "outcome")
SEMANTIC_VARIANTS = ("whole", "chunked_max", "chunked_mean3")
NOMINATING = ("bm25", "semantic", "legal", "citation")
INTENTS = ("FACTUAL_SIMILARITY", "LEGAL_ISSUE", "STATUTE_BASED", "SUPPORTING_PRECEDENT", "CONTRASTING_PRECEDENT")
LEGAL_PARTS = {"act": 0.30, "section": 0.40, "issue": 0.30}
FIXED = {
    "F1_pdf_column_mean": (0.15, 0.30, 0.32, 0.11, 0.12),
    "F2_lexical_anchor": (0.40, 0.15, 0.30, 0.10, 0.05),
    "F3_equal": (0.20, 0.20, 0.20, 0.20, 0.20),
}
PAIRWISE = {
    "bm25_legal": ((0.7, 0, 0.3, 0, 0), (0.5, 0, 0.5, 0, 0), (0.3, 0, 0.7, 0, 0)),
    "bm25_semantic": ((0.7, 0.3, 0, 0, 0), (0.5, 0.5, 0, 0, 0), (0.3, 0.7, 0, 0, 0)),
}
TABLE = {
    "FACTUAL_SIMILARITY": (0.20, 0.40, 0.20, 0.10, 0.10),
    "LEGAL_ISSUE": (0.20, 0.30, 0.35, 0.10, 0.05),
    "STATUTE_BASED": (0.15, 0.20, 0.50, 0.10, 0.05),
    "SUPPORTING_PRECEDENT": (0.10, 0.25, 0.30, 0.20, 0.15),
    "CONTRASTING_PRECEDENT": (0.10, 0.35, 0.25, 0.05, 0.25),
}
ADAPTIVE = {
    "A1_pdf_table": (None, 0.0),
    "A2_pdf_table_lexical_anchor": ("F2_lexical_anchor", 0.5),
    "A3_pdf_table_equal_blend": ("F3_equal", 0.5),
}
POLARITY_WEIGHTS = {
    "SUPPORTING_PRECEDENT": {"positive": 1.0, "neutral": 0.6, "negative": 0.15},
    "CONTRASTING_PRECEDENT": {"positive": 0.15, "neutral": 0.4, "negative": 1.0},
    "other": {"positive": 1.0, "neutral": 0.8, "negative": 0.8},
}
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CHUNK_SIZE, CHUNK_OVERLAP = 400, 100
CANDIDATES, SEEDS, TOP_K, RUN_DEPTH, LISTED_K = 100, 10, 10, 20, 40
# First parties that name no one.
GENERIC_PARTIES = ("state", "union of india", "union", "the state", "state of", "commissioner", "government")
SEED = 42
VECTOR_SIZE, WINDOW_SIZE, MIN_COUNT = 100, 8, 2

# Function words that carry no retrieval signal.
STOPWORDS = (
    "a an the of to in for on by with at from as is are was were be been being and or that this these those it its which who "
    "whom what when where can could would should may might shall will do does did has have had there their them they he she his her "
    "i we you me my our your find cases case judgments judgment show give list any about supreme court whether how under"
).split()
