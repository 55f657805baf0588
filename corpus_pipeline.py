"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All stages but the last return the columns of ``documents``.

An empty table stays empty. Rows with a null id pass the row-wise stages like
others and end in deduplication, where only a row with an id can be kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liftlens.llm import decontaminate, langid_ppm, near_dup, packing, secrets
from liftlens.llm.common import bound_batches, materialize, scratch, table, without
from liftlens.llm.queries import ppm_held_out, tokenizer_path

MIN_LANGUAGE_SCORE = 0.5
CACHED_RUNS = 100_000  # of the tokenizer; workers hold what earlier stages left besides


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letter in the text, or no language
    with at least half of the score."""
    bound_batches(spark)
    trees = langid_ppm.learn(docs.filter(~ppm_held_out()))
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    read = docs.select("doc_id", "text", *(F.col(c).alias(f"_{c}") for c in others))
    told = langid_ppm.identify(read, trees, carry=("text", *(f"_{c}" for c in others)))
    kept = told.filter((F.col("lang_pred") != langid_ppm.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*(F.col(c if c in ("doc_id", "text") else f"_{c}").alias(c) for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component."""
    bound_batches(spark)
    with scratch(spark):
        copies = near_dup.near_duplicates(docs).filter("doc_id is not null and not kept").select("doc_id").distinct()
        copies = materialize(copies, "copies", stays=True)
    return without(docs.filter("doc_id is not null"), copies, "doc_id")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages in a twentieth of their words or more."""
    bound_batches(spark)
    with scratch(spark):
        found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), unnamed=True)
        hit = found.filter("contaminated and doc_id is not null").select("doc_id").distinct()
        hit = materialize(hit, "contaminated", stays=True)
    return without(docs, hit, "doc_id")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows where a text changed."""
    bound_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    read = docs.select("doc_id", "text", *(F.col(c).alias(f"_{c}") for c in others))
    found = secrets.scan(read, with_text=True, carry=tuple(f"_{c}" for c in others))
    columns = {c: F.col(f"_{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.size("spans") > 0, F.char_length("text").cast(kind)).otherwise(F.col("_n_chars"))
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences."""
    bound_batches(spark)
    pieces = packing.tokenize(docs, tokenizer_path(), cached=CACHED_RUNS)
    about = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(materialize(about, "pieces"))


STAGES = [
    ("language", language),
    ("deduplicate", deduplicate),
    ("decontaminated", decontaminated),
    ("redacted", redacted),
    ("packed", packed),
]

# The language and secret stages have no SQL form; tests hold the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
