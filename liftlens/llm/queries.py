"""The registered queries of the operators, over whole tables.

Each takes (spark, sf_dir), calls its operator with production parameters and
derives the digest columns of its contract from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm_lm, langid_ppm, lemp, maglev, maxscore, near_dup, packing, quality, secrets, shared_terms, url_filter, vectors, warc
from .common import id_crc, materialize, shared_path, table
from .url_filter import SiteRule

SITE_RULES = [
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
]
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    # the digest is taken before packing, so that no token ids are shuffled
    about = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(materialize(about, "pieces"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = warc.archive(pages, shared_path(spark, "warc"))
    records = warc.read_records(archives, payloads=False)
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.col("record_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), with_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "removed_lines"
    )


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = hmm_lm.held_out("doc_id")
    scored = hmm_lm.score(docs, hmm_lm.train(docs.filter(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = url_filter.mine_rules(url_filter.label_urls(pages, table(spark, sf_dir, "labels")))
    return url_filter.judge(pages, SITE_RULES, rules)


def ppm_held_out() -> Column:
    return F.coalesce(id_crc(F.col("doc_id")) % 4 == 2, F.lit(False))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = langid_ppm.learn(docs.filter(~ppm_held_out()))
    return langid_ppm.identify(docs, trees).select("doc_id", ppm_held_out().alias("held_out"), "lang_pred", "score")


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maglev.place(table(spark, sf_dir, "documents"), SHARDS)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        number("assign"),
        number("access"),
        number("hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(maxscore.build_index(found), found.filter(F.col("id") % 50 == 0), 5)


def op12_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_terms.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op13_lemp(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = vectors.integer_vectors(table(spark, sf_dir, "embeddings"), carry={"label": label})
    return lemp.hard_negatives(found, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_warc,
        op3_quality,
        op4_hmm,
        op5_url_rules,
        op6_ppm,
        op7_near_dup,
        op8_sharding,
        op9_decontaminate,
        op10_secrets,
        op11_maxscore,
        op12_shared_terms,
        op13_lemp,
    )
}
