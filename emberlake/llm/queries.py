"""The registered queries of this subpackage: each applies its operator to a whole table of the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import ann_tree, decontam, hmm, language_id, minhash, oracles, packing, quality, suffix_dedup, url_filter, warc
from emberlake.llm.runtime import fold, table

RULES = [
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
]


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled outcomes: labels.quality of the page with the same number (the tables carry no other page labels)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    outcomes = pages.join(labels, "page_id").select("url", "good")
    return url_filter.judge_urls(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann_tree.usable(table(spark, sf_dir, "embeddings"))
    return ann_tree.search(vectors, vectors.where("vec_id % 20 = 0"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    pairs = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return resolved.select("record_id", "url_key", "target_id", "status", F.array_join(pairs, ";").alias("headers"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["begin"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, matrix = language_id.train(docs.where(fold("doc_id", 4) != 2))
    return language_id.predict(docs, langs, matrix).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.SketchParams(k=4))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.score(docs, quality.train(docs, labels)).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ann, op3_packing, op4_warc_revisits, op5_suffix_dedup, op6_language_id, op7_decontamination, op8_near_duplicates, op9_quality, op10_hmm)}

#: The other operators train, sketch, tokenise or search approximately; tests hold them against brute force.
ORACLE_SQL = {"op1_url_filter": oracles.URL_FILTER, "op4_warc_revisits": oracles.WARC_REVISITS}
