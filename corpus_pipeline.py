"""Corpus pipeline: the stages that turn raw documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of the documents they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import decontam, language_id, minhash, packing, suffix_dedup
from emberlake.llm.queries import vocabulary_path
from emberlake.llm.runtime import Scratch, prepare, row_keys, table

LEAST_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts whose language is in doubt. Learns from the labelled rows of docs; without any,
    nothing is known of languages, and only texts without letters go. Null and empty texts go; rows are judged one by one."""
    langs, matrix = language_id.train(docs)
    own = {c: f"d_{c}" for c in docs.columns}
    judged = language_id.predict(docs.select(*(F.col(c).alias(n) for c, n in own.items()), "text"), langs, matrix, carry=list(own.values()))
    sure = (F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE) if langs else F.col("d_text").rlike(r"\p{L}")
    return judged.where(sure).select(*(F.col(n).alias(c) for c, n in own.items()))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: the one with the smallest doc_id, null last. Rows with null or repeated ids are
    told apart, texts without words are groups of their own, so no row goes for its id or for being empty."""
    scratch = Scratch(spark)
    own = {c: f"d_{c}" for c in docs.columns}
    rows, _ = row_keys(docs.select(*(F.col(c).alias(n) for c, n in own.items())), scratch, "d_doc_id")
    groups = minhash.linked_rows(rows.select("row", F.col("d_text").alias("text")), scratch, minhash.SketchParams(k=5)).select("row", "component")
    order = F.struct(F.col("d_doc_id").isNull(), "d_doc_id", "row")
    first = rows.select("row", "d_doc_id").join(groups, "row").groupBy("component").agg(F.min_by("row", order).alias("row"))
    return rows.join(first, "row", "left_semi").select(*(F.col(n).alias(c) for c, n in own.items()))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 and more that occur elsewhere; drops documents of which nothing is left. Documents without such a
    string stay as they are, null and empty ones too."""
    own = {c: f"d_{c}" for c in docs.columns if c != "text"}
    plain = docs.select(F.col("doc_id"), "text", *(F.col(c).alias(n) for c, n in own.items()))
    done = suffix_dedup.remove_repeats(plain, carry=list(own.values()), as_text=True)
    touched = F.size("spans") > 0
    left = done.where(~touched | (F.trim("kept") != ""))
    made = {"text": F.col("kept")}
    if "n_chars" in own:
        made["n_chars"] = F.when(touched, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d_n_chars"))
    return left.select(*(made.get(c, F.col(own.get(c, c))).alias(c) for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, exact or with substituted words; null and empty texts stay."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences; a null or empty text is one piece that holds only the end id."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Models, sketches and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = scratch.write(out, name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    raise AssertionError("no stages")
