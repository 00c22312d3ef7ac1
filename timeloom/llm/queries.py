"""One query per operator over its whole table, with production parameters: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import (
    binary_packing,
    chat_format,
    decontaminate,
    exact_dedup,
    html_wrappers,
    language,
    learned_partitions,
    lexical_search,
    near_dedup,
    packing,
    periodic_runs,
    quality,
    toxicity,
)
from timeloom.llm.common import digits_hash

#: The tokenizer file; a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"
#: Which remainder of crc32(doc_id) is held out of learning, and modulo what.
QUALITY_SPLIT, LANGUAGE_SPLIT, TOXICITY_SPLIT = (5, 0), (3, 1), (4, 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def learned_rows(df: DataFrame, split: tuple[int, int]) -> DataFrame:
    """The rows of ``df`` (doc_id) that a classifier may learn from."""
    return df.filter(digits_hash("doc_id", split[0]) != split[1])


def _scored(found: DataFrame, split: tuple[int, int], threshold: float) -> DataFrame:
    held_out = F.coalesce(digits_hash("doc_id", split[0]) == split[1], F.lit(False))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return found.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, learned_rows(table(spark, sf_dir, "labels"), TOXICITY_SPLIT))


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(table(spark, sf_dir, "pages"))


def op2_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.digest_rows(binary_packing.packed_matrix(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest_rows(chat_format.format_conversations(turns))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, learned_rows(table(spark, sf_dir, "labels"), QUALITY_SPLIT))
    return _scored(quality.score_documents(docs, model), QUALITY_SPLIT, quality.THRESHOLD)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.find_near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(learned_rows(docs, LANGUAGE_SPLIT))
    held_out = F.coalesce(digits_hash("doc_id", LANGUAGE_SPLIT[0]) == LANGUAGE_SPLIT[1], F.lit(False))
    return language.predict_documents(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest_rows(packing.concatenate_and_cut(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_rows(found)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    return _scored(toxicity.score_documents(docs, model), TOXICITY_SPLIT, toxicity.THRESHOLD)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def planted(w):
        begin = F.pmod(g, F.size(w))
        period = 1 + F.floor((F.size(w) - begin) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1)
        at = F.transform(places, lambda i: F.when(i < begin, i).otherwise(begin + (i - begin) % period).cast("int"))
        return F.array_join(F.transform(at, lambda i: F.get(w, i)), " ")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The words are bound to a variable: else they would be found anew for each place.
    text = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(text, "text")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest_rows(periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


def op13_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_wrappers,
        op2_binary_packing,
        op3_chat_format,
        op4_quality,
        op5_near_dedup,
        op6_language,
        op7_packing,
        op8_decontaminate,
        op9_exact_dedup,
        op10_toxicity,
        op11_lexical_search,
        op12_periodic_runs,
        op13_learned_partitions,
    )
}
