"""The registered queries: each runs one operator over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracle import ORACLE_SQL as ORACLE_SQL


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return near_duplicates(emb).select("vec_id", "n_links", "component_id", "kept")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("mark"))
    return mix(docs, size_col="size", mark_col="mark").select("doc_id", "size", "source_size", "target", "taken")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per finding."""
    from .secrets import annotate, common_words, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = annotate(docs, train(words=common_words(docs)), keep=["doc_id"])
    out = out.select("doc_id", F.explode("findings").alias("f"))
    return out.select("doc_id", F.col("f.start").alias("start"), F.col("f.stop").alias("stop"), F.col("f.score").alias("score"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import decode, encode

    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    out = decode(ids)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import annotate

    return annotate(table(spark, sf_dir, "documents"), 35)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import annotate

    return annotate(table(spark, sf_dir, "documents"), 400)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out("doc_id", 5, 0))
    flagged = docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out"))
    return predict(flagged, model, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out
    from .quality import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 4, 2).alias("held_out"))
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)), F.lit(2))
    out = score(docs, table(spark, sf_dir, "labels"), ~F.col("held_out"), fold, keep=["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import restored, transform

    out = transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    text = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(text).alias("restored_sha256"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import annotate

    out = annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_nearest": op2_nearest,
    "op3_mix_sources": op3_mix_sources,
    "op4_secrets": op4_secrets,
    "op5_bpe": op5_bpe,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_lexical_search": op11_lexical_search,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_decontamination": op13_decontamination,
}