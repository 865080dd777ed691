"""A corpus pipeline of five stages over documents, each one operator.

Language ID -> near duplicates -> secrets -> mixing -> tokens.  A stage takes (spark, docs,
sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: rows with a null id pass every stage on their own text; null and empty texts, and
texts without a letter, go in the first stage; repeated rows go in the second, all but one; a text
of any length is one row, taken whole; an empty table stays empty; more columns pass through all
stages but the last, whatever their names.  Stages that send whole rows to Python lower the
session's rows per Arrow batch to 500, and leave it there: what they return is run by the caller.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, ngram_join, secrets
from lodestone.llm.common import cut, drop, table

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")
#: The stages need trained models and merges, which SQL cannot express.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Whole rows with their texts go through Python here, outside the executors' heap: few at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def shielded(stage):
    """The stage with columns of the documents that it doesn't know out of the way of those it adds."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = {c: c if c in KNOWN else f"extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(x) for c, x in inside.items()]), sf_dir)
        return out.select(*[F.col(x).alias(c) for c, x in inside.items()])

    return run


@shielded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language is rejected (no letter, or unlike every learned language) go."""
    small_batches(spark)
    model = langid.train(docs)
    return langid.predict(docs, model).where(~F.col("rejected")).select(*docs.columns)


@shielded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts the document of least id stays, once."""
    groups = ngram_join.near_duplicates(docs.select("doc_id", "text"))
    kept = cut(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")))
    one, many = kept.where("copies = 1").select("doc_id"), kept.where("copies > 1").select("doc_id")
    few = kept.count() <= 500_000
    pick = lambda ids: docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    out = pick(one).unionByName(docs.where(F.col("doc_id").isNull()))
    return out if many.isEmpty() else out.unionByName(pick(many).dropDuplicates(["doc_id"]))


@shielded
def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows the text it counts."""
    small_batches(spark)
    out = secrets.annotate(docs, secrets.train(words=secrets.common_words(docs)))
    hit = F.size("findings") > 0
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col("redacted")).select(*docs.columns)


@shielded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(mixing.mix(docs), docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and token_ids (little-endian u32)."""
    small_batches(spark)
    return bpe.encode(docs, keep=["doc_id", "source", "lang"])


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
