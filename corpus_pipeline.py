"""A corpus pipeline of five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents.

Defined results, in every stage: a null text is empty; rows with a null or repeated id are documents like others; columns other than
doc_id, text, lang, source and n_chars may have any name, also one of those used inside, and are kept as they are; a table
without rows gives none. Equal rows are one document from the second stage on, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import bpe, classifier, jaccard, mixing, secret_scan
from scrubline.llm.common import materialize, table
from scrubline.llm.queries import LIKES_IT, held_out, tokenizer_path


OWN = ("doc_id", "text", "lang", "source", "n_chars")  # the columns the stages read


def _plain(docs: DataFrame) -> DataFrame:
    """The columns that stages do not read are numbered, so that no name a stage uses inside can clash with theirs."""
    return docs.toDF(*[c if c in OWN else f"other_{i}" for i, c in enumerate(docs.columns)])


def _named(out: DataFrame, plain: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*plain.columns).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score predicts quality 0 go. Rows without an id are scored and kept or dropped like others."""
    plain = _plain(docs)
    model = classifier.train(plain, table(spark, sf_dir, "labels"), teaches=~held_out())
    return _named(classifier.score(plain, model).where(F.col("score") >= LIKES_IT), plain, docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents, the one with the lowest id stays."""
    plain = _plain(docs)
    return _named(jaccard.one_of_each(plain), plain, docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts are replaced by a mark; n_chars follows the text."""
    plain = _plain(docs)
    clean = secret_scan.redact(secret_scan.find_secrets(plain))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _named(clean, plain, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in rows of their own."""
    plain = _plain(docs)
    mixed = mixing.mix_sources(plain).where("copies > 0")
    return _named(mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), plain, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (little-endian 32-bit integers), their number, and whether they decode to the text."""
    read = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), ids="ids", decoded="_decoded")
    return read.select("doc_id", "lang", "source", bpe.id_count(F.col("ids")).cast("bigint").alias("n_tokens"), "ids",
                       (F.col("_decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality_classifier", quality_classifier), ("jaccard_join", jaccard_join), ("secret_scans", secret_scans), ("mix", mix), ("encode", encode)]

# A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
