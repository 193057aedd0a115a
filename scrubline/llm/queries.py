"""The queries of the thirteen operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classifier, collocations, fingerprints, islands, jaccard, mixing, packing, rules, secret_scan, variants, warc
from .common import scratch_path, table
from .oracles import ORACLES  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER, RANKS, WORD_TOKENIZER = (os.environ.get(f"SCRUBLINE_{x}", "") for x in ("TOKENIZER", "RANKS", "WORD_TOKENIZER"))
LIKES_IT = 0.3  # scores from here on predict label 1


def tokenizer_path() -> str:
    """The vocabulary file: the one the environment names, else that of the installed package."""
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    if RANKS:
        return RANKS
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def word_tokenizer_path() -> str:
    if WORD_TOKENIZER:
        return WORD_TOKENIZER
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_successor(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("bigint")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secret_scan.BASE),
                        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.sql(r"""select -7L as conv_id, turn, role, r'\### Assistant: </turn> ok' as text
                         from values (0L, 'user'), (1L, 'assistant') as t(turn, role)""")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    read = chat.read_chats(chat.format_chats(said))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "rewrites")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.scratch_path(spark, "warc")
    written = warc.write_archives(warc.plan_revisits(table(spark, sf_dir, "pages")), f"{folder}/whole")
    normal = warc.normalise(written, f"{folder}/members")
    return warc.read_archives(spark, normal, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return decoded.select("doc_id", bpe.id_count(F.col("ids")).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole packed matrix is written and read again; of what was read come each row's segments and digests of its ids and positions."""
    encoded = packing.token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks_path(), bpe.PATTERN, width=2).drop("text")
    folder = scratch_path(spark, "packed")
    packing.write_packed(packing.pack(encoded, id_bytes=2), folder)
    return packing.read_packed(spark, folder).select("shard", "row", "n_ids", "n_segments", "cu_seqlens", "doc_ids", "pieces", "offsets",
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(documents, table(spark, sf_dir, "labels"), teaches=~held_out())
    return classifier.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIKES_IT).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents")))


def op13_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.pack(islands.pieces(table(spark, sf_dir, "documents"), word_tokenizer_path()))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_fingerprints, op2_secret_scan, op3_chat_format, op4_jaccard_join, op5_quality_rules, op6_warc, op7_pareto_mix, op8_bpe, op9_packing,
    op10_quality_classifier, op11_collocations, op12_spelling_variants, op13_island_packing)}
