"""Registered queries of the operators: name to ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, embedding_dedup, jaccard, language_id, mixing, quality, substring_dedup, token_alignment, token_files, url_filters, warc, whitening
from .common import LAST_ID, shared_path, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words each document gives to the mix of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = (F.col("mix.size") * F.col("mix.copies")).alias("taken")
    return mixing.mixed(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", taken, "mix.copies")


@register
def op2_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).drop("text_hash")


@register
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.judged(pages).select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict", "filter.matched")


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 20-word windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, divergence and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judged(docs, carry=["doc_id"]).select("doc_id", *[f"quality.{n}" for n in names])


@register
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under the links of similar texts."""
    found = jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = lambda c: F.when(c != LAST_ID, c)
    return found.select(known(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.col("head.id")).alias("component_id"))


@register
def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, completions and trained spans of all neighbouring conversations, and of all
    conversations against themselves with a cut answer."""
    conversations = table(spark, sf_dir, "conversations")
    found = chat.preference_pairs(chat.neighbours(conversations).unionByName(chat.cut_answers(conversations)))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("+", s["start"], s["length"])), ",").alias(c)
    return found.select("pair_id", "form", "sides", "turn", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"))


@register
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, as read back from the archives."""
    path = shared_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identified(docs, language_id.fit(docs))


@register
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document in the token files."""
    path = shared_path(spark, "tokens")
    write = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_tokens(write, path, tokenizer_path())
    return token_files.with_checksums(token_files.read_tokens(spark, path))


@register
def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and verdict of every vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.linked(vectors).select("vec_id", "near.n_links", "near.component_id", "near.kept")


@register
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = token_alignment.aligned(docs, tokenizer_path(), tokenizer_path(PIECES))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@register
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first components of the whitened space."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.by_component(whitening.whitened(vectors))
