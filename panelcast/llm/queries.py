"""The registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm import align, bpe, html, language, lines, lsh, neighbors, packing, repeats, resample, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_nearest_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbors.nearest(rows, rows.where(F.col("vec_id") % 20 == 0)).withColumnRenamed("id", "vec_id")


@query
def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its 200-byte strings that start anywhere else too."""
    return repeats.digests(table(spark, sf_dir, "documents"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a tenth of its source's documents share."""
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


ORACLE["op8_line_dedup"] = lines.check_sql()


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    pages = table(spark, sf_dir, "pages")
    judged = urls.judge(pages, urls.labelled_pages(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLE["op9_url_filter"] = urls.check_sql()


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs.where(~language.held_out()))
    said = language.identify(docs, model)
    return said.select(F.col("id").alias("doc_id"), language.held_out("id").alias("held_out"), "lang_pred", "score")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece of every document."""
    return packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the ids of every document, and of the bytes they decode to."""
    done = bpe.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
    return done.withColumnRenamed("id", "doc_id")


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return lsh.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the archives says."""
    return warc.archived(table(spark, sf_dir, "pages"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two tokenizers, and how common its linked id pairs are."""
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return align.aligned(table(spark, sf_dir, "documents"), *files, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight and score of every document towards the benchmark texts, and the rank of those drawn."""
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id")
