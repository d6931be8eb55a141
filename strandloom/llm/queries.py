"""The registered queries of this subpackage; each reads its whole table and applies one operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import pii
from .ann import nearest_neighbours
from .decontaminate import find_leaks
from .ngram_join import ngram_jaccard
from .oracle import SQL
from .packing import pack_documents
from .sharding import histogram_shards
from .substring_dedup import substring_dedup
from .tokenfile import read_token_files, write_token_files
from .toxicity import held_out, toxicity_score, train_toxicity
from .warc import read_warc, resolve_revisits, write_warc


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=20).drop("kept_text")


def op2_nearest_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, F.col("vec_id") % 50 == 0, k=5)


def op3_decontamination(spark, sf_dir):
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    model = train_toxicity(docs.filter(~held_out(F.col("doc_id"))), labels)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, window=2048, with_ids=False)


def op6_warc(spark, sf_dir):
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), minimum=100)
    return resolve_revisits(read_warc(manifest)).drop("url")


def op7_sharding(spark, sf_dir):
    shards = histogram_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=16)
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2), with_ids=False)


def op9_ngram_join(spark, sf_dir):
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)


def op10_pii(spark, sf_dir):
    found = pii.find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind):
        return F.size(F.filter("pii", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    base = F.filter("pii", lambda s: s.kind.isin(*pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


def oracle_sql() -> dict:
    return dict(SQL)
