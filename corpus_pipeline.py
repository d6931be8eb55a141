"""The corpus pipeline: toxicity, near-duplicate removal, decontamination, redaction and packing of documents.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on what its predecessor kept. All but
the last return the columns of documents, the last one the packed pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import remove, written
from strandloom.llm.decontaminate import without_leaks
from strandloom.llm.ngram_join import without_near_duplicates
from strandloom.llm.packing import pack_documents
from strandloom.llm.pii import redact_pii
from strandloom.llm.queries import tokenizer_path
from strandloom.llm.toxicity import held_out, toxicity_score, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from the rows that aren't held out."""
    learnt = ~held_out(F.col("doc_id"))
    model = train_toxicity(docs.filter(learnt), spark.read.parquet(f"{sf_dir}/labels.parquet").filter(learnt))
    return docs.filter(toxicity_score(F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles of similarity 0.8 or more, one row: of the smallest doc_id, rows without one last."""
    return without_near_duplicates(docs, n=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, dealt to sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, window=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

#: Training, hashing and tokenizing can't be said in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
