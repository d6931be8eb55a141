"""The stages on sf0.001: each one's decisions against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import jaccard

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, docs, DATA), "test")
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(spark, stages):
    assert [name for name, _, _ in stages] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, _, after in stages[:-1])


def test_near_duplicates(stages):
    _, before, after = stages[1]
    groups = jaccard([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in groups.items() if c == i}


def test_decontamination(spark, stages):
    _, before, after = stages[2]
    norm = lambda t: WORD.findall((t or "").lower())
    items = {tuple(norm(r["text"])) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        w = norm(r["text"])
        whole = any(tuple(w[at : at + len(i)]) == i for i in items for at in range(len(w) - len(i) + 1))
        assert not (whole and r["doc_id"] in kept)


def test_redaction_and_packing(stages):
    _, before, after = stages[3]
    assert before.count() == after.count() and after.filter(r"text rlike '[a-z0-9]@[a-z0-9]+\\.'").count() == 0
    assert after.filter("n_chars <> length(text)").count() == 0
    _, before, packed = stages[4]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}
    total = Counter()
    for r in packed.collect():
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= 2048


HARD = "doc_id long, text string, lang string, source string, n_chars long, _class string, _look int, pii string, class string"


def hard_rows():
    words = [f"w{i}" for i in range(1000)]
    text = lambda i, n=100: " ".join(words[3 * i : 3 * i + n])
    some = [(5, text(0)), (None, text(1)), (2, text(0)), (2, text(0)), (2, text(80)), (2, text(81)), (7, text(120)), (7, text(121)), (None, text(200)), (None, text(200)), (8, None), (8, ""), (9, " \n"), (None, None)]
    return [(i, t, None, "s", len(t or ""), "clash", 1, "x", None) for i, t in some]


def test_near_duplicates_row_by_row(spark):
    docs = spark.createDataFrame(hard_rows(), HARD).repartition(3)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert after.columns == docs.columns
    found = sorted((r["doc_id"] or 0, len((r["text"] or "").split()), (r["text"] or "").split()[:1]) for r in after.collect())
    assert [(i, n) for i, n, _ in found] == [(0, 0), (0, 100), (2, 100), (2, 100), (7, 100), (8, 0), (8, 0), (9, 0)]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0


def test_stages_keep_clashing_columns_and_take_empty_tables(spark):
    docs = spark.createDataFrame(hard_rows(), HARD)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        assert name == "packing" or after.columns == docs.columns
        assert after.count() > 0 and stage(spark, docs.limit(0), DATA).count() == 0
