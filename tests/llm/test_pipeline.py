"""The stages of the pipeline on the smallest tables, each held against its input."""

import re

import corpus_pipeline
import pytest
from foliospark.llm._registry import keep
from foliospark.llm.op2_ngram_join import classes
from foliospark.llm.op10_mixing import mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "copy"]


def test_rejected_documents_go(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = set(ids(steps[1]))
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(i in left for i, q in labels.items() if q == 0) <= 0.25 * sum(q == 0 for q in labels.values())


def test_one_of_each_class_stays(steps):
    roots = [tuple(r) for r in classes(steps[1]).select("doc_id", "component_id").collect()]
    assert ids(steps[2]) == sorted({c for _, c in roots})


def test_repeated_and_missing_ids_lose_no_text(spark):
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [(1, "b", words("x")), (1, "a", words("y")), (2, "a", words("y") + " end"), (None, "c", words("z")),
            (None, "b", words("z")), (None, "c", words("x")), (None, None, None), (3, "a", words("u"))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    want = [(1, "a", words("y")), (1, "b", words("x")), (3, "a", words("u")), (None, "b", words("z")), (None, None, None)]
    for given in (docs, docs.repartition(3)):
        kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, given, SF).collect()]
        assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_leaks_go(spark, steps):
    plain = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    items = [plain(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in steps[2].collect() if any(i in plain(r["text"]) for i in items)}
    assert not hit & set(ids(steps[3])) and len(ids(steps[3])) >= len(ids(steps[2])) - 2 * len(hit) - 2


def test_personal_values_change(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    value = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d{3}\) \d{3}-\d{4}")
    after = {r["doc_id"]: r for r in steps[4].collect()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        found = value.findall(text)
        assert not any(v in after[i]["text"] for v in found) and after[i]["n_chars"] == len(after[i]["text"])
        if not re.search("[0-9@]|AKIA", text):
            assert after[i]["text"] == text


def test_mixture(steps):
    want = {(r["doc_id"], i) for r in mix(steps[4]).collect() for i in range(1, r["copies"] + 1)}
    assert {(r["doc_id"], r["copy"]) for r in steps[5].collect()} == want
