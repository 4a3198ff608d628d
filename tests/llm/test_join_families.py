"""Families of near copies that stay apart, and large buckets, against all pairs."""

import random

import numpy as np
import pytest
from foliospark.llm import op2_ngram_join as join
from foliospark.llm._arrays import shingle_set
from pyspark.sql import functions as F


def family(seed, size, words, edits):
    """Copies of one text, each with some words of its own: pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(words)]
    out = []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"u{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def brute(texts):
    sets = [shingle_set(t.encode()) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(texts)):
        for j in range(i):
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * common >= 75 * (sets[i].size + sets[j].size - common):
                links += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))], links


@pytest.mark.parametrize("small, block", [(16, 256), (2, 7), (4, 40)])
def test_families_near_the_threshold(spark, monkeypatch, small, block):
    monkeypatch.setattr(join, "SMALL_BUCKET", small)
    monkeypatch.setattr(join, "BLOCK", block)
    texts = family(1, 90, 120, 9) + family(2, 40, 30, 3) + family(3, 25, 300, 30) + [f"alone {i} w w w w" for i in range(20)]
    want, links = brute(texts)
    assert len(set(want)) > 25 and links > 200
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in join.classes(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_block_links_are_few_and_connect(spark):
    """Every pair of a bucket is linked: as many links as merge its members, however many pairs there are."""
    texts = family(5, 60, 400, 3)
    want, links = brute(texts)
    assert set(want) == {0} and links == 60 * 59 // 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    view = spark.createDataFrame([(s, i, i, 400) for s in (1, 2, 3) for i in range(60)], "sig long, doc long, comp long, n_max long")
    sketches = spark.createDataFrame([(i, 400, bytearray(join.sketch(shingle_set(t.encode())))) for i, t in enumerate(texts)], "doc long, n_max long, sketch binary")
    got = join.block_links(view, sketches, docs).collect()
    assert len(got) == 59
    assert len(join.block_links(view, sketches.withColumn("sketch", F.lit(None).cast("binary")), docs).collect()) == 59
    comps = spark.createDataFrame([(1, i, i % 2, 400) for i in range(60)], "sig long, doc long, comp long, n_max long")
    assert join.block_links(comps, sketches, docs).count() == 1
    assert join.block_links(comps.filter("comp = 0"), sketches, docs).count() == 0
