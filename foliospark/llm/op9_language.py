"""Language of a text by its nearest centroid."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix
from ._registry import keep, query, table

DIM = 4096
SAMPLE_PER_LANG = 500
CENTROIDS = 3
ROUNDS = 12
_LETTER = re.compile(r"[^\W\d_]")
_SALT2, _SALT3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHUNK = 1 << 20


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 2- and 3-byte grams of the lower-cased words; None without a letter.

    A run of ASCII characters that are no letters counts as one space, so signs
    and digits around words say nothing about the language.
    """
    if text is None or not _LETTER.search(text):
        return None
    raw = _TO_SPACE[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]
    gap = raw == 32
    raw = raw[~(gap & np.concatenate(([False], gap[:-1])))]
    out = np.zeros(DIM, np.int64)
    for at in range(0, raw.size, _CHUNK):
        b = raw[at : at + _CHUNK + 2].astype(np.uint32)
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        out += np.bincount(_CELL2[two[: _CHUNK]], minlength=DIM) + np.bincount(
            ((three * np.uint32(2654435761)) >> np.uint32(20))[: _CHUNK], minlength=DIM
        )
    return out


#: ASCII bytes other than a-z become spaces.
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[i for i in range(128) if not 97 <= i <= 122]] = 32
#: Cell of each 2-byte gram, by the rule below.
_CELL2 = (mix(np.arange(65536, dtype=np.uint64) ^ _SALT2) >> np.uint64(52)).astype(np.int64)


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            tf = counts(text.as_py())
            if tf is not None:
                total += tf > 0
                n += 1
    cells = np.append(np.flatnonzero(total), DIM)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.append(total[total > 0], n), pa.int64())], ["cell", "n"])


def spherical_means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` unit centroids of unit rows and, of each, the cosine below which a row is unlike it."""
    picks = [int(np.argmax(x @ x.mean(0)))]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin((x @ x[picks].T).max(1))))
    c = x[picks]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)
    near = x @ c.T
    own = near.argmax(1)
    limits = [np.quantile(near[own == i, i], 0.005) * 0.8 if (own == i).any() else 0.0 for i in range(len(c))]
    return c, np.array(limits)


def fit(train: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, centroids: int = CENTROIDS):
    """``(idf, langs, centroids, limits)`` learned from ``(doc_id, text, lang)``.

    Document frequencies come from all rows, summed in Spark over a fixed
    number of cells. The centroids of a language are fitted in one task on the
    ``sample_per_lang`` rows with the smallest hash of their id, a fixed bound.
    """
    train = train.filter("lang is not null and text is not null and doc_id is not null")
    sums = train.select("text").mapInArrow(_document_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1, np.float64)
    for row in sums.collect():  # at most DIM + 1 rows
        df[row["cell"]] = row["n"]
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1
    order = F.xxhash64(F.lit("centroids"), "doc_id")
    # The smallest hashes of a language, combined inside each task before the shuffle.
    bound = sample_per_lang * 2
    share = train.groupBy("lang").agg(F.count("*").alias("rows")).withColumn(
        "part", F.least(F.lit(1.0), F.lit(float(bound)) / F.col("rows"))
    )
    drawn = train.select("doc_id", "text", "lang").join(F.broadcast(share.select("lang", "part")), "lang").filter(
        F.pmod(order, F.lit(1 << 30)) < F.col("part") * (1 << 30)
    )

    def learn(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("doc_id").to_pylist())
        pick = np.argsort(ids, kind="stable")
        texts = table.column("text").to_pylist()
        rows = [vector(tf, idf) for i in pick if (tf := counts(texts[i])) is not None][:bound * 2]
        if not rows:
            return pa.table({"lang": pa.array([], pa.string()), "c": pa.array([], pa.list_(pa.float64())), "lim": pa.array([], pa.float64())})
        c, limits = spherical_means(np.stack(rows), centroids)
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(c), "c": pa.array(list(c), pa.list_(pa.float64())), "lim": limits})

    learned = drawn.groupBy("lang").applyInArrow(learn, "lang string, c array<double>, lim double").orderBy("lang").collect()
    langs = [r["lang"] for r in learned]
    return idf, langs, np.array([r["c"] for r in learned]).reshape(-1, DIM), np.array([r["lim"] for r in learned])


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; columns of these names are replaced.

    The language of the centroid with the largest cosine, which is the score.
    ``rejected`` marks a text farther from that centroid than nearly all of
    its own sample. ``und`` with score 0 for null texts, texts without a
    letter, and where nothing was learned. Repeated rows are rows of their own.
    """
    idf, langs, cents, limits = model
    rest = docs.drop("lang_pred", "score", "rejected")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text"):
                tf = counts(text.as_py()) if langs else None
                if tf is None:
                    found.append(("und", 0.0, True))
                    continue
                near = cents @ vector(tf, idf)
                i = int(near.argmax())
                found.append((langs[i], float(min(1.0, max(0.0, near[i]))), bool(near[i] < limits[i])))
            cols = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                [*batch.schema.names, "lang_pred", "score", "rejected"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(predict, f"{kinds}, lang_pred string, score double, rejected boolean")


@query("op9_language")
def op9_language(spark, sf_dir):
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(part == 2, F.lit(False))
    )
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "text", "held_out"), model).drop("text")
