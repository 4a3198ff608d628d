"""Toxicity from two class-conditional Kneser-Ney models of word pairs, toxic and ordinary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix
from ._registry import keep, query, table
from ._tokens import byte_set, hashes, tokens

#: Bound of the labelled texts the models learn from, of either class; a hash of the id picks them.
MAX_ROWS = 10000
#: Taken off every count of a class and given to the shared backoff.
DISCOUNT = 2.0
#: So much of a difference of log-likelihoods says nothing about the class.
MARGIN = 1.0
#: Parts of the sample; the curve from log-ratios to scores is fitted on each part with models of the others.
FOLDS = 4
#: Added to the number of words, so that one word of a short text weighs less.
EXTRA_WORDS = 10
THRESHOLD = 0.5
_BATCH = 4 << 20
#: Words are runs of ASCII letters and digits and of bytes beyond ASCII, in lower case.
_IS_WORD = byte_set(range(48, 58), range(97, 123), range(128, 256))


def _parts(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Texts in lower case, a few megabytes at a time; a longer text comes alone."""
    held, size = [], 0
    for t in texts:
        held.append((t or "").lower().encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= _BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each word in the list of distinct ones, hashes of these, and where each text begins."""
    starts, _, ids, distinct = tokens(np.frombuffer(b" ".join(texts), np.uint8), _IS_WORD)
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return ids, hashes(distinct), np.searchsorted(starts, begin)


def _before(word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The word before each one, 0 for the first of a text."""
    before = np.concatenate((np.zeros(1, word.dtype), word[:-1])) if word.size else word.copy()
    before[bounds[:-1][np.diff(bounds) > 0]] = 0
    return before


def _first(n: int, *columns: np.ndarray) -> list[np.ndarray]:
    """Sorted rows, the first of those that agree in the ``n`` leading columns."""
    order = np.lexsort(columns[::-1])
    rows = [c[order] for c in columns]
    new = np.ones(order.size, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in rows[:n]])
    return [c[new] for c in rows]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct ``(part, word, word before, word before that)`` of some texts; 0 stands before the first word of a text.

    A text names a pair once, however often it repeats it.
    """
    for batch in batches:
        marks, at = batch.column("part").to_numpy(zero_copy_only=False), 0
        for texts in _parts(batch.column("text").to_pylist()):
            ids, names, bounds = _words(texts)
            text = np.repeat(np.arange(at, at + len(texts)), np.diff(bounds))
            at += len(texts)
            word = names[ids].view(np.int64) if ids.size else np.empty(0, np.int64)
            before = _before(word, bounds)
            _, word, before, ahead, part = _first(3, text, word, before, _before(before, bounds), marks[text])
            part, word, before, ahead = _first(4, part, word, before, ahead)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(word), pa.array(before), pa.array(ahead)], ["part", "w", "v", "u"])


def words_given_class(counts: np.ndarray, rare: np.ndarray, discount: float = DISCOUNT) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each word in the two models, and what either gives the shared backoff.

    ``counts`` (words x 2, ordinary and toxic) are continuation counts, the
    numbers of different words seen before a word; ``rare`` sums those of the
    words that no class has more often than the discount. Counts of the larger
    class are scaled to the smaller one, so that both back off with like
    weights. What the discount takes off is pooled into one backoff
    distribution that both models share: an expression rare in both gets
    nearly the same probability from either.
    """
    total = np.maximum(counts.sum(0) + rare, 1e-9)
    scale = total.min() / total
    scaled = counts * scale
    cut = np.minimum(scaled, discount)
    weight = np.maximum(cut.sum(0) + rare * scale, 1e-9)
    p = scaled - cut + (cut.sum(1, keepdims=True) + 1e-9) / weight.sum() * weight
    return p / total.min(), weight


def kneser_ney(counts: np.ndarray, rare: np.ndarray, discount: float = DISCOUNT) -> tuple[np.ndarray, float]:
    """Log-ratio of each word's probability in the two models, and that of an unseen word."""
    p, weight = words_given_class(counts, rare, discount)
    return np.log(p[:, 1] / p[:, 0]), float(np.log(weight[1] / weight[0]))


def pairs_given_class(
    counts: np.ndarray, context: np.ndarray, totals: np.ndarray, lower: np.ndarray, discount: float = DISCOUNT
) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each pair's second word after the first in the two models, and the backoff weight of every context.

    ``counts`` (pairs x 2) are continuation counts, the numbers of different
    words before a pair, ``context`` is the number of a pair's first word among ``totals`` (contexts x 2), the sums over all second
    words, and ``lower`` (pairs x 2) the probability of the second word by
    itself. The discount is taken off every pair. As with words, what it takes
    off a pair in either class is shared by both, here in the proportion in
    which the classes have the second word by itself; pairs that no class has
    more often than the discount therefore differ as their words do, and may
    be left out. A class that never had a context backs off whole.
    """
    kept = np.maximum(counts - discount, 0)
    held = np.stack([np.bincount(context, kept[:, c], totals.shape[0]) for c in (0, 1)], 1)
    back = np.maximum(totals - held, 1e-9)
    weight = np.where(totals > 0, back / np.maximum(totals, 1e-9), 1.0)
    # A pair that the folds at hand never had is like any other unseen one: its words alone tell.
    share = np.where(counts.any(1), (counts - kept).sum(1) / back.sum(1)[context], 1.0)
    lean = lower / lower.mean(1, keepdims=True)
    return kept / np.maximum(totals, 1e-9)[context] + weight[context] * share[:, None] * lean, weight


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before) + word)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    """Values of the wanted ones of some sorted keys, or the default."""
    if not keys.size:
        return np.broadcast_to(default, wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
    return np.where(keys[at] == wanted, values[at], default)


class Model:
    """Log-ratios of words, of contexts' backoff weights, and of pairs; what is not held backs off."""

    def __init__(self, words, ratio, unseen: float, contexts=(), weights=(), pairs=(), pair_ratio=()):
        for name, keys, values in (("word", words, ratio), ("context", contexts, weights), ("pair", pairs, pair_ratio)):
            keys = np.asarray(keys, np.uint64)
            order = np.argsort(keys)
            setattr(self, name, (keys[order], np.asarray(values, float)[order]))
        self.unseen = unseen
        self.slope, self.base = 0.0, 0.0

    def each(self, ids: np.ndarray, names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-ratio of every word after the one before it."""
        if not ids.size:
            return np.empty(0)
        alone = _found(*self.word, names, self.unseen)[ids]
        word = names[ids]
        before = _before(word, bounds)
        back = np.concatenate((_found(*self.context, names, np.nan), _found(*self.context, np.zeros(1, np.uint64), np.nan)))
        weight = back[np.where(before == 0, names.size, _before(ids, bounds))]
        after = np.flatnonzero(~np.isnan(weight))
        alone[after] = _found(*self.pair, _pair_keys(before[after], word[after]), alone[after] + weight[after])
        return alone

    def means(self, texts: list[str | None]) -> np.ndarray:
        """Difference of the two log-likelihoods per word, above what the text's ordinary words have.

        The median of a text stands for its topic or language, which may be
        commoner in one class; of a word's difference from it only what
        exceeds the margin counts.
        """
        out = []
        for part in _parts(texts):
            ids, names, bounds = _words(part)
            each = self.each(ids, names, bounds)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                x = each[a:b]
                if not x.size:
                    out.append(0.0)
                    continue
                x = x - np.median(x)
                out.append(float((np.sign(x) * np.maximum(np.abs(x) - MARGIN, 0)).sum()) / (x.size + EXTRA_WORDS))
        return np.array(out, float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * self.means(texts), -40, 40)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton steps on a lightly penalised loss."""
    scale = max(float(x.std()), 1e-6)
    z, p = np.stack([x / scale, np.ones(x.size)], 1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        slope = z.T @ (weight * (q - y)) + 1e-3 * p
        bend = (z * (weight * q * (1 - q))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return p[0] / scale, p[1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | None:
    """Models from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``; None unless both classes have a text.

    At most about ``max_rows`` texts of either class are drawn by a hash of
    their id; equal texts of a class count once. Of repeated labels the larger
    mark counts, null ones are left out. Counts are made in Spark; the words
    and pairs of the sample that some class holds more often than the discount
    come to the driver, so what moves is bounded by the sample. A word after
    another one backs off to its continuation counts, these to the distribution
    that both classes share.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("toxic", (F.col("toxic") == 1).cast("int"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, max_rows / sizes[1]))).otherwise(F.lit(min(1.0, max_rows / sizes[0])))
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text").join(F.broadcast(marks.filter(place < share)), "doc_id")  # ids of the sample alone
    once = texts.groupBy("toxic", F.xxhash64("text").alias("h"), F.length("text").alias("size")).agg(F.min_by("text", "doc_id").alias("text"))
    # A part is a class within a fold: fold * 2 + class.
    fold = F.pmod(F.xxhash64(F.lit("fold"), "h"), F.lit(FOLDS)).cast("int")
    sample = keep(once.select((fold * 2 + F.col("toxic")).alias("part"), "text"), "toxicity")
    parts = range(2 * FOLDS)
    names, sums = [f"c{i}" for i in parts], [f"n{i}" for i in parts]
    # Both orders count continuations; dealt by the pair, repeats go and pairs are counted in one shuffle.
    found = sample.mapInArrow(_pairs, "part int, w bigint, v bigint, u bigint").repartition("w", "v").distinct()
    pairs = keep(found.groupBy("w", "v").agg(*[F.count_if(F.col("part") == i).alias(c) for i, c in enumerate(sums)]), "toxicity-pairs")
    counts = keep(pairs.groupBy("w").agg(*[F.count_if(F.col(n) > 0).alias(c) for n, c in zip(sums, names, strict=True)]), "toxicity-words")
    # Counts of either class are scaled to the smaller one, for each set of folds that is learned from.
    sets = [np.arange(FOLDS) != f for f in range(FOLDS)] + [np.arange(FOLDS) >= 0]
    size = np.array(pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first(), float).reshape(FOLDS, 2)
    scales = [size[s].sum(0).min() / np.maximum(size[s].sum(0), 1) for s in sets]
    most = np.max(scales, 0)
    class_sum = lambda columns, side: sum((F.col(c) for c in columns[side::2]), F.lit(0))
    pair_often = F.greatest(*[class_sum(sums, side) * F.lit(float(most[side])) for side in (0, 1)]) > DISCOUNT
    known_pairs = keep(pairs.filter(pair_often), "toxicity-often")
    contexts = pairs.join(known_pairs.select("v").distinct(), "v", "left_semi").groupBy("v").agg(*[F.sum(c).alias(c) for c in sums]).toArrow()
    often = F.greatest(*[class_sum(names, side) for side in (0, 1)]) > DISCOUNT
    marked = counts.join(known_pairs.select("w", F.lit(True).alias("paired")).distinct(), "w", "left")
    marked = marked.select("w", *names, (often | F.coalesce("paired", F.lit(False))).alias("often"))
    rest = marked.filter("not often").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    known, linked = marked.filter("often").toArrow(), known_pairs.toArrow()

    def numbers(rows: pa.Table, columns: list[str]) -> np.ndarray:
        return np.stack([rows.column(c).to_numpy() for c in columns], 1).astype(float).reshape(-1, FOLDS, 2)

    hashes_of = lambda rows, c: rows.column(c).to_numpy().astype(np.int64).view(np.uint64)
    words, each = hashes_of(known, "w"), numbers(known, names)
    heads, head_sums = hashes_of(contexts, "v"), numbers(contexts, sums)
    second, first, pair_sums = hashes_of(linked, "w"), hashes_of(linked, "v"), numbers(linked, sums)
    by_word, by_head = np.argsort(words), np.argsort(heads)
    word_at = by_word[np.searchsorted(words, second, sorter=by_word)]
    head_at = by_head[np.searchsorted(heads, first, sorter=by_head)]
    keys = _pair_keys(first, second)
    rare = np.array(rest, float).reshape(FOLDS, 2)
    if not (each.sum((0, 1)) + rare.sum(0)).all():
        return None

    def learn(s: int) -> Model:
        folds, scale = sets[s], scales[s]
        p, weight = words_given_class(each[:, folds].sum(1), rare[folds].sum(0))
        ratio, unseen = np.log(p[:, 1] / p[:, 0]), float(np.log(weight[1] / weight[0]))
        tells = np.abs(ratio - unseen) > 1e-12
        after, back = pairs_given_class(pair_sums[:, folds].sum(1) * scale, head_at, head_sums[:, folds].sum(1) * scale, p[word_at])
        return Model(words[tells], ratio[tells], unseen, heads, np.log(back[:, 1] / back[:, 0]), keys, np.log(after[:, 1] / after[:, 0]))

    others = [learn(f) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, texts = batch.column("part").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            x = np.zeros(part.size)
            for f, model in enumerate(others):
                at = np.flatnonzero(part // 2 == f)
                x[at] = model.means([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(part % 2, pa.int32()), pa.array(x, pa.float64())], ["toxic", "x"])

    rows = sample.mapInArrow(measure, "toxic int, x double").toArrow()
    y, x = rows.column("toxic").to_numpy().astype(float), rows.column("x").to_numpy().astype(float)
    order = np.lexsort((x, y))
    weight = np.where(y == 1, max(1.0, sizes[1] / max_rows), max(1.0, sizes[0] / max_rows))
    slope, base = calibrate(x[order], y[order], weight[order])
    model = learn(FOLDS)
    model.slope, model.base = max(float(slope), 1e-6), float(base)
    return model


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    Whole texts are scored, null ones as empty. An empty text and one without
    words get what a text without telling words gets. Without a model every
    score is 0. Repeated rows score alike.
    """
    rest = docs.drop("score", "predicted")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            score = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(predict, f"{kinds}, score double, predicted int")


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


@query("op12_toxicity")
def op12_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out(F.col("doc_id")).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(~_held_out(F.col("doc_id")))
    return score_toxicity(docs, fit(docs.filter("not held_out"), labels)).drop("text")
