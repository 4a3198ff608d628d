"""Text quality by positive-unlabelled learning."""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix, spans, word_hashes
from ._registry import query, table

#: Bounds of the sample that the model is fitted on, for positives and for unlabelled texts.
MAX_ROWS = 20000
THRESHOLD = 0.3
HIDDEN = 24
EPOCHS = 60
_CLASSES = ("upper", "lower", "digit", "space", "line", "bang", "bar", "stop", "mark", "other_sign", "high")


def _byte_classes() -> np.ndarray:
    out = np.full(256, _CLASSES.index("other_sign"), np.uint8)
    for name, chars in {
        "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 11, 12, 13, 32), "line": (10,),
        "bang": b"!", "bar": b"|", "stop": b".,;:?", "mark": b"#$%&*@^~<>{}[]=+_\\/", "high": range(128, 256),
    }.items():
        out[list(chars)] = _CLASSES.index(name)
    return out


_CLASS = _byte_classes()
_UPPER, _STOP = _CLASSES.index("upper"), _CLASSES.index("stop")
_SIGNS = np.array([_CLASSES.index(c) for c in ("bang", "bar", "mark", "other_sign")])
#: Words are looked at in blocks of this many, so that junk inside a long text shows.
BLOCK = 64
N_FEATURES = len(_CLASSES) + 16


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of character classes, repetition of words, capitals and signs at word ends."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    raw = np.frombuffer(data := text.encode("utf-8", "replace"), np.uint8)
    classes = _CLASS[raw]
    out[: len(_CLASSES)] = np.bincount(classes, minlength=len(_CLASSES)) / raw.size
    starts, ends = spans(raw)
    n = starts.size
    if not n:
        return out
    sizes, words = ends - starts, word_hashes(data)
    last, first = classes[ends - 1], classes[starts]
    cased = np.add.reduceat((classes == _UPPER).astype(np.int32), starts) if n else np.zeros(0)
    sign_end, stop_end, capital = np.isin(last, _SIGNS), last == _STOP, first == _UPPER
    shout = (cased >= np.maximum(2, 0.6 * sizes)).astype(float)
    same = np.zeros(n)
    same[1:] = words[1:] == words[:-1]
    alone = ((sizes == 1) & np.isin(first, _SIGNS)).astype(float)
    order = np.sort(words)
    distinct = 1 + np.count_nonzero(np.diff(order))
    runs = np.diff(np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True]))))
    at = np.arange(0, n, BLOCK)
    width = np.diff(np.append(at, n))
    per_block = [np.add.reduceat(x, at) / width for x in (sign_end.astype(float), shout, same, alone)]
    out[len(_CLASSES) :] = [
        np.log1p(n) / 10, sizes.mean() / 10, sizes.std() / 10, sign_end.mean(), stop_end.mean(), capital.mean(),
        shout.mean(), same.mean(), alone.mean(), distinct / n, runs.max() / n, *(b.max() for b in per_block),
        (per_block[0] + per_block[1] + per_block[2] + per_block[3] > 0.25).mean(),
    ]
    return out


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both.

    Above a threshold the unlabelled hold at least prior times the positives'
    share, so the smallest ratio of the two shares bounds the prior. Only
    thresholds passed by half of the positives count; higher ones leave few
    rows, and the smallest of many noisy ratios would be too small.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 25))
    ratios = [(unlabelled >= c).mean() / max((positive >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratios), 0.05, 0.95))


class Net:
    """Logits of a small two-layer network, trained with Adam."""

    def __init__(self, dim: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, dim**-0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t, self.rng = [0 * p for p in self.p], [0 * p for p in self.p], 0, rng

    def logits(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def step(self, x, slope, rate=0.01):
        """``slope``: derivative of the loss by the logit of each row."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ slope + 1e-4 * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_net(pos: np.ndarray, unl: np.ndarray, prior: float | None) -> Net:
    """Minimise the non-negative unbiased risk; without a prior, tell positives from unlabelled.

    Risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)), logistic loss. When
    the second term is negative on a batch, the step goes up its gradient.
    """
    net = Net(pos.shape[1])
    size = 512
    steps = max(1, max(len(pos), len(unl)) // size)
    for _ in range(EPOCHS if prior is not None else EPOCHS // 3):
        for _ in range(steps):
            a = pos[net.rng.integers(0, len(pos), size)]
            b = unl[net.rng.integers(0, len(unl), size)]
            sa, sb = sigmoid(net.logits(a)), sigmoid(net.logits(b))
            if prior is None:
                slopes = (sa - 1) / size, sb / size
            else:
                negative = -np.log1p(-np.minimum(sb, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sa, 1 - 1e-12)).mean()
                if negative >= 0:
                    slopes = prior * (sa - 1) / size - prior * sa / size, sb / size
                else:
                    slopes = prior * sa / size, -sb / size
            net.step(np.concatenate([a, b]), np.concatenate(slopes), 0.003)
    return net


def _with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """A model from trusted positives (``labels.quality`` = 1) and the texts without a label.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality``. Labelled
    negatives are not used. At most about ``max_rows`` rows of either kind are
    drawn by a hash of their id, and only their 27 features come to the driver.
    None when either kind is empty.
    """
    docs, labels = docs.filter("doc_id is not null").select("doc_id", "text"), labels.filter("doc_id is not null")
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce("quality", F.lit(0))).alias("quality"))
    n_docs, n_pos = docs.count(), marks.filter("quality = 1").count()
    if not n_docs or not n_pos:
        return None
    place = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    part_pos, part_unl = min(1.0, max_rows / n_pos), min(1.0, max_rows / max(1, n_docs - marks.count()))
    drawn = docs.filter(place < max(part_pos, part_unl)).mapInArrow(_with_features, "doc_id long, x array<double>")
    rows = (
        drawn.join(marks, "doc_id", "left")
        .filter(((F.col("quality") == 1) & (place < part_pos)) | (F.col("quality").isNull() & (place < part_unl)))
        .select("doc_id", F.col("quality").isNotNull().alias("pos"), "x").toArrow()
    )
    ids = mix(rows.column("doc_id").to_numpy().astype(np.int64).view(np.uint64))
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    is_pos = np.array(rows.column("pos").to_pylist(), bool)
    order = np.lexsort((x.sum(1), ids))
    x, is_pos = x[order], is_pos[order]
    if not is_pos.any() or is_pos.all():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - mean) / scale, -6, 6)
    pos, unl = z[is_pos], z[~is_pos]
    rough = train_net(pos[::2], unl[::2], None)
    # With the other halves, so that the ratio is not fitted on its own rows.
    prior = estimated_prior(rough.logits(pos[1::2] if len(pos) > 1 else pos), rough.logits(unl[1::2] if len(unl) > 1 else unl))
    net = train_net(pos, unl, prior)
    return {"mean": mean, "scale": scale, "net": net.p, "prior": prior}


def score_quality(docs: DataFrame, model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced.

    Whole texts are scored, null ones as empty. Empty texts and texts without
    a word score 0. Without a model every score is the middle, 0.5. Repeated
    rows score alike.
    """
    rest = docs.drop("score", "predicted")
    weights = model

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if weights:
            net = Net(N_FEATURES)
            net.p = weights["net"]
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, N_FEATURES)
            if weights:
                z = np.clip((x - weights["mean"]) / weights["scale"], -6, 6)
                score = np.where(x[:, len(_CLASSES)] > 0, sigmoid(net.logits(z)), 0.0)
            else:
                score = np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))],
                [*batch.schema.names, "score", "predicted"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(predict, f"{kinds}, score double, predicted int")


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def learn_from_tables(spark, sf_dir, docs: DataFrame):
    """The production model: labels of the rows that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~_held_out(F.col("doc_id")))
    return fit(docs.filter(~_held_out(F.col("doc_id"))), labels)


@query("op3_quality")
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn_from_tables(spark, sf_dir, docs)
    return score_quality(docs.withColumn("held_out", _held_out(F.col("doc_id"))), model).drop("text")
