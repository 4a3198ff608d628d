"""Phrases, toxicity and clusters against plain Python on small tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from foliospark.llm import op11_phrases as phrases
from foliospark.llm import op12_toxicity as toxicity
from foliospark.llm import op13_ns_clusters as clusters
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, n string, k string, key string, score string, shard string"


def docs_of(spark, rows):
    """Rows ``(doc_id, text, lang)`` with columns that clash with names inside the operators."""
    return spark.createDataFrame([(*r, "n", "k", "y", "s", "h") for r in rows], DOC)


# ---- phrases


def brute_phrases(rows, least, top):
    counts, total = Counter(), Counter()
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    kept = {p: n for p, n in counts.items() if n >= least}
    out = []
    for (lang, w), a in kept.items():
        if len(w) == 1:
            continue
        score, _, left, right = min(
            (2_000_000 * a // (kept[lang, w[:i]] + kept[lang, w[i:]]), i, kept[lang, w[:i]], kept[lang, w[i:]]) for i in range(1, len(w))
        )
        inside = any(
            m == lang and len(v) > len(w) and 100 * n >= 80 * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
            for (m, v), n in kept.items()
        )
        if not inside:
            out.append((lang, " ".join(w), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine[:top], 1)]
    return sorted(ranked)


def found_phrases(spark, rows, least, top):
    got = phrases.collocations(docs_of(spark, rows), least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def test_phrases_equal_a_plain_count(spark):
    rng = random.Random(3)
    words = ["The", "é", "Zoë", "of", "a\xa0b", "q", "xyz", "-", "É"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ", ", ".", "\n", "\x0b", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for i in range(150)]
    rows += [(7, "same line of text here", "en")] * 40 + [(None, "same line of text", None)] * 9 + [(8, None, "en"), (9, "", None), (10, " \t\n", "de")]
    for least, top in ((5, 2000), (30, 3)):
        assert found_phrases(spark, rows, least, top) == brute_phrases(rows, least, top)


def test_phrases_of_one_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FLUSH_BYTES", 2000)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3000)
    rng = random.Random(4)
    text = " ".join(rng.choice("abcdefg") for _ in range(200_000))
    rows = [(1, text, "x"), (2, text[:5000], "y"), (3, "a" * 200_000 + " b", "x")]
    assert found_phrases(spark, rows, 30, 50) == brute_phrases(rows, 30, 50)


def test_phrases_survive_full_filters_and_equal_keys(spark, monkeypatch):
    """Filters that say yes to everything, and keys that collide, change nothing."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["p", "q", "r", "s"]) for _ in range(40)), "en") for i in range(30)]
    want = brute_phrases(rows, 8, 100)
    monkeypatch.setattr(phrases, "MOST_BITS", 10)
    assert found_phrases(spark, rows, 8, 100) == want
    grams = phrases.Grams(b"p q p q", "en")
    grams.hash = np.zeros(4, np.uint64)
    assert len(set(grams.keys(1, np.arange(4)).tolist())) == 1
    real = phrases.Grams.__init__

    def blind(self, data, lang):
        real(self, data, lang)
        self.hash = self.hash & np.uint64(1)

    monkeypatch.setattr(phrases.Grams, "__init__", blind)
    batch = docs_of(spark, rows).select("lang", F.lit(0).alias("shard"), F.col("text").cast("binary").alias("body"))
    spelt = phrases._spell(batch, phrases.Filter(10, np.full(16, ~np.uint64(0))))
    plain = Counter()
    for _, text, lang in rows:
        w = text.split()
        for k in range(1, 5):
            plain.update((lang, k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    # The tasks of this session run in other processes, where nothing is blinded; the counts are exact either way.
    assert {(r["lang"], r["k"], r["phrase"]): r["n"] for r in spelt.collect()} == plain


def test_phrase_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    sql = f"(CAST(2000000 AS DECIMAL(7,0)) * CAST({big} AS DECIMAL(20,0))) DIV (CAST({big} AS DECIMAL(20,0)) + CAST({big + 1} AS DECIMAL(20,0)))"
    assert spark.sql(f"SELECT {sql} AS s").first()["s"] == 2_000_000 * big // (2 * big + 1)


def test_phrases_of_no_rows(spark):
    assert found_phrases(spark, [], 30, 10) == []


# ---- toxicity


def test_kneser_ney_by_hand():
    ordinary, toxic = [10.0, 1.0, 0.0], [1.0, 0.0, 9.0]
    ratio, unseen = toxicity.kneser_ney(np.array([ordinary, toxic]).T, np.array([4.0, 2.0]), 2.0)
    scale = 12 / 15
    c = [[x * scale for x in ordinary], toxic]
    cut = [[min(x, 2.0) for x in side] for side in c]
    weight = [sum(cut[0]) + 4 * scale, sum(cut[1]) + 2]
    for i in range(3):
        p = [c[s][i] - cut[s][i] + weight[s] * (cut[0][i] + cut[1][i]) / sum(weight) for s in (0, 1)]
        assert ratio[i] == pytest.approx(np.log(p[1] / p[0]), abs=1e-6)
    assert unseen == pytest.approx(np.log(weight[1] / weight[0]))


def test_pairs_back_off_to_what_the_classes_share():
    """By hand: context 0 holds pair 0 9 times in toxic texts and once in ordinary ones, pair 1 once in either, and rare ones 2 and 4 times."""
    lower = np.array([[0.1, 0.1], [0.1, 0.3]])
    p, weight = toxicity.pairs_given_class(np.array([[1.0, 9.0], [1.0, 1.0]]), np.array([0, 0]), np.array([[6.0, 12.0]]), lower, 2.0)
    assert weight.tolist() == [[1.0, pytest.approx(5 / 12)]]
    share = 3 / 11  # cut off pair 0: 1 and 2 of 6 and 5
    assert p[0] == pytest.approx([share, 7 / 12 + 5 / 12 * share])
    # No class holds pair 1 more often than the discount: the ratio is that of backoff weight and words.
    assert p[1, 1] / p[1, 0] == pytest.approx(5 / 12 * 3)


def test_the_word_before_tells(spark):
    """Both classes have the same words after as many different ones; only which follows which differs."""
    rng = np.random.default_rng(5)
    filler = lambda n: " ".join(f"f{i}" for i in rng.integers(0, 300, n))
    a, b = ["rotten", "kind"], ["egg", "hat"]
    rows = []
    for i in range(300):
        toxic = i % 2
        said = [f"{a[k]} {b[k if toxic else 1 - k]} {filler(3)}" for k in (0, 1) for _ in range(3)]
        rows.append((i, f"{filler(6)} {' '.join(said)}", toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, m) for i, _, m in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs.filter("doc_id < 200"), labels.filter("doc_id < 200"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs.filter("doc_id >= 200"), model).collect()}
    assert sum(got[i] == m for i, _, m in rows if i >= 200) >= 95


@pytest.fixture(scope="module")
def toxic_table(spark):
    rng = random.Random(6)
    plain, bad = [f"w{i}" for i in range(300)], ["grubby", "vile", "nasty"]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 9 == 0
        for _ in range(len(words) // 30 + 1 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "!", ",", "###"]))
        rows.append((i, " ".join(words), rng.choice(["en", None])))
        marks.append((i, int(toxic)))
    marks += [(3, 0), (3, None), (None, 1), (5000, 1)]
    return docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int"), rows, marks


def test_toxic_documents_are_told_apart(spark, toxic_table):
    docs, labels, rows, marks = toxic_table
    model = toxicity.fit(docs.filter("doc_id < 700"), labels.filter("doc_id < 700"))
    got = toxicity.score_toxicity(docs.filter("doc_id >= 700"), model)
    assert got.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"]
    want = dict(marks[:900])
    hits = [(r["predicted"], want[r["doc_id"]]) for r in got.collect()]
    assert sum(p == y for p, y in hits) >= 0.98 * len(hits)
    again = toxicity.fit(docs.repartition(7).filter("doc_id < 700"), labels.filter("doc_id < 700"))
    assert {r["doc_id"]: r["score"] for r in got.collect()} == pytest.approx(
        {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.filter("doc_id >= 700"), again).collect()}
    )


def test_toxicity_of_odd_texts(spark, toxic_table):
    docs, labels, _, _ = toxic_table
    model = toxicity.fit(docs, labels)
    odd = [(1, None, None), (2, "", None), (3, " \n", "en"), (4, "!!! ... \x00", None), (5, "vile " * 300_000, None), (6, "w1 " * 700_000, None), (6, "w1 " * 700_000, None), (None, "vile, nasty grubby", None)]
    got = sorted(toxicity.score_toxicity(docs_of(spark, odd), model).select("doc_id", "score", "predicted").collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert got[0]["score"] == got[1]["score"] == got[2]["score"] < 0.5
    assert got[5]["score"] == got[6]["score"] < 0.5


def test_toxicity_without_both_classes(spark, toxic_table):
    docs, labels, _, _ = toxic_table
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None and toxicity.fit(docs.limit(0), labels) is None
    assert {tuple(r) for r in toxicity.score_toxicity(docs, None).select("score", "predicted").distinct().collect()} == {(0.0, 0)}
    assert toxicity.score_toxicity(docs.limit(0), None).count() == 0


def test_toxicity_sample_is_bounded(spark, toxic_table):
    docs, labels, _, marks = toxic_table
    model = toxicity.fit(docs, labels, max_rows=60)
    want = dict(marks[:900])
    hits = [(r["predicted"], want[r["doc_id"]]) for r in toxicity.score_toxicity(docs, model).collect()]
    assert sum(p == y for p, y in hits) >= 0.95 * len(hits)


# ---- clusters


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return c, sorted(((i, j, d) for (i, _), (d, j) in zip(kept, assign(), strict=True)), key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("kind", ["spread", "grid", "copies"])
def test_clusters_equal_all_distances(spark, kind, monkeypatch):
    rng = np.random.default_rng(8)
    if kind == "spread":
        x = rng.normal(0, 0.4, (300, 6)) + rng.integers(0, 4, (300, 1))
    elif kind == "grid":  # many equal distances
        x = rng.integers(-1, 2, (300, 6)) / 4
    else:
        x = np.concatenate([np.full((200, 6), 0.5), rng.normal(0, 1, (50, 6))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (900, None), (901, [1.0]), (902, [None] * 6), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5)]
    rows = [(i, v if v is None else [None if a is None else float(np.float32(a)) for a in v]) for i, v in rows]
    got, c, scans = clusters.cluster(vectors_of(spark, rows), 12, 5, 6)
    want_c, want = brute_clusters(rows, 12, 5, 6)
    assert [list(map(int, m)) for m in c] == want_c
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert scans > 0


def test_bounds_save_distances_and_stay_right():
    rng = np.random.default_rng(9)
    x = rng.integers(-2000, 2000, (40, 8))[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 8))
    history = [x[rng.choice(3000, 24, replace=False)]]
    groups = clusters.grouped(history[0])
    assert sorted(np.concatenate(groups).tolist()) == list(range(24))
    b = clusters.Bounds(x, len(groups))
    for t in range(8):
        b.assign(history, groups)
        assert (b.own == clusters.squared(x, history[-1]).argmin(1)).all()
        s, n = b.sums(24)
        history.append(np.array([s[j] // n[j] if n[j] else history[-1][j] for j in range(24)]))
    assert b.scans < 0.5 * 8 * 3000 * 24


def test_squared_is_exact_for_large_values():
    x = np.array([[clusters.LIMIT, -clusters.LIMIT], [3, 4]])
    c = np.array([[-clusters.LIMIT, clusters.LIMIT], [0, 0]])
    assert clusters.squared(x, c).tolist() == [[2 * (2 * clusters.LIMIT) ** 2, 2 * clusters.LIMIT**2], [(clusters.LIMIT + 3) ** 2 + (clusters.LIMIT - 4) ** 2, 25]]


def test_clusters_of_few_and_huge_vectors(spark):
    got, c, _ = clusters.cluster(vectors_of(spark, []), 4, 2, 3)
    assert got.count() == 0 and len(c) == 0
    got, c, _ = clusters.cluster(vectors_of(spark, [(1, [3.0e38, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])]), 4, 2, 3)
    assert len(c) == 2 and {r["distance"] for r in got.collect()} == {0}
    full = clusters.with_inertia(got, c)
    assert {r["inertia"] for r in full.collect()} == {0}
