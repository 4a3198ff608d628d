"""Ranked, filtered text search over a table of queries, and result merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import computed
from ..session import cut, spread
from .match import top_n

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def numbered(queries: DataFrame, query: str, own: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Distinct queries with a number ``_q``, and the terms of each number."""
    asked = cut(queries.select(query, *own).distinct().withColumn("_q", F.monotonically_increasing_id()))
    return asked, asked.select("_q", F.explode(F.array_distinct(tokens(F.col(query)))).alias("term"))


def weigh(tf: DataFrame, terms: DataFrame, stats: Column, doc: str, carry: Sequence[str] = ()) -> DataFrame:
    """BM25 scores ``_q``, document, ``carry``, ``score`` from term counts of documents.

    Counts are dealt by document, so a word that every document holds makes no
    task larger than another, and a document's sums need no further shuffle.
    """
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = cut(terms.join(df, "term").withColumn("s", stats).withColumn(
        "idf", F.log(1 + (F.col("s.docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    ).select("_q", "term", "idf", F.col("s.avg_len").alias("avg_len")))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    return spread(tf, doc).join(weighted, "term").groupBy("_q", doc, *carry).agg(F.round(F.sum(part), 6).alias("score"))


def _scored(terms: DataFrame, docs: DataFrame, text: str, doc: str, carry: Sequence[str]) -> DataFrame:
    """Scores of the numbered queries over whole texts."""
    mark = F.lit("")
    vocabulary = terms.select("term").unionByName(terms.sparkSession.range(1).select(mark.alias("term"))).distinct()
    dealt = spread(docs.select(doc, text, *carry), doc)
    base = computed(dealt, _t=tokens(F.col(text))).select(doc, *carry, "_t", F.size("_t").alias("len"))
    counts = cut(
        base.select(doc, "len", *carry, F.explode(F.concat("_t", F.array(mark))).alias("term"))
        .join(vocabulary, "term", "left_semi")
        .groupBy(doc, "len", *carry, "term")
        .agg(F.count("*").alias("tf"))
    )
    marks, tf = counts.filter("term = ''"), counts.filter("term <> ''")
    stats = marks.agg(F.struct(F.sum("tf").alias("docs"), (F.sum(F.col("len") * F.col("tf")) / F.sum("tf")).alias("avg_len")).alias("s")).scalar()
    return weigh(tf, terms, stats, doc, carry)


def front(scored: DataFrame, asked: DataFrame, n: int, doc: str, keep: Column | None = None, query: str = "query",
          either: bool = False) -> DataFrame:
    """The ``n`` best rows of every numbered query, with the query; ``either`` gives those that ``keep`` holds for and those it does not."""
    order = [F.col("score").desc(), F.col(doc)]
    if keep is None:
        return top_n(scored, ["_q"], order, n, "_rank").drop("_rank").join(asked, "_q").drop("_q")
    rows = scored.join(asked.drop(query), "_q").withColumn("_kept", F.coalesce(keep, F.lit(False)))
    rows = rows if either else rows.filter("_kept")
    best = top_n(rows, ["_q", "_kept"], order, n, "_rank").drop("_rank", "_kept")
    return best.join(asked.select("_q", query), "_q").drop("_q")


def text_scores(queries: DataFrame, docs: DataFrame, query: str = "query", text: str = "text", doc: str = "doc_id",
                carry: Sequence[str] = (), own: Sequence[str] = (), n: int | None = None, keep: Column | None = None) -> DataFrame:
    """BM25 scores over whole texts: ``query``, ``own``, the document id, ``carry`` and score of every hit.

    With ``n`` only rows that ``best_hits`` may need come out: the ``n`` best
    of every query, and with ``keep`` also the ``n`` best of those it holds for.

    Documents are dealt by their id, read and their words taken once: the words
    meet the query vocabulary before they are counted, so only words somebody
    asked for move on, and one mark per document that carries its length. These
    term counts are written; statistics, document frequencies and scores come
    from them. Queries are numbered, and only numbers go through the joins.
    """
    asked, terms = numbered(queries, query, own)
    scored = _scored(terms, docs, text, doc, carry)
    return scored.join(asked, "_q").drop("_q") if n is None else front(scored, asked, n, doc, keep, query, True)


def text_search(queries: DataFrame, docs: DataFrame, n: int = 10, query: str = "query", text: str = "text",
                doc: str = "doc_id", keep: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Best ``n`` documents per query: columns of ``queries``, the document id, score and rank.

    ``keep`` is a condition on pairs, over columns of the two sides; the
    document side offers those named in ``carry``. Statistics are those of all
    documents. Equal queries are scored once unless a condition tells them
    apart.
    """
    own = [c for c in queries.columns if keep is not None and c != query]
    return best_hits(queries, text_scores(queries, docs, query, text, doc, carry, own, n, keep), n, query, doc, keep, own)


def best_hits(queries: DataFrame, scores: DataFrame, n: int = 10, query: str = "query", doc: str = "doc_id",
              keep: Column | None = None, own: Sequence[str] = ()) -> DataFrame:
    """The cut of ``text_search`` over scores that are there already."""
    hits = scores if keep is None else scores.filter(keep)
    best = top_n(hits, [query, *own], [F.col("score").desc(), F.col(doc)], n)
    return queries.join(best.select(query, *own, doc, "score", "rank"), [query, *own])


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, key: str) -> DataFrame:
    """Filtered hits; queries without any take the unfiltered ones. Adds ``fell_back``."""
    missing = unfiltered.join(filtered.select(key).distinct(), key, "left_anti")
    return filtered.withColumn("fell_back", F.lit(False)).unionByName(missing.withColumn("fell_back", F.lit(True)))


def excluding_type(hits: DataFrame, key: str, doc_type: str = "doc_type", excluded: str = "scanned_document") -> DataFrame:
    """Hits without one type, or all hits of a query that has no others."""
    wanted = hits.filter(~F.col(doc_type).eqNullSafe(F.lit(excluded)))
    return with_fallback(wanted, hits, key)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order; drops the others before the shuffle."""
    return top_n(df, keys, [c if isinstance(c, Column) else F.col(c) for c in order], 1, "_one").drop("_one")


def priority_union(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union that keeps a key's row from the earliest part; adds ``priority``."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return first_per(out, keys, ["priority", *order])


def two_pass(first: DataFrame, second: DataFrame, keys: Sequence[str], rank: str = "rank") -> DataFrame:
    """First-pass results, then the second pass's new documents, in rank order."""
    merged = priority_union([first, second], keys, [rank])
    group = [k for k in keys if k == keys[0]]
    return merged.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy("priority", rank, *keys)))


def path_overlap(a: DataFrame, b: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Per key: paths in both sides, only in ``a``, only in ``b``."""
    left = a.select(key, path).distinct().withColumn("_a", F.lit(1))
    right = b.select(key, path).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, [key, path], "full_outer")
    return both.groupBy(key).agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("overlap"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
    )


def common_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def missed_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
