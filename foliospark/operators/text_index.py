"""A stored inverted index for ranked search, kept up to date by deltas.

Each update writes a segment: postings (term, document, frequency) in folders
by a hash of the term, one row per document with its length, and the ids that
went away. A commit makes the three visible together. A document counts in
the newest segment that names it, so an update reads nothing but its own
documents, and a search reads the folders of its terms and the lengths, never
a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import computed
from ..plans import commits
from ..plans.warehouse import read_table
from ..session import cut, spread
from .search import best_hits, front, numbered, tokens, weigh

#: Folders the terms are dealt to.
BUCKETS = 64


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index below ``root``; ``doc`` names the id and ``carry`` the columns that searches may filter on."""

    def __init__(self, spark: SparkSession, root: str, doc: str = "doc_id", text: str = "text", carry: Sequence[str] = ()):
        self.spark, self.root, self.doc, self.text, self.carry = spark, root, doc, text, tuple(carry)

    # -- updates

    def update(self, docs: DataFrame | None = None, gone: DataFrame | None = None, source: str = "update", batch: str | None = None) -> int:
        """Add or replace ``docs`` and drop the ids in ``gone``; the number of the commit.

        A batch that is committed already is not written again. An id in both
        is added. A null text counts as empty; of repeated ids in one update
        the largest text stays; rows without an id are left out.
        """
        batch = uuid.uuid4().hex if batch is None else batch
        load = commits.load_id(source, batch)
        if not commits.committed(self.spark, self.root, load):
            if docs is not None:
                kept = docs.filter(F.col(self.doc).isNotNull()).select(self.doc, F.coalesce(self.text, F.lit("")).alias("_text"), *self.carry)
                again = cut(kept.groupBy(self.doc).agg(F.count("*").alias("n")).filter("n > 1").select(self.doc))
                if not again.isEmpty():
                    most = kept.join(again, self.doc, "left_semi").groupBy(self.doc).agg(F.max(F.struct("_text", *self.carry)).alias("r"))
                    kept = kept.join(again, self.doc, "left_anti").unionByName(most.select(self.doc, "r.*"))
                base = computed(spread(kept, self.doc), _t=tokens(F.col("_text")))
                words = base.select(self.doc, F.explode("_t").alias("term"))
                postings = words.withColumn("bucket", _bucket("term")).groupBy("bucket", "term", self.doc).agg(F.count("*").cast("int").alias("tf"))
                lengths = base.select(self.doc, F.size("_t").alias("len"), *self.carry)
                with ThreadPoolExecutor(2) as pool:
                    for done in [pool.submit(self._write_postings, postings, load), pool.submit(self._write, lengths, "lengths", load)]:
                        done.result()
            if gone is not None:
                ids = gone.filter(F.col(self.doc).isNotNull()).select(self.doc).distinct()
                self._write(ids if docs is None else ids.join(docs.select(self.doc), self.doc, "left_anti"), "gone", load)
        return commits.commit(self.spark, self.root, load, source, batch)

    def _write(self, rows: DataFrame, name: str, load: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/load={load}")

    def _write_postings(self, rows: DataFrame, load: str) -> None:
        dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", self.doc)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.root}/postings/load={load}")

    def merge(self) -> None:
        """Write the live rows as one segment that stands for all older ones; updates that commit meanwhile stay."""
        upto = commits.last(self.spark, self.root)
        live = self._live(upto)
        if live is None:
            return
        live = cut(live)
        batch = uuid.uuid4().hex
        load = commits.load_id("merge", batch)
        self._write(live.drop("load", "ord"), "lengths", load)
        postings = self._postings(upto)
        if postings is not None:
            self._write_postings(postings.join(live.select(self.doc, "load"), [self.doc, "load"], "left_semi").drop("load"), load)
        commits.commit(self.spark, self.root, load, "merge", batch, upto, [])

    # -- what a search reads

    def _loads(self, upto: int | None) -> DataFrame:
        """Visible segments: those behind the newest merge, and the merge itself."""
        log = commits.log(self.spark, self.root, upto)
        merged = log.filter("base is not null").agg(F.max(F.struct("base", "load"))).first()[0]
        if merged is not None:
            log = log.filter((F.col("load") == merged["load"]) | ((F.col("ord") > merged["base"]) & F.col("base").isNull()))
        return log.select("load", "ord")

    def _table(self, name: str, upto: int | None) -> DataFrame | None:
        rows = read_table(self.spark, f"{self.root}/{name}")
        return None if rows is None else rows.join(self._loads(upto), "load")

    def _postings(self, upto: int | None) -> DataFrame | None:
        rows = self._table("postings", upto)
        return None if rows is None else rows.drop("ord")

    def _live(self, upto: int | None = None) -> DataFrame | None:
        """One row per document that counts: id, ``len``, ``carry``, and the segment it is in."""
        added, gone = self._table("lengths", upto), self._table("gone", upto)
        if added is None:
            return None
        marks = added.select(self.doc, "ord", F.lit(1).alias("there"))
        if gone is not None:
            marks = marks.unionByName(gone.select(self.doc, "ord", F.lit(0).alias("there")))
        newest = marks.groupBy(self.doc).agg(F.max(F.struct("ord", "there")).alias("m")).filter("m.there = 1")
        return added.join(newest.select(self.doc, F.col("m.ord").alias("ord")), [self.doc, "ord"])

    def scores(self, queries: DataFrame, query: str = "query", own: Sequence[str] = (), n: int | None = None,
               keep: Column | None = None) -> DataFrame:
        """BM25 scores like ``search.text_scores``: ``query``, ``own``, the id, ``carry`` and score of every hit."""
        asked, terms = numbered(queries, query, own)
        terms = cut(terms.withColumn("bucket", _bucket("term")))
        upto = commits.last(self.spark, self.root)
        live, postings = self._live(upto), self._postings(upto)
        if live is None or postings is None:
            none = asked.filter("false").withColumn(self.doc, F.lit(None)).withColumn("score", F.lit(0.0))
            return none.drop("_q").select("*", *[F.lit(None).alias(c) for c in self.carry])
        live = cut(live)
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most BUCKETS
        wanted = postings.filter(F.col("bucket").isin(buckets)).join(terms.select("term", "bucket").distinct(), ["term", "bucket"], "left_semi")
        tf = cut(wanted.join(live.drop("ord"), [self.doc, "load"]).drop("load", "bucket"))
        stats = live.agg(F.struct(F.count("*").alias("docs"), (F.sum("len") / F.count("*")).alias("avg_len")).alias("s")).scalar()
        scored = weigh(tf, terms.drop("bucket"), stats, self.doc, self.carry)
        return scored.join(asked, "_q").drop("_q") if n is None else front(scored, asked, n, self.doc, keep, query, True)

    def search(self, queries: DataFrame, n: int = 10, query: str = "query", keep: Column | None = None) -> DataFrame:
        """Best ``n`` documents per query, like ``search.text_search`` over the texts that were indexed."""
        own = [c for c in queries.columns if keep is not None and c != query]
        return best_hits(queries, self.scores(queries, query, own, n, keep), n, query, self.doc, keep, own)
