"""Mix sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._registry import keep, query, table, word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3.0
SEED = "mix-1"
#: Each level of the cut search deals the ranks of a source over this many bins.
BINS = 4096
#: Equal rows without an id that one task numbers at a time.
CHUNK = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES) -> DataFrame:
    """``(source, source_size, weight, target)`` from one row per source ``(source, source_size)``.

    The sources share the whole size by weight. A share above ``max_copies``
    times its source stops there and the excess is shared again by weight
    among the rest. With sources in ascending order of ``source_size /
    weight`` those that stop are a prefix: the source at a place stops if the
    rate that is left for it and all later ones reaches its limit. One row per
    source, so the windows run over a few names and never over documents.
    """
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("weight", weight).withColumn("limit", F.lit(max_copies) * F.col("source_size"))
    whole = Window.partitionBy(F.lit(0))
    by_limit = whole.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rated = limits.withColumn("rate", left / weight_left)
    stops = F.col("limit") <= F.col("rate") * F.col("weight")
    # Past the first source that does not stop, the rate no longer changes.
    final = F.min(F.when(~stops, F.struct(F.col("limit") / F.col("weight"), F.col("rate")))).over(whole)["rate"]
    target = F.when(stops, F.col("limit")).otherwise(final * F.col("weight"))
    return rated.select("source", "source_size", "weight", target.cast("double").alias("target"))


def random_odds(key: Column, seed: str, share: Column) -> Column:
    """Pareto rank of a row, mapped into [0, 1): random odds divided by inclusion odds, as q / (1 + q)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12).cast("double")
    u = (bits + 0.5) / F.lit(float(2**52))
    q = (u / (1 - u)) / (share / (1 - share))
    return q / (1 + q)


def pareto_ranks(docs: DataFrame, goal: DataFrame, seed: str = SEED) -> DataFrame:
    """Pareto rank of each document and what its source still has to take.

    ``docs``: ``(doc_id, source, size, body, nth)``, ``nth`` telling equal ids
    apart, or equal texts of rows without an id; ``goal``: rows of :func:`targets`. A source whose target is r times its
    size takes floor(r) certain copies of every document; the rest of the
    target is for the documents that come first in Pareto order, random odds
    over inclusion odds. The rank goes with the numbers of two levels of bins,
    by which the cut is found without ordering a whole source in one task.
    """
    rated = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # A rate that is whole but for rounding has no rest to sample.
    rated = rated.withColumn("certain", F.floor(F.col("copies") + 1e-9)).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("certain") * F.col("source_size"))
    ).withColumn("share", F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("copies") - F.col("certain"))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\u0001"), F.col("body").cast("string")))
    key = F.concat_ws("\u0001", name, F.col("nth").cast("string"))
    # A null source is a name like any other.
    ranked = docs.join(
        rated.select(F.col("source").alias("s"), "source_size", "target", "certain", "rest", "share"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s").withColumn("rank", random_odds(key, seed, F.col("share")))
    ranked = ranked.withColumn("bin1", F.floor(F.col("rank") * BINS)).withColumn(
        "bin2", F.floor((F.col("rank") * BINS - F.col("bin1")) * BINS)
    )
    return ranked


def _cut(binned: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Of bins with words and a rest per key, the bin in which the rest is reached and the words before it."""
    span = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]).orderBy(level)
    run = binned.withColumn("upto", F.sum("words").over(span)).withColumn("before", F.col("upto") - F.col("words"))
    return run.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))


def _numbered(unknown: DataFrame) -> DataFrame:
    """Rows without an id, ``nth`` numbering those alike in source, size and text.

    Such rows are counted, map-side, and made again from their number in
    chunks, so that no task holds all copies of a frequent text.
    """
    alike = ["source", "size", "body"]
    chunks = unknown.groupBy("doc_id", *alike).agg(F.count("*").alias("rows")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK)))
    ).repartition(*alike, "chunk")
    first, last = F.col("chunk") * CHUNK + 1, F.least((F.col("chunk") + 1) * CHUNK, F.col("rows"))
    return chunks.select("doc_id", *alike, F.explode(F.sequence(first, last)).alias("nth"))


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, seed: str = SEED
) -> DataFrame:
    """Every document with the words that the mixture takes of it.

    Returns ``doc_id, nth, body, source, size, source_size, target, copies``;
    ``nth`` numbers rows that repeat one id, or source and text without an id; ``body`` is a hash of the text. Null texts have size
    0, a null source is a source of its own and comes last. Rows without an id
    take part like others. Empty tables give no rows; other columns are
    ignored. The same rows give the same mix in any order and on any cluster:
    ranks depend on ids, for rows without one on texts, and the seed alone; equal ranks are ordered by id. Where
    the sample stops short of the target, the one document left whose size is
    nearest to the gap is added, if that brings the sum nearer.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("body"))
    repeat = Window.partitionBy("doc_id").orderBy("source", "size", "body")
    # Null ids are told apart by their text and number, so that they do not meet in one task.
    known = sized.filter("doc_id is not null").withColumn("nth", F.row_number().over(repeat).cast("long"))
    rows = keep(known.unionByName(_numbered(sized.filter("doc_id is null"))), "mix-sizes")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_copies)
    ranked = keep(pareto_ranks(rows, keep(goal, "mix-targets"), seed), "mix-ranks")

    first = _cut(
        ranked.groupBy("source", "rest", "bin1").agg(F.sum("size").alias("words")), ["source"], "bin1"
    ).select(F.col("source").alias("s"), F.col("bin1").alias("cut1"), F.col("before").alias("before1"))
    in_first = ranked.join(
        first, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin1") == F.col("cut1"))
    ).drop("s")
    second = _cut(
        in_first.groupBy("source", "rest", "before1", "bin2").agg(F.sum("size").alias("words"))
        .withColumn("rest", F.col("rest") - F.col("before1")), ["source"], "bin2",
    ).select(F.col("source").alias("s2"), F.col("bin2").alias("cut2"), (F.col("before1") + F.col("before")).alias("before2"))
    # One part in 16.8 million of a source: the rows among which the cut falls.
    inside = in_first.join(
        second, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bin2") == F.col("cut2"))
    )
    order = Window.partitionBy(F.coalesce(F.col("source"), F.lit("\u0000")), "cut2").orderBy(
        "rank", "doc_id", "nth", "size", "body"
    ).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before2") + F.sum("size").over(order)
    inside = inside.withColumn("in", (upto <= F.col("rest")).cast("int"))
    edge = inside.select(
        F.col("source").alias("es"), F.col("doc_id").alias("ed"), F.col("nth").alias("en"), F.col("size").alias("ez"),
        F.col("body").alias("eb"), F.col("in").alias("edge_in"),
    )
    cuts = first.join(second, F.col("s").eqNullSafe(F.col("s2"))).select("s", "cut1", "cut2")
    placed = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").join(
        edge,
        F.col("source").eqNullSafe(F.col("es")) & F.col("doc_id").eqNullSafe(F.col("ed")) & (F.col("nth") == F.col("en"))
        & (F.col("size") == F.col("ez")) & (F.col("body") == F.col("eb")),
        "left",
    )
    # No cut: the rest is 0, or rounding left it above the sum of the source.
    below = (F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))
    chosen = F.when(F.col("rest") <= 0, 0).when(F.col("cut1").isNull(), 1).when(below, 1).otherwise(
        F.coalesce(F.col("edge_in"), F.lit(0))
    )
    placed = keep(placed.withColumn("chosen", chosen), "mix-placed")
    lack = placed.groupBy("source").agg((F.first("rest") - F.sum(F.col("size") * F.col("chosen"))).alias("lack"))
    off = F.abs(F.col("size") - F.col("lack"))
    # One document per source closes the gap before the cut, if any document brings the sum nearer.
    last = (
        placed.filter("chosen = 0").join(
            lack.withColumnRenamed("source", "ls"), F.col("source").eqNullSafe(F.col("ls"))
        ).filter(off < F.col("lack"))
        .groupBy("source").agg(F.min(F.struct(off, "rank", "doc_id", "nth", "size", "body")).alias("m"))
        .select(F.col("source").alias("fs"), *(F.col(f"m.{c}").alias(f"f_{c}") for c in ("doc_id", "nth", "size", "body")))
    )
    filled = placed.join(last, F.col("source").eqNullSafe(F.col("fs")), "left")
    is_last = F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("nth") == F.col("f_nth")) & (
        F.col("size") == F.col("f_size")
    ) & (F.col("body") == F.col("f_body"))
    extra = F.coalesce(is_last.cast("int"), F.lit(0))
    return filled.select(
        "doc_id", "nth", "body", "source", "size", "source_size", "target",
        (F.col("certain") + F.col("chosen") + extra).cast("long").alias("copies"),
    )


def mixed_documents(docs: DataFrame, **choices) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, numbered by ``copy`` from 1.

    Takes the arguments of :func:`mix`. A column ``copy`` is replaced.
    """
    keys = ["_id", "_source", "_body"]
    taken = (
        mix(docs, **choices).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("body").alias("_body"))
        .agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
        & (F.xxhash64("text") == F.col("_body"))
    )
    rows = docs.drop("copy").join(taken, same)
    # Rows alike in id, source and text share one count, so one of them stands for all.
    alike = rows.filter("_rows > 1").dropDuplicates(keys)
    rows = rows.filter("_rows = 1").unionByName(alike)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop(*keys, "_copies", "_rows")


@query("op10_mixing")
def op10_mixing(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies"
    )
