"""Counts and audits over corpora, classifications, manifests and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.classify import query_mode
from ..functions.names import suffix
from ..functions.text import first_hit


def counted(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def with_percent(counts: DataFrame, n: str = "n", out: str = "pct", digits: int = 1, within: Sequence[str] = ()) -> DataFrame:
    """Share of the total, over a table that is already counted."""
    if within:
        total = F.sum(n).over(Window.partitionBy(*within))
        return counts.withColumn(out, F.round(100.0 * F.col(n) / total, digits))
    total = counts.agg(F.sum(n).alias("t")).scalar()
    return counts.withColumn("_total", total).withColumn(out, F.round(100.0 * F.col(n) / F.col("_total"), digits)).drop("_total")


def count_percent(df: DataFrame, *by: str | Column, digits: int = 1) -> DataFrame:
    return with_percent(counted(df, *by), digits=digits)


def top_counts(df: DataFrame, by: str | Column, k: int, alias: str) -> DataFrame:
    """``k`` most frequent values, ties by value."""
    col = F.col(by) if isinstance(by, str) else by
    return counted(df, col.alias(alias)).orderBy(F.col("n").desc(), alias).limit(k)


def row_counts(events: DataFrame, dims: Sequence[str] = ("schema_version", "response_kind", "folder_purpose")) -> DataFrame:
    """Rows by each dimension and in total, in one pass: dimension, value, n."""
    dim = F.lit("total")
    value = F.lit(None).cast("string")
    for d in dims:
        dim = F.when(F.col(f"_g_{d}") == 0, d).otherwise(dim)
        value = F.when(F.col(f"_g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("(missing)"))).otherwise(value)
    flags = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    groups = [[]] + [[F.col(d)] for d in dims]
    grouped = events.groupingSets(groups, *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), *flags)
    return grouped.select(dim.alias("dimension"), value.alias("value"), "n")


def field_coverage(fields: DataFrame, eligible: Column | int | DataFrame, field: str = "field_name",
                   value: str = "field_value", confidence: str = "confidence", source: str = "source_file",
                   names: Sequence[str] | None = None) -> DataFrame:
    """Population, share, confidence spread and sourced count per field.

    ``fields`` has one row per (eligible event, field); ``eligible`` is their
    number of events. Confidence values are few, so the map stays small.
    """
    total = eligible if isinstance(eligible, Column) else F.lit(eligible)
    present = fields.filter(F.col(value).isNotNull())
    spread = present.groupBy(field, F.coalesce(confidence, F.lit("None")).alias("c")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.col(source), F.lit("")) != "").alias("sourced")
    )
    out = (
        spread.groupBy(field)
        .agg(
            F.sum("n").alias("populated"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("confidences"),
            F.sum("sourced").alias("with_source"),
        )
        .withColumn("eligible", total)
    )
    return out.withColumn("pct", F.round(100.0 * F.col("populated") / F.col("eligible"), 1))


def promotion(coverage: DataFrame, at: float = rules.PROMOTE_PERCENT) -> DataFrame:
    """Whether a field is populated often enough for a column of its own."""
    return coverage.withColumn(
        "recommendation",
        F.when(100.0 * F.col("populated") / F.col("eligible") >= at, "promote").otherwise("keep_nullable"),
    )


def status_distribution(items: DataFrame, label: str = "label", status: str = "status") -> DataFrame:
    """Statuses per label and overall (NULL label), in one pass."""
    grouped = items.groupingSets([[F.col(label), F.col(status)], [F.col(status)]], F.col(label), F.col(status)).agg(
        F.count("*").alias("n"), F.grouping(label).alias("overall")
    )
    return grouped.withColumn("overall", F.col("overall") == 1)


def bucket_distribution(inventory: DataFrame, event: str = "event_id", bucket: str = "bucket") -> tuple[DataFrame, DataFrame]:
    """(per bucket, per record): records and documents per bucket; spread of documents per record.

    ``inventory`` is one row per document. Both come from one table counted by
    (event, bucket).
    """
    cell = inventory.groupBy(event, bucket).agg(F.count("*").alias("n"))
    per_bucket = cell.groupBy(bucket).agg(F.count("*").alias("records"), F.sum("n").alias("docs"))
    per_record = (
        cell.groupBy(event).agg(F.sum("n").alias("docs"))
        .agg(F.count("*").alias("records"), F.round(F.avg("docs"), 4).alias("avg_docs"), F.min("docs").alias("min_docs"), F.max("docs").alias("max_docs"))
    )
    return per_bucket, per_record


def coverage_label(doc_type: Column) -> Column:
    tag = F.coalesce(doc_type, F.lit(""))
    return (
        F.when(tag == "", "(empty / no sidecar entry)")
        .when(F.lower(tag).isin(*rules.UNCLASSIFIED_TAGS), tag)
        .otherwise("(classified -- out of audit scope)")
    )


def leverage(guesses: DataFrame, bucket: str = "guess_bucket") -> DataFrame:
    """Share of audited files with a guess, claim-relevant files, and the verdict."""
    signal = F.col(bucket) != "(no_guess)"
    out = guesses.agg(
        F.count("*").alias("audited"), F.count_if(signal).alias("actionable"),
        F.count_if(F.col(bucket).isin(*rules.CLAIM_RELEVANT_BUCKETS)).alias("claim_relevant"),
    ).withColumn("pct", F.when(F.col("audited") > 0, 100.0 * F.col("actionable") / F.col("audited")).otherwise(0.0))
    verdict = F.lit("low_leverage")
    for floor, name in reversed(rules.LEVERAGE_BANDS):
        verdict = F.when(F.col("pct") >= floor, name).otherwise(verdict)
    return out.withColumn("verdict", verdict).withColumn("pct", F.round("pct", 1))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """Files and bytes per top folder and suffix."""
    ext = suffix(F.substring_index("path", "/", -1))
    return (
        corpus.groupBy(
            F.concat(F.substring_index("path", "/", 1), F.lit("/")).alias("prefix"),
            F.when(ext == "", "(no ext)").otherwise(ext).alias("ext"),
        )
        .agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    )


def extraction_summary(audit: DataFrame) -> DataFrame:
    """Audited files by tier and by flag with their share: kind, value, n, pct."""
    grouped = audit.groupingSets(
        [[F.col("production_tier")], [F.col("flag")]], F.col("production_tier"), F.col("flag")
    ).agg(F.count("*").alias("n"), F.grouping("flag").alias("_tier"))
    rows = grouped.select(
        F.when(F.col("_tier") == 1, "tier").otherwise("flag").alias("kind"),
        F.when(F.col("_tier") == 1, F.col("production_tier")).otherwise(F.col("flag")).alias("value"), "n",
    ).filter("kind = 'tier' or value <> ''")
    total = audit.agg(F.count("*").alias("t")).scalar()
    return rows.withColumn("_t", total).withColumn("pct", F.round(100.0 * F.col("n") / F.col("_t"), 1)).drop("_t")


def extraction_hints(summary: DataFrame) -> DataFrame:
    """Hints whose threshold the summary passes."""
    limits = rules.AUDIT_HINTS
    share = lambda value: F.coalesce(F.max(F.when(F.col("value") == value, F.col("pct"))), F.lit(0.0))
    one = summary.agg(
        share("tier1_extracted").alias("t1"), share("thin_text_layer_accepted").alias("thin"),
        share("tier2_ocr_live").alias("live"), share("tier3_passthrough").alias("through"),
    )
    hints = F.array_compact(
        F.array(
            F.when(F.col("t1") > limits["healthy_above"], F.lit("extraction_healthy")),
            F.when(F.col("thin") > limits["thin_above"], F.lit("thin_text_layers")),
            F.when(F.col("live") > limits["ocr_above"], F.lit("ocr_pending")),
            F.when(F.col("through") > limits["passthrough_above"], F.lit("passthrough_names")),
        )
    )
    return one.select(F.explode(F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("nothing_broken")))).alias("hint"))


def discovery(classified: DataFrame, path: str = "path", strict: str = "strict", heuristic: str = "heuristic",
              prefix: str = "mirror", properties_folder: str = "Properties", categories: Sequence[str] = ()) -> DataFrame:
    """How a corpus classifies: counts, and unknown category folders as rows.

    Rows are (kind, value, n): ``strict``, ``heuristic``, ``unclassified``,
    ``property`` (seen below the properties folder) and ``skipped_category``.
    """
    parts = F.split(path, "/")
    below = (F.size(parts) >= 5) & (F.get(parts, F.lit(0)) == prefix) & (F.get(parts, F.lit(1)) == properties_folder)
    state = (
        F.when(F.col(strict).isNotNull(), "strict").when(F.col(heuristic).isNotNull(), "heuristic").otherwise("unclassified")
    )
    folder = F.when(below, F.get(parts, F.lit(2)))
    category = F.when(
        below & F.col(strict).isNull() & ~F.get(parts, F.lit(3)).isin(*categories), F.get(parts, F.lit(3))
    )
    rows = classified.select(
        F.explode(
            F.array(
                F.struct(F.lit("class").alias("kind"), state.alias("value")),
                F.struct(F.lit("property").alias("kind"), folder.alias("value")),
                F.struct(F.lit("skipped_category").alias("kind"), category.alias("value")),
            )
        ).alias("r")
    )
    return counted(rows.select("r.*").filter("value is not null"), "kind", "value")


def type_shift(diff: DataFrame) -> DataFrame:
    """Counts per type before and after, with the change."""
    both = diff.select(
        F.explode(
            F.array(
                F.struct(F.col("before").alias("doc_type"), F.lit(1).alias("b"), F.lit(0).alias("a")),
                F.struct(F.col("after").alias("doc_type"), F.lit(0).alias("b"), F.lit(1).alias("a")),
            )
        ).alias("r")
    ).select("r.*")
    return (
        both.filter("doc_type is not null")
        .groupBy("doc_type")
        .agg(F.sum("b").alias("before_n"), F.sum("a").alias("after_n"))
        .withColumn("delta", F.col("after_n") - F.col("before_n"))
    )


def sidecar_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer comparison: uri, before, after, change."""
    joined = old.select("uri", F.col("doc_type").alias("before")).join(
        new.select("uri", F.col("doc_type").alias("after")), "uri", "full_outer"
    )
    return joined.withColumn(
        "change",
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(F.col("before") == F.col("after"), "unchanged").otherwise("changed"),
    )


def transitions(diff: DataFrame, k: int | None = None, min_count: int = 1) -> DataFrame:
    """Type transitions by count; unchanged files are none."""
    moves = counted(
        diff.filter("change <> 'unchanged'"),
        F.coalesce("before", F.lit("(none)")).alias("before"), F.coalesce("after", F.lit("(none)")).alias("after"),
    ).filter(F.col("n") >= min_count)
    return moves if k is None else moves.orderBy(F.col("n").desc(), "before", "after").limit(k)


def transition_samples(diff: DataFrame, samples: int, min_count: int = 1) -> DataFrame:
    """First files of every transition that is frequent enough."""
    moved = diff.filter("change <> 'unchanged'").select(
        "uri", F.coalesce("before", F.lit("(none)")).alias("before"), F.coalesce("after", F.lit("(none)")).alias("after")
    )
    big = transitions(diff, min_count=min_count)
    w = Window.partitionBy("before", "after").orderBy("uri")
    first = moved.withColumn("sample", F.row_number().over(w)).filter(F.col("sample") <= samples)
    return first.join(big, ["before", "after"])


def improved_share(diff: DataFrame, generic: str = rules.DEFAULT_TYPE) -> DataFrame:
    """Of the files that were generic, how many are specific now."""
    was = F.col("before") == generic
    better = was & (F.coalesce("after", F.lit(generic)) != generic)
    return diff.agg(F.count_if(was).alias("generic_before"), F.count_if(better).alias("improved")).withColumn(
        "pct", F.round(100.0 * F.col("improved") / F.nullif(F.col("generic_before"), F.lit(0)), 1)
    )


def daily_usage(log: DataFrame, ts: str, today: Column, keep_days: int = 90) -> DataFrame:
    """Queries per day, kept for the last days."""
    return (
        log.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
        .filter(F.col("day") >= F.date_sub(today, keep_days))
    )


def usage_totals(log: DataFrame, ts: str, today: Column) -> DataFrame:
    day = F.to_date(ts)
    return log.groupBy(day.alias("day")).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("day") == today, F.col("n"))), F.lit(0)).alias("today"),
        F.coalesce(F.sum(F.when(F.date_trunc("month", "day") == F.date_trunc("month", today), F.col("n"))), F.lit(0)).alias("this_month"),
        F.sum("n").alias("all_time"),
    )


def cost_estimate(docs: Column, size_bytes: Column, month_queries: Column, prices=rules.PRICES) -> list[Column]:
    """Monthly cost columns of document, storage and query counts."""
    hosting = docs / 1000 * prices["doc_hosting_per_1k_month"]
    storage = size_bytes / float(1024**3) * prices["storage_per_gb_month"]
    asked = month_queries / 1000 * prices["answer_query_per_1k"]
    return [
        F.round(hosting, 2).alias("doc_hosting"), F.round(storage, 4).alias("storage"),
        F.round(asked, 2).alias("api_queries"), F.round(hosting + storage + asked, 2).alias("total_monthly"),
    ]


def samples_per(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("sample", F.row_number().over(w)).filter(F.col("sample") <= n)


def read_limit(query: Column) -> Column:
    """How many documents a query may read, by its mode."""
    limits = (("list", rules.LIST_LIMIT), ("fact", rules.FACT_READ_LIMIT))
    return first_hit([(query_mode(query) == mode, F.lit(n)) for mode, n in limits], F.lit(rules.SYNTHESIS_READ_LIMIT))


def head(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)

