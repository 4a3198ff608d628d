"""The warehouse questions as DataFrame functions.

Column roles are arguments, so the same functions run on any table that has a
key, a time and a status. ``latest`` by row number keeps one event per key
(ties broken by id); ``latest`` by maximum time keeps all events of that time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import format_ts

SUMMARY_KINDS = ("folder_summary",)
ITEM_KINDS = ("folder_summary", "open_items_only")
STATE_COLUMNS = ("folder_purpose", "property_address", "contract_status", "inspection_status", "file_count_total")


def of_kinds(events: DataFrame, kinds: Sequence[str] | None, kind: str = "response_kind") -> DataFrame:
    return events if kinds is None else events.filter(F.col(kind).isin(*kinds))


def latest_rows(df: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """One latest row per key. The rank limit also runs before the shuffle, so a
    key with a third of all rows sends one row per task."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tiebreak).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest_times(df: DataFrame, key: str, ts: str, part: str | None = None) -> DataFrame:
    """Latest time per key, with the partition value of its row where ``part`` names that column."""
    if part is None:
        return df.groupBy(key).agg(F.max(ts).alias(ts))
    return df.groupBy(key).agg(F.max(F.struct(ts, part)).alias("_m")).select(key, f"_m.{ts}", f"_m.{part}")


def at_latest(child: DataFrame, latest: DataFrame, key: str, ts: str, part: str | None = None) -> DataFrame:
    """Child rows of the latest events: an equi-join on key and time.

    With ``part``, the partition column of both tables joins too, so the child
    table is read only in the partitions that hold a latest event.
    """
    return child.join(latest, [key, ts] if part is None else [key, ts, part])


def latest_state(events: DataFrame, key="folder_key", ts="generated_at", tiebreak="event_id",
                 cols: Sequence[str] = STATE_COLUMNS, kinds=SUMMARY_KINDS, kind="response_kind") -> DataFrame:
    """Latest state per folder."""
    last = latest_rows(of_kinds(events, kinds, kind), key, ts, tiebreak)
    return last.select(key, *cols, format_ts(F.col(ts)).alias(ts))


def latest_state_recent(events: DataFrame, today: Column, days: int = 90, day: str | None = None, ts="generated_at",
                        **roles) -> DataFrame:
    """Latest state over the last days only; ``day`` names the partition column."""
    first = F.date_sub(today, days)
    if day is not None:
        events = events.filter(F.col(day) >= first)
    recent = events.filter(F.to_date(ts) >= first)
    return latest_state(recent, ts=ts, **roles)


def purpose_counts(events: DataFrame, key="folder_key", ts="generated_at", tiebreak="event_id",
                   purpose="folder_purpose", kinds=SUMMARY_KINDS, kind="response_kind") -> DataFrame:
    """Folders by purpose in the latest snapshot; ``kinds=None`` takes every event."""
    last = latest_rows(of_kinds(events, kinds, kind).select(key, ts, tiebreak, purpose), key, ts, tiebreak)
    return last.groupBy(purpose).agg(F.count("*").alias("folder_count"))


def open_item_distribution(events: DataFrame, items: DataFrame, key="folder_key", ts="generated_at",
                           label="label", status="status", kinds=ITEM_KINDS, kind="response_kind", part: str | None = None) -> DataFrame:
    last = latest_times(of_kinds(events, kinds, kind), key, ts, part)
    return at_latest(items, last, key, ts, part).groupBy(label, status).agg(F.count("*").alias("n"))


def field_population(events: DataFrame, fields: DataFrame, key="folder_key", ts="generated_at",
                     field="field_name", kinds=SUMMARY_KINDS, kind="response_kind", part: str | None = None) -> DataFrame:
    """Fields at the latest events, with their share of all folders."""
    last = latest_times(of_kinds(events, kinds, kind), key, ts, part)
    total = last.agg(F.count("*").alias("n")).scalar()
    counted = at_latest(fields, last, key, ts, part).groupBy(field).agg(F.count("*").alias("folders_with_value"))
    return counted.withColumn("total_folders", total).withColumn(
        "pct", F.round(F.lit(100.0) * F.col("folders_with_value") / F.col("total_folders"), 1)
    )


def marker_inventory(events: DataFrame, inventory: DataFrame, key="folder_key", ts="generated_at",
                     marker="is_marker", kinds=SUMMARY_KINDS, kind="response_kind", part: str | None = None) -> DataFrame:
    last = latest_times(of_kinds(events, kinds, kind), key, ts, part)
    return (
        at_latest(inventory, last, key, ts, part)
        .groupBy(key)
        .agg(
            F.count("*").alias("total_docs"),
            F.count_if(F.col(marker)).alias("marker_docs"),
            F.count_if(~F.col(marker)).alias("text_docs"),
        )
        .filter("marker_docs > 0 or total_docs > 0")
    )


def folders_with_open_items(events: DataFrame, items: DataFrame, key="folder_key", ts="generated_at",
                            label="label", status="status", not_found="not_found", needs_review="needs_review",
                            kinds=ITEM_KINDS, kind="response_kind", part: str | None = None) -> DataFrame:
    """Folders with checklist lines that are not found or need review.

    ``items`` is ordered by label; a folder has as many lines as its checklist.
    """
    last = latest_times(of_kinds(events, kinds, kind), key, ts, part)
    return (
        at_latest(items, last, key, ts, part)
        .groupBy(key)
        .agg(
            F.count_if(F.col(status) == not_found).alias("not_found_count"),
            F.count_if(F.col(status) == needs_review).alias("needs_review_count"),
            F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(status).alias("status")))).alias("items"),
        )
        .filter("not_found_count > 0 or needs_review_count > 0")
    )


def all_fields_latest(events: DataFrame, fields: DataFrame, key="folder_key", ts="generated_at",
                      cols: Sequence[str] = ("field_name", "field_value", "confidence", "source_file"),
                      kinds=SUMMARY_KINDS, kind="response_kind", part: str | None = None) -> DataFrame:
    last = latest_times(of_kinds(events, kinds, kind), key, ts, part)
    return at_latest(fields, last, key, ts, part).select(key, *cols)


def field_population_by_day(fields: DataFrame, ts="generated_at", field="field_name", event="event_id",
                            today: Column | None = None, days: int = 30, part: str | None = None) -> DataFrame:
    """Events with a value per field and day, to see drift; ``part`` names the month column of the table."""
    dated = fields.withColumn("day", F.to_date(ts))
    if today is not None:
        first = F.date_sub(today, days)
        if part is not None:
            dated = dated.filter(F.col(part) >= F.trunc(first, "month"))
        dated = dated.filter(F.col("day") >= first)
    # Deduplicate first: both steps combine on the map side, one hot field included.
    return dated.select("day", field, event).distinct().groupBy("day", field).agg(F.count("*").alias("rows_with_value"))


def with_previous(df: DataFrame, key: str, ts: str, tiebreak: str, cols: Sequence[str], bucket: str = "day") -> DataFrame:
    """``prev_<col>`` of the row before, per key, for keys of any size.

    Rows are ordered inside (key, time bucket) groups; the first row of a group
    takes the last row of the key's previous group, found among one summary row
    per group. A key with a third of the table is thus sorted bucket by bucket.
    Pick a finer ``bucket`` (``hour``, ``minute``) for denser data.
    """
    slot = df.withColumn("_slot", F.date_trunc(bucket, F.col(ts)))
    inside = Window.partitionBy(key, "_slot").orderBy(ts, tiebreak)
    prev = lambda c: F.lag(c).over(inside)
    ranked = slot.withColumn("_rn", F.row_number().over(inside)).withColumns({f"prev_{c}": prev(c) for c in cols})
    ends = slot.groupBy(key, "_slot").agg(
        F.max_by(F.struct(*cols), F.struct(ts, tiebreak)).alias("_end")
    )
    before = F.lag("_end").over(Window.partitionBy(key).orderBy("_slot"))
    starts = ends.withColumn("_before", before).filter("_before is not null").select(key, "_slot", "_before", F.lit(1).alias("_rn"))
    joined = ranked.join(starts, [key, "_slot", "_rn"], "left")
    return joined.withColumns(
        {f"prev_{c}": F.when(F.col("_before").isNotNull(), F.col(f"_before.{c}")).otherwise(F.col(f"prev_{c}")) for c in cols}
    ).drop("_slot", "_rn", "_before")


def status_changes(events: DataFrame, key="folder_key", ts="generated_at", tiebreak="event_id",
                   cols: Sequence[str] = ("contract_status", "inspection_status"), kinds=SUMMARY_KINDS,
                   kind="response_kind", bucket: str = "day") -> DataFrame:
    """Rows whose status differs from the one before, NULLs compared as values."""
    seen = with_previous(of_kinds(events, kinds, kind).select(key, ts, tiebreak, *cols), key, ts, tiebreak, cols, bucket)
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    return seen.filter(changed)


def register_latest_views(events: DataFrame, items: DataFrame, prefix: str = "latest_", **roles) -> dict[str, DataFrame]:
    """Temp views of the latest event, state and open items per folder."""
    key, ts = roles.get("key", "folder_key"), roles.get("ts", "generated_at")
    tiebreak = roles.get("tiebreak", "event_id")
    state_cols = roles.get("cols", STATE_COLUMNS)
    kinds, item_kinds = roles.get("kinds", SUMMARY_KINDS), roles.get("item_kinds", ITEM_KINDS)
    kind, part = roles.get("kind", "response_kind"), roles.get("part")
    views = {
        f"{prefix}event": latest_rows(of_kinds(events, kinds, kind), key, ts, tiebreak),
        f"{prefix}state": latest_state(events, key, ts, tiebreak, state_cols, kinds, kind),
        f"{prefix}open_items": at_latest(items, latest_times(of_kinds(events, item_kinds, kind), key, ts, part), key, ts, part),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views
