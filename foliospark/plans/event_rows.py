"""Shaping of events: parsed log lines to the parent row and its child rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.classify import is_placeholder
from ..functions.text import any_of, bind, blank_to_null, computed, first_hit, nonempty, rx, strip
from ..functions.values import event_id, get, int_at, is_yes, objects_at, text_at, truthy

FACT_TYPE = "array<struct<label:string,value:string,confidence:string,sources:array<string>>>"
TIMELINE_TYPE = "array<struct<date:string,event:string,confidence:string,sources:array<string>>>"
SOURCE_TYPE = "array<struct<title:string,uri:string,subfolder:string>>"
ITEM_TYPE = "array<struct<name:string,uri:string,doc_type:string,bucket:string,is_marker:boolean>>"
OPEN_ITEM_TYPE = (
    "array<struct<label:string,bucket:string,status:string,strict_count:bigint,total_count:bigint,"
    "checklist_name:string>>"
)
# Lists as they are read from a line: every item at once, what is no object or of another kind is NULL.
_ITEMS = "struct<name:string,uri:string,doc_type:string,bucket:string,is_marker:string>"
_LOOSE_ITEMS = "struct<name:string,uri:string,doc_type:string,is_marker:variant>"
_FIELD = "struct<value:string,confidence:string,source_file:string>"
_OPEN_ITEMS = "struct<label:string,bucket:string,status:string,strict_count:bigint,total_count:bigint,checklist_name:string>"
TRIPLE_TYPE = "struct<value:string,confidence:string,source_file:string>"

_V = "v"


def _v(path: str, kind: str) -> Column:
    return get(F.col(_V), path, kind)


def _kept(found: Column) -> Column:
    """Texts of a list that are not blank; an empty list where there is none."""
    return F.coalesce(F.array_compact(F.transform(found, blank_to_null)), F.expr("cast(array() as array<string>)"))


def _structs(found: Column, fields: tuple[str, ...], with_sources: bool, kind: str) -> Column:
    def shape(item: Column) -> Column:
        cols = [blank_to_null(item[f]).alias(f) for f in fields]
        if with_sources:
            cols.append(_kept(item["sources"]).alias("sources"))
        return F.struct(*cols)

    return F.coalesce(F.transform(F.filter(found, lambda x: x.isNotNull()), shape), F.expr(f"cast(array() as {kind})"))


def with_event_id(good: DataFrame) -> DataFrame:
    raw = [_v(f"$.{k}", "string") for k in ("folder_name", "generated_at", "response_kind", "query")]
    return computed(good, event_id=event_id(*raw))


def _dated(good: DataFrame) -> DataFrame:
    return good.filter("generated_ts is not null")


def _read(good: DataFrame) -> DataFrame:
    """Lines with what the tables need of their object: one pass over its keys, not a search for each."""
    return computed(good, _o=_v("$", _OBJECT))


def _event_columns(loader_version: str, loaded_at: Column | None) -> list[Column | str]:
    at = lambda name: F.col(f"_o.{name}")
    plain = lambda name: blank_to_null(at(name)).alias(name)
    known = lambda name, default: F.coalesce(blank_to_null(at(name)), F.lit(default))
    promoted = lambda f, part: blank_to_null(F.try_element_at(at("structured_fields"), F.lit(f))[part])
    return [
        "event_id",
        F.col("generated_ts").alias("generated_at"),
        known("schema_version", "unknown").alias("schema_version"),
        known("response_kind", "unknown").alias("response_kind"),
        known("folder_name", "").alias("folder_key"),
        known("folder_name", "").alias("folder_name"),
        plain("folder_purpose"), plain("checklist_name"), plain("query"), plain("confidence"),
        is_yes(at("show_open_items")).alias("show_open_items"),
        at("file_count_total").alias("file_count_total"),
        at("file_count_in_dossier").alias("file_count_in_dossier"),
        plain("overview"),
        _kept(at("observations")).alias("observations"),
        promoted("property_address", "value").alias("property_address"),
        promoted("property_address", "confidence").alias("property_address_confidence"),
        promoted("property_address", "source_file").alias("property_address_source_file"),
        promoted("contract_status", "value").alias("contract_status"),
        promoted("contract_status", "confidence").alias("contract_status_confidence"),
        promoted("inspection_status", "value").alias("inspection_status"),
        promoted("inspection_status", "confidence").alias("inspection_status_confidence"),
        _structs(at("key_facts"), ("label", "value", "confidence"), True, FACT_TYPE).alias("key_facts"),
        _structs(at("timeline"), ("date", "event", "confidence"), True, TIMELINE_TYPE).alias("timeline"),
        _structs(at("sources"), ("title", "uri", "subfolder"), False, SOURCE_TYPE).alias("sources"),
        F.col("line").alias("payload_json"),
        (F.current_timestamp() if loaded_at is None else loaded_at).alias("loaded_at"),
        F.lit(loader_version).alias("loader_version"),
    ]


def event_rows(good: DataFrame, loader_version: str = "1", loaded_at: Column | None = None) -> DataFrame:
    """Parent rows. Lines without a readable time are left to ``undated``."""
    return _read(_dated(good)).select(*_event_columns(loader_version, loaded_at))


#: Lists of a line that its child rows are made of.
LISTS = {
    "_fields": ("structured_fields", f"map<string,{_FIELD}>"),
    "_inventory": ("document_inventory", f"map<string,array<{_ITEMS}>>"),
    "_open_items": ("open_items", f"array<{_OPEN_ITEMS}>"),
}
_TEXTS = (
    "schema_version", "response_kind", "folder_name", "folder_purpose", "checklist_name", "query", "confidence",
    "show_open_items", "overview",
)
# The whole object as one type; a value of another kind is NULL by itself.
_OBJECT = "struct<" + ",".join([
    *[f"{n}:string" for n in _TEXTS], "file_count_total:bigint", "file_count_in_dossier:bigint", "observations:array<string>",
    f"key_facts:{FACT_TYPE}", f"timeline:{TIMELINE_TYPE}", f"sources:{SOURCE_TYPE}", *[f"{n}:{kind}" for n, kind in LISTS.values()],
]) + ">"


def shaped(good: DataFrame, loader_version: str = "1", loaded_at: Column | None = None) -> DataFrame:
    """The parent row of every line beside its lists, so that no table needs the object again; ``generated_at`` may be NULL.

    Written once, a table reads its own columns of it: a parsed object is as
    long as its line, and would be read and searched once for every table.
    """
    lists = [F.col(f"_o.{of}").alias(n) for n, (of, _) in LISTS.items()]
    return _read(good).select(*_event_columns(loader_version, loaded_at), *lists)


def tables(lines: DataFrame) -> dict[str, DataFrame]:
    """The four tables of shaped lines."""
    dated = lines.filter("generated_at is not null")
    return {
        "events": dated.drop(*LISTS), "fields_long": _field_rows(dated), "inventory": _inventory_rows(dated),
        "open_items": _open_item_rows(dated),
    }


def undated(good: DataFrame) -> DataFrame:
    """Objects whose time cannot be read; they would break the required column."""
    return good.filter("generated_ts is null").select("line")


def _listed(good: DataFrame, name: str, **more: Column) -> DataFrame:
    """Keys of every dated line beside one of its lists; both are taken once per line."""
    folder = F.coalesce(text_at(F.col(_V), "$.folder_name"), F.lit(""))
    of, kind = LISTS[name]
    return computed(_dated(good).withColumn("generated_at", F.col("generated_ts")), folder_key=folder, **{name: _v(f"$.{of}", kind)}, **more)


_KEYS = ("event_id", "generated_at", "folder_key")


def _field_rows(lines: DataFrame) -> DataFrame:
    entry = lambda name: F.col(f"entry.{name}")
    return (
        lines.select(*_KEYS, F.explode("_fields").alias("field_name", "entry"))
        .filter(entry("value") != "")
        .select(
            *_KEYS, "field_name", blank_to_null(entry("value")).alias("field_value"),
            *[blank_to_null(entry(n)).alias(n) for n in ("confidence", "source_file")],
        )
    )


def field_rows(good: DataFrame) -> DataFrame:
    """One row per structured field that has a value; white space counts as one."""
    return _field_rows(_listed(good, "_fields"))


def _inventory_rows(lines: DataFrame) -> DataFrame:
    return (
        lines.select(*_KEYS, F.explode("_inventory").alias("group", "items"))
        .select(*_KEYS, "group", F.explode("items").alias("item"))
        .transform(lambda df: computed(df, doc_name=blank_to_null(F.col("item.name"))))
        .filter("doc_name is not null")
        .select(
            *_KEYS, "doc_name",
            blank_to_null(F.col("item.uri")).alias("doc_uri"),
            blank_to_null(F.col("item.doc_type")).alias("doc_type"),
            F.coalesce(blank_to_null(F.col("item.bucket")), F.col("group")).alias("bucket"),
            is_yes(F.col("item.is_marker")).alias("is_marker"),
        )
    )


def inventory_rows(good: DataFrame) -> DataFrame:
    """One row per named document; the bucket defaults to the group it is in."""
    return _inventory_rows(_listed(good, "_inventory"))


def _open_item_rows(lines: DataFrame) -> DataFrame:
    item = lambda name: F.col(f"item.{name}")
    return (
        lines.select(*_KEYS, "checklist_name", F.explode("_open_items").alias("item"))
        .select(
            *_KEYS, "checklist_name",
            *[blank_to_null(item(n)).alias(n) for n in ("label", "bucket", "status")],
            item("strict_count").alias("strict_count"), item("total_count").alias("total_count"),
        )
        .filter("label is not null and status is not null")
    )


def open_item_rows(good: DataFrame) -> DataFrame:
    """One row per checklist line that has a label and a status."""
    return _open_item_rows(_listed(good, "_open_items", checklist_name=text_at(F.col(_V), "$.checklist_name")))


# -- normalisation of loose summaries --------------------------------------


def _str(v: Column, path: str) -> Column:
    return F.coalesce(get(v, path, "string"), F.lit(""))


def _str_list(v: Column, path: str) -> Column:
    """Trimmed strings and numbers of a list; booleans and the rest dropped."""
    keep = lambda x: F.when(
        ~F.schema_of_variant(x).rlike("^(BOOLEAN|VOID|OBJECT|ARRAY)"), nonempty(strip(get(x, "$", "string")))
    )
    return F.coalesce(
        F.array_compact(F.transform(get(v, path, "array<variant>"), keep)), F.expr("cast(array() as array<string>)")
    )


def _enum(value: Column, allowed, default: str | None) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def _fact_confidence(v: Column) -> Column:
    return _enum(F.lower(get(v, "$.confidence", "string")), rules.FACT_CONFIDENCES, None)


def normalize_summary(loose: DataFrame, summary: str = "v", generated_at: Column | None = None) -> DataFrame:
    """Canonical summary columns of a loose summary object.

    ``loose`` carries the object as VARIANT in ``summary`` and the context in
    ``response_kind``, ``query``, ``sources`` (VARIANT list) and ``confidence``.
    Every contract key comes out, with safe defaults for absent or odd values.
    """
    v = F.col(summary)

    def facts(path, first, second, kind, second_null):
        def shape(x):
            a, b = strip(_str(x, f"$.{first}")), strip(_str(x, f"$.{second}"))
            pair = (nonempty(a) if second_null else a).alias(first), b.alias(second)
            return F.struct(*pair, _fact_confidence(x).alias("confidence"), _str_list(x, "$.sources").alias("sources"))

        both_empty = lambda x: (F.coalesce(x[first], F.lit("")) == "") & (x[second] == "")
        return F.coalesce(
            F.filter(F.transform(objects_at(v, path), shape), lambda x: ~both_empty(x)), F.expr(f"cast(array() as {kind})")
        )

    text = lambda c: F.coalesce(c, F.lit(""))
    objects = lambda c: F.filter(c, lambda x: x.isNotNull())

    def items(bucket, group):
        return F.transform(
            objects(group),
            lambda x: F.struct(
                text(x["name"]).alias("name"), text(x["uri"]).alias("uri"), text(x["doc_type"]).alias("doc_type"),
                bucket.alias("bucket"),
                truthy(x["is_marker"]).alias("is_marker"),
            ),
        )

    inventory = F.map_filter(
        F.transform_values(get(v, "$.document_inventory", f"map<string,array<{_LOOSE_ITEMS}>>"), items),
        lambda k, x: F.size(x) > 0,
    )
    open_items = F.transform(
        objects(get(v, "$.open_items", f"array<{_OPEN_ITEMS}>")),
        lambda x: F.struct(
            text(x["label"]).alias("label"), text(x["bucket"]).alias("bucket"),
            _enum(F.lower(text(x["status"])), rules.OPEN_ITEM_STATUSES, "not_found").alias("status"),
            F.coalesce(x["strict_count"], F.lit(0)).alias("strict_count"),
            F.coalesce(x["total_count"], F.lit(0)).alias("total_count"),
            F.coalesce(x["checklist_name"], F.lit("unknown")).alias("checklist_name"),
        ),
    )
    sources = F.transform(
        objects_at(F.col("sources"), "$"),
        lambda x: F.struct(
            _str(x, "$.title").alias("title"), _str(x, "$.uri").alias("uri"), _str(x, "$.subfolder").alias("subfolder")
        ),
    )
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if generated_at is None else generated_at
    carried = [c for c in loose.columns if c not in {summary, "response_kind", "query", "sources", "confidence"}]
    shaped = loose.select(
        *carried,
        F.lit(rules.SCHEMA_VERSION).alias("schema_version"),
        _enum(F.col("response_kind"), rules.RESPONSE_KINDS, "folder_summary").alias("response_kind"),
        now.alias("generated_at"),
        F.coalesce(F.col("query"), F.lit("")).alias("query"),
        _str(v, "$.folder_name").alias("folder_name"),
        _enum(get(v, "$.folder_purpose", "string"), rules.PURPOSES, "unknown").alias("folder_purpose"),
        _enum(get(v, "$.checklist_name", "string"), rules.CHECKLIST_NAMES, "unknown").alias("checklist_name"),
        F.coalesce(int_at(v, "$.file_count_total"), F.lit(0)).alias("file_count_total"),
        F.coalesce(int_at(v, "$.file_count_in_dossier"), F.lit(0)).alias("file_count_in_dossier"),
        _str(v, "$.overview").alias("overview"),
        facts("$.key_facts", "label", "value", FACT_TYPE, False).alias("key_facts"),
        facts("$.timeline", "date", "event", TIMELINE_TYPE, True).alias("timeline"),
        _str_list(v, "$.observations").alias("observations"),
        F.coalesce(inventory, F.expr(f"cast(map() as map<string,{ITEM_TYPE}>)")).alias("document_inventory"),
        F.coalesce(open_items, empty(OPEN_ITEM_TYPE)).alias("open_items"),
        F.coalesce(
            F.when(F.schema_of_variant(get(v, "$.show_open_items", "variant")) == "BOOLEAN",
                   get(v, "$.show_open_items", "boolean")), F.lit(False)
        ).alias("show_open_items"),
        F.coalesce(sources, empty(SOURCE_TYPE)).alias("sources"),
        nonempty(F.lower(F.col("confidence"))).alias("confidence"),
    )
    return computed(
        shaped,
        structured_fields=structured_fields(
            F.col("folder_name"), F.col("folder_purpose"), F.col("key_facts"), F.col("timeline"), F.col("open_items")
        ),
    )


# -- structured fields -----------------------------------------------------


def _triple(value: Column, confidence: Column, source: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), source.alias("source_file"))


def _null() -> Column:
    return F.lit(None).cast("string")


def facts_to_fields(key_facts: Column, label_rules=rules.FACT_LABEL_RULES) -> Column:
    """Map of field -> triple picked from the key facts.

    A fact goes to the first field, in rule order, that is still open and has a
    pattern for its label; the first fact of a field closes it. A filler value
    closes its field too, but leaves it empty (a triple of NULLs here).
    """
    state = f"map<string,{TRIPLE_TYPE}>"

    def open_field(acc: Column, label: Column) -> Column:
        cases = [
            (label.rlike(rx(any_of(patterns), True)) & ~F.map_contains_key(acc, F.lit(field)), F.lit(field))
            for field, patterns in label_rules
        ]
        return F.when(label != "", first_hit(cases))

    def fold(acc: Column, fact: Column) -> Column:
        label = F.lower(strip(F.coalesce(fact["label"], F.lit(""))))

        def grow(hit: Column) -> Column:
            value = nonempty(fact["value"])
            kept = _triple(value, fact["confidence"], F.get(fact["sources"], F.lit(0)))
            triple = F.when(~is_placeholder(hit, value), kept).otherwise(F.expr(f"cast(null as {TRIPLE_TYPE})"))
            return F.when(hit.isNotNull(), F.map_concat(acc, F.create_map(hit, triple))).otherwise(acc)

        return bind(bind(label, lambda text: open_field(acc, text)), grow)

    return F.aggregate(key_facts, F.expr(f"cast(map() as {state})"), fold)


def best_statuses(open_items: Column, buckets=rules.STATUS_FIELD_BUCKETS) -> dict[str, Column]:
    """Best status per status field over the checklist lines of its bucket."""
    out = {}
    for field, bucket in buckets.items():
        seen = F.transform(F.filter(open_items, lambda o: (o["bucket"] == bucket) & (o["status"] != "")), lambda o: o["status"])
        ranked = sorted(rules.STATUS_RANK, key=rules.STATUS_RANK.get, reverse=True)
        out[field] = bind(seen, lambda s: first_hit([(F.array_contains(s, status), F.lit(status)) for status in ranked]))
    return out


def timeline_dates(timeline: Column) -> dict[str, Column]:
    """Dated events that stand in for dates the key facts did not give."""
    dated = F.filter(timeline, lambda t: F.coalesce(t["date"], F.lit("")) != "")
    event = lambda t: F.coalesce(t["event"], F.lit(""))
    pick = lambda pattern: F.get(F.filter(dated, lambda t: event(t).rlike(rx(pattern, True))), F.lit(0))
    return {
        "appraisal_effective_date": F.coalesce(pick(rules.APPRAISAL_EVENT_STRICT), pick(rules.APPRAISAL_EVENT_ANY)),
        "inspection_date": F.get(F.filter(dated, lambda t: F.lower(event(t)).contains("inspection")), F.lit(0)),
    }


def structured_fields(folder_name: Column, purpose: Column, key_facts: Column, timeline: Column,
                      open_items: Column) -> Column:
    """Map of the 16 business fields, each a (value, confidence, source_file) triple.

    Folders of unknown purpose keep only their identity fields.
    """
    empty = _triple(_null(), _null(), _null())
    dates, statuses = timeline_dates(timeline), best_statuses(open_items)
    value = F.struct(
        nonempty(folder_name).alias("folder_name"), nonempty(purpose).alias("folder_purpose"),
        (F.coalesce(purpose, F.lit("")) != rules.UNKNOWN).alias("known"), facts_to_fields(key_facts).alias("facts"),
        *[c.alias(f"date_{f}") for f, c in dates.items()], *[c.alias(f) for f, c in statuses.items()],
    )

    def cell(v: Column, field: str) -> Column:
        if field in ("folder_name", "folder_purpose"):
            return F.when(v[field].isNotNull(), _triple(v[field], F.lit("high"), _null()))
        if field in statuses:
            return F.when(v["known"] & v[field].isNotNull(), _triple(v[field], F.lit("high"), _null()))
        fact = F.try_element_at(v["facts"], F.lit(field))
        if field not in dates:
            return F.when(v["known"], fact)
        dated = v[f"date_{field}"]
        stand_in = F.when(
            dated.isNotNull(), _triple(dated["date"], dated["confidence"], F.get(dated["sources"], F.lit(0)))
        )
        return F.when(v["known"], F.when(fact["value"].isNotNull(), fact).otherwise(F.coalesce(stand_in, fact)))

    def body(v: Column) -> Column:
        entries = [x for f in rules.FIELD_NAMES for x in (F.lit(f), F.coalesce(cell(v, f), empty))]
        return F.create_map(*entries)

    return bind(value, body)


# -- contract check --------------------------------------------------------


def conformance(parsed: DataFrame, expected_kind: Column | None = None) -> DataFrame:
    """Contract report per event object ``v``: ok, failures, missing and extra keys."""
    v = F.col(_V)
    parsed = computed(parsed.filter("v is not null"), _keys=F.map_keys(get(v, "$", "map<string,variant>")))
    keys = F.col("_keys")
    contract = F.array(*[F.lit(k) for k in rules.EVENT_KEYS])
    missing, extra = F.array_except(contract, keys), F.array_except(keys, contract)
    kind = get(v, "$.response_kind", "string")
    kind_ok = kind.isin(*rules.RESPONSE_KINDS) if expected_kind is None else kind.eqNullSafe(expected_kind)
    stamp = F.coalesce(get(v, "$.generated_at", "string"), F.lit(""))

    shape = lambda names: "struct<" + ",".join(f"{n}:variant" for n in names) + ">"
    # A key that is there with null is a VARIANT; an item that is no object has no key.
    short_of = lambda x, names: reduce(or_, [x[n].isNull() for n in names])

    def lacks(path: str, needed: tuple[str, ...]) -> Column:
        """Some list item is no object or lacks a key."""
        return F.exists(F.coalesce(get(v, path, f"array<{shape(needed)}>"), F.expr(f"cast(array() as array<{shape(needed)}>)")), lambda x: short_of(x, needed))

    item_want = ("name", "uri", "doc_type", "bucket")
    groups = F.map_entries(get(v, "$.document_inventory", f"map<string,array<{shape(item_want)}>>"))
    bad_group = lambda e: F.coalesce(
        F.exists(
            e["value"],
            lambda x: short_of(x, item_want) | ~F.coalesce(get(x["bucket"], "$", "string") == e["key"], F.lit(False)),
        ),
        F.lit(True),
    )
    bad_status = F.exists(
        F.coalesce(get(v, "$.open_items", "array<struct<status:string>>"), F.expr("cast(array() as array<struct<status:string>>)")),
        lambda x: ~F.coalesce(x["status"].isin(*rules.OPEN_ITEM_STATUSES), F.lit(False)),
    )
    sf = get(v, "$.structured_fields", "map<string,variant>")
    sf_missing = F.size(F.array_except(F.array(*[F.lit(f) for f in rules.FIELD_NAMES]), F.map_keys(sf)))
    triple = F.array(F.lit("confidence"), F.lit("source_file"), F.lit("value"))
    bad_triple = F.exists(
        F.map_values(sf),
        lambda x: ~F.coalesce(F.array_sort(F.map_keys(get(x, "$", "map<string,variant>"))) == triple, F.lit(False)),
    )
    checks = [
        ("missing keys", F.size(missing) > 0),
        ("schema_version", ~get(v, "$.schema_version", "string").eqNullSafe(F.lit(rules.SCHEMA_VERSION))),
        ("response_kind", ~F.coalesce(kind_ok, F.lit(False))),
        ("generated_at", ~((F.length(stamp) >= 19) & stamp.endswith("Z"))),
        ("folder_purpose", ~F.coalesce(get(v, "$.folder_purpose", "string").isin(*rules.PURPOSES), F.lit(False))),
        ("checklist_name", ~F.coalesce(get(v, "$.checklist_name", "string").isin(*rules.CHECKLIST_NAMES), F.lit(False))),
        ("key_facts", lacks("$.key_facts", ("label", "value", "confidence", "sources"))),
        ("timeline", lacks("$.timeline", ("date", "event", "confidence", "sources"))),
        ("document_inventory", F.coalesce(F.exists(groups, bad_group), F.lit(False))),
        ("open_items", lacks("$.open_items", ("label", "bucket", "status", "strict_count", "total_count", "checklist_name"))),
        ("open_items status", bad_status),
        ("sources", lacks("$.sources", ("title", "uri", "subfolder"))),
        ("structured_fields", F.coalesce(sf_missing > 0, F.lit(True)) | F.coalesce(bad_triple, F.lit(False))),
    ]
    failures = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return parsed.select(
        "line", missing.alias("missing"), extra.alias("extra"), failures.alias("failures"),
        (F.size(failures) == 0).alias("ok"),
    )
