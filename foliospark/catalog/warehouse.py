"""Registered queries: event log, warehouse load and warehouse questions."""

from pyspark.sql import functions as F

from ..functions.values import event_id, parse_ts
from ..plans import event_rows as ER
from ..plans import queries as Q
from ..plans import warehouse as W
from ..session import cut
from ..sources import events_log as L
from .base import EVENTS_SQL, FIELDS_SQL, ITEMS_SQL, KIND_SQL, PURPOSE_SQL, events, fields, items, order_views, query, run_dir, table, views

col = F.col

E, I, FL = f"({EVENTS_SQL}) e", f"({ITEMS_SQL}) i", f"({FIELDS_SQL}) f"
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"

# -- questions --------------------------------------------------------------

RANKED = "SELECT *, row_number() OVER (PARTITION BY folder_key ORDER BY generated_at DESC, event_id) AS rn FROM {0} WHERE {1}"
SUMMARY = RANKED.format(E, "response_kind = 'folder_summary'")
STATE = ["folder_purpose", "contract_status", "inspection_status", "file_count_total"]


@query("q1_latest_state", f"SELECT folder_key, {', '.join(STATE)}, {ISO.format('generated_at')} AS generated_at FROM ({SUMMARY}) r WHERE rn = 1")
def _(spark, sf):
    return Q.latest_state(events(spark, sf), cols=STATE)


@query("q2_purpose_counts", f"SELECT folder_purpose, count(*) AS folder_count FROM ({SUMMARY}) r WHERE rn = 1 GROUP BY 1")
def _(spark, sf):
    return Q.purpose_counts(events(spark, sf))


LATEST = f"SELECT folder_key, max(generated_at) AS latest_at FROM {E} WHERE response_kind = 'folder_summary' GROUP BY 1"
LATEST_ITEMS = f"SELECT folder_key, max(generated_at) AS latest_at FROM {E} WHERE response_kind IN ('folder_summary', 'open_items_only') GROUP BY 1"
AT = "JOIN ({0}) l ON l.folder_key = {1}.folder_key AND l.latest_at = {1}.generated_at"


@query("q3_open_item_distribution", f"SELECT label, status, count(*) AS n FROM {I} {AT.format(LATEST_ITEMS, 'i')} GROUP BY 1, 2")
def _(spark, sf):
    return Q.open_item_distribution(events(spark, sf), items(spark, sf))


@query(
    "q4_field_population",
    f"""SELECT field_name, count(*) AS folders_with_value, (SELECT count(*) FROM ({LATEST}) t) AS total_folders,
      round(100.0 * count(*) / (SELECT count(*) FROM ({LATEST}) t), 1) AS pct FROM {FL} {AT.format(LATEST, 'f')} GROUP BY 1""",
)
def _(spark, sf):
    return Q.field_population(events(spark, sf), fields(spark, sf))


@query(
    "q5_marker_inventory",
    f"""SELECT i.folder_key, count(*) AS total_docs, count(*) FILTER (WHERE is_marker) AS marker_docs, count(*) FILTER (WHERE NOT is_marker) AS text_docs
    FROM {I} {AT.format(LATEST, 'i')} GROUP BY 1""",
)
def _(spark, sf):
    return Q.marker_inventory(events(spark, sf), items(spark, sf))


TODAY = "DATE '1998-06-30'"


@query(
    "q6_latest_state_90_days",
    f"""SELECT folder_key, {', '.join(STATE)}, {ISO.format('generated_at')} AS generated_at FROM (
      {RANKED.format(E, f"response_kind = 'folder_summary' AND CAST(generated_at AS DATE) >= {TODAY} - INTERVAL 90 DAY")}) r WHERE rn = 1""",
)
def _(spark, sf):
    return Q.latest_state_recent(events(spark, sf), F.lit("1998-06-30").cast("date"), cols=STATE)


@query(
    "q7_folders_with_open_items",
    f"""SELECT i.folder_key, count(*) FILTER (WHERE status = 'not_found') AS not_found_count, count(*) FILTER (WHERE status = 'needs_review') AS needs_review_count,
      string_agg(label || '=' || status, ',' ORDER BY label, status) AS items FROM {I} {AT.format(LATEST_ITEMS, 'i')} GROUP BY 1
    HAVING count(*) FILTER (WHERE status = 'not_found') > 0 OR count(*) FILTER (WHERE status = 'needs_review') > 0""",
)
def _(spark, sf):
    found = Q.folders_with_open_items(events(spark, sf), items(spark, sf))
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws("=", x["label"], x["status"])), ","))


@query("q8_purpose_counts_all_kinds", f"SELECT folder_purpose, count(*) AS folder_count FROM ({RANKED.format(E, 'true')}) r WHERE rn = 1 GROUP BY 1")
def _(spark, sf):
    return Q.purpose_counts(events(spark, sf), kinds=None)


@query("q9_all_fields_latest", f"SELECT f.folder_key, field_name, field_value, confidence, source_file FROM {FL} {AT.format(LATEST, 'f')}")
def _(spark, sf):
    return Q.all_fields_latest(events(spark, sf), fields(spark, sf))


@query(
    "q10_field_population_by_day",
    f"SELECT strftime(generated_at, '%Y-%m-%d') AS day, field_name, count(DISTINCT event_id) AS rows_with_value FROM {FL} GROUP BY 1, 2",
)
def _(spark, sf):
    return Q.field_population_by_day(fields(spark, sf)).withColumn("day", col("day").cast("string"))


CHANGES = """WITH p AS (SELECT event_id, folder_key, {ts} AS stamp, {a} AS a, {b} AS b,
    lag({a}) OVER w AS pa, lag({b}) OVER w AS pb FROM {src} WHERE {cond} WINDOW w AS (PARTITION BY folder_key ORDER BY generated_at, event_id))
  SELECT event_id, folder_key, stamp AS generated_at, a AS contract_status, b AS inspection_status, pa AS prev_contract_status, pb AS prev_inspection_status
  FROM p WHERE a IS DISTINCT FROM pa OR b IS DISTINCT FROM pb"""


@query(
    "q11_status_changes",
    CHANGES.format(ts=ISO.format("generated_at"), a="contract_status", b="inspection_status", src=E, cond="response_kind = 'folder_summary'"),
)
def _(spark, sf):
    changed = Q.status_changes(events(spark, sf))
    return changed.withColumn("generated_at", F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@query(
    "w2_previous_value",
    """SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_event_type FROM events""",
)
def _(spark, sf):
    return Q.with_previous(table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", "ts", "event_id", ["event_type"]).drop("ts")


@query("f8_null_safe_change", f"SELECT event_id FROM {E} WHERE contract_status IS DISTINCT FROM inspection_status")
def _(spark, sf):
    return events(spark, sf).filter(~col("contract_status").eqNullSafe(col("inspection_status"))).select("event_id")


@query("w1_latest_row", f"SELECT folder_key, event_id FROM ({RANKED.format(E, 'true')}) r WHERE rn = 1")
def _(spark, sf):
    return Q.latest_rows(events(spark, sf), "folder_key", "generated_at", "event_id").select("folder_key", "event_id")


@query(
    "q12_latest_views",
    f"""SELECT 'event' AS view_name, folder_key, event_id, concat_ws('|', response_kind, {ISO.format('generated_at')}, total, confidence) AS detail FROM ({SUMMARY}) r WHERE rn = 1
    UNION ALL SELECT 'state', folder_key, NULL, concat_ws('|', folder_purpose, coalesce(contract_status, '-'), coalesce(inspection_status, '-'), file_count_total, {ISO.format('generated_at')}) FROM ({SUMMARY}) r WHERE rn = 1
    UNION ALL SELECT 'open_items', i.folder_key, event_id, concat_ws('|', line_no, label, coalesce(status, '-'), doc_name) FROM {I} {AT.format(LATEST_ITEMS, 'i')}""",
)
def _(spark, sf):
    Q.register_latest_views(events(spark, sf), items(spark, sf), cols=STATE)
    stamp = "date_format(generated_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    return spark.sql(
        f"""SELECT 'event' AS view_name, folder_key, event_id, concat_ws('|', response_kind, {stamp}, total, confidence) AS detail FROM latest_event
        UNION ALL SELECT 'state', folder_key, NULL, concat_ws('|', folder_purpose, coalesce(contract_status, '-'), coalesce(inspection_status, '-'), file_count_total, generated_at) FROM latest_state
        UNION ALL SELECT 'open_items', folder_key, event_id, concat_ws('|', line_no, label, coalesce(status, '-'), doc_name) FROM latest_open_items"""
    )


@query("j2_child_at_latest", f"SELECT event_id, line_no FROM {I} {AT.format(LATEST, 'i')}")
def _(spark, sf):
    last = Q.latest_times(Q.of_kinds(events(spark, sf), Q.SUMMARY_KINDS), "folder_key", "generated_at")
    return Q.at_latest(items(spark, sf), last, "folder_key", "generated_at").select("event_id", "line_no")


@query(
    "j3_scalar_beside_aggregate",
    "SELECT o_orderpriority, count(*) AS n, (SELECT count(*) FROM orders) AS total FROM orders GROUP BY 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumn("total", o.agg(F.count("*").alias("t")).scalar())


# -- the log ----------------------------------------------------------------


def event_lines(spark, sf, day="o_orderdate"):
    """Log lines of the orders with their line items, some broken or blank."""
    order_views(spark, sf)
    objects = spark.sql(
        f"""
        WITH e AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, {KIND_SQL} AS kind, {PURPOSE_SQL} AS purpose,
            date_format({day}, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS stamp FROM orders),
          l AS (SELECT l_orderkey, collect_list(named_struct('n', l_linenumber, 'p', l_partkey, 'r', l_returnflag, 's', l_linestatus)) AS li FROM lineitem GROUP BY 1),
          i AS (SELECT l_orderkey,
              transform(li, x -> named_struct('name', CASE WHEN x.n = 5 THEN NULL ELSE concat('doc ', x.p) END, 'uri', concat('u/', x.p),
                'doc_type', x.r, 'is_marker', CASE x.r WHEN 'R' THEN 'true' WHEN 'N' THEN 'false' END, 'flag', x.r)) AS docs,
              transform(li, x -> named_struct('label', concat('item ', x.r), 'bucket', x.r,
                'status', CASE x.s WHEN 'F' THEN 'found' WHEN 'O' THEN CASE WHEN x.n = 6 THEN NULL ELSE 'not_found' END END,
                'strict_count', x.n, 'total_count', concat('', x.n + 1))) AS open_items FROM l)
        SELECT o_orderkey, named_struct('schema_version', '1.1', 'response_kind', kind, 'generated_at', CASE WHEN o_orderkey % 50 = 7 THEN 'soon' ELSE stamp END,
            'query', concat('order ', o_orderkey), 'folder_name', concat('F', o_custkey), 'folder_purpose', purpose, 'checklist_name', 'claim_default',
            'file_count_total', o_orderkey % 40, 'file_count_in_dossier', concat('', o_orderkey % 20), 'overview', ' ', 'show_open_items', o_orderkey % 2 = 0,
            'key_facts', array(named_struct('label', 'Estimate total', 'value', concat('', CAST(floor(o_totalprice) AS BIGINT)), 'confidence', 'high', 'sources', array('a.pdf', ''))),
            'observations', array('seen', ' ', concat('o', o_orderkey)),
            'document_inventory', map_from_entries(transform(array('A', 'N', 'R'), k -> struct(k, transform(filter(docs, d -> d.flag = k), d -> named_struct('name', d.name, 'uri', d.uri, 'doc_type', d.doc_type, 'is_marker', d.is_marker))))),
            'open_items', open_items,
            'structured_fields', named_struct('estimate_total', named_struct('value', CAST(floor(o_totalprice) AS BIGINT), 'confidence', 'high', 'source_file', 'a.pdf'),
              'contract_status', named_struct('value', CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE o_orderstatus END, 'confidence', CAST(NULL AS STRING), 'source_file', CAST(NULL AS STRING)),
              'claim_number', named_struct('value', CAST(NULL AS STRING), 'confidence', 'low', 'source_file', CAST(NULL AS STRING)))) AS obj
        FROM e LEFT JOIN i ON l_orderkey = o_orderkey
        """
    )
    body = F.to_json("obj", {"ignoreNullFields": "false"})
    key = col("o_orderkey")
    line = F.when(key % 50 == 3, "not json").when(key % 50 == 13, "[1, 2]").when(key % 50 == 23, "   ").otherwise(F.concat(F.lit("  "), body))
    return objects.select(line.alias("value"))


def good_lines(spark, sf, start=None):
    return ER.with_event_id(L.split_lines(L.parse_lines(event_lines(spark, sf)), start)[0])


MONTH = "date_trunc('month', o_orderdate)"
OK = "o_orderkey % 50 NOT IN (3, 13, 23)"
DATED = "o_orderkey % 50 NOT IN (3, 13, 23, 7)"
STAMP = f"CASE WHEN o_orderkey % 50 = 7 THEN 'soon' ELSE {ISO.format('o_orderdate')} END"
EID = f"substr(sha256(concat('F', o_custkey, '|', {STAMP}, '|', {KIND_SQL}, '|order ', o_orderkey)), 1, 32)"


@query(
    "s2_read_events",
    f"""SELECT 'good' AS kind, count(*) FILTER (WHERE {OK}) AS n, count(*) FILTER (WHERE {DATED} AND o_orderdate >= TIMESTAMP '1998-01-01') AS recent FROM orders
    UNION ALL SELECT 'bad', count(*) FILTER (WHERE o_orderkey % 50 IN (3, 13)), 0 FROM orders""",
)
def _(spark, sf):
    lines = L.parse_lines(event_lines(spark, sf))
    good, bad = L.split_lines(lines)
    recent = F.count_if(L.since(col("generated_ts"), "1998-01-01"))
    return good.agg(F.count("*").alias("n"), recent.alias("recent")).select(F.lit("good").alias("kind"), "n", "recent").unionByName(
        bad.agg(F.count("*").alias("n")).select(F.lit("bad").alias("kind"), "n", F.lit(0).cast("bigint").alias("recent"))
    )


@query(
    "s5_name_list",
    "SELECT name, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS name FROM documents) l WHERE name <> '' AND name NOT LIKE '#%' GROUP BY 1",
)
def _(spark, sf):
    path = run_dir(spark, "names")
    table(spark, sf, "documents").select("text").write.text(path)
    return L.read_name_list(spark, path).groupBy("name").agg(F.count("*").alias("n"))


_TS_FORMS = """CASE o_orderkey % 6 WHEN 0 THEN concat(d, 'T10:20:30Z') WHEN 1 THEN concat(d, 'T10:20:30.250Z') WHEN 2 THEN concat(d, 'T10:20:30+02:00')
  WHEN 3 THEN concat(d, ' 10:20:30') WHEN 4 THEN d ELSE concat('on ', d) END"""


@query(
    "e1_parse_time",
    f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(d, 'T10:20:30.000') WHEN 1 THEN concat(d, 'T10:20:30.250') WHEN 2 THEN concat(d, 'T08:20:30.000')
      WHEN 3 THEN concat(d, 'T10:20:30.000') WHEN 4 THEN concat(d, 'T00:00:00.000') END AS at FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) o""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return o.select("o_orderkey", F.date_format(parse_ts(F.expr(_TS_FORMS)), "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("at"))


@query(
    "e2_event_id",
    """SELECT o_orderkey, substr(sha256(concat('F', o_custkey, '|', strftime(o_orderdate, '%Y-%m-%d'), '|', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END, '|q')), 1, 32) AS event_id FROM orders""",
)
def _(spark, sf):
    kind = F.when(col("o_orderkey") % 3 != 0, F.concat(F.lit(" "), "o_orderpriority"))
    folder = F.concat(F.lit("F"), "o_custkey", F.lit("  "))
    return table(spark, sf, "orders").select(
        "o_orderkey", event_id(folder, F.date_format("o_orderdate", "yyyy-MM-dd"), kind, F.lit("q")).alias("event_id")
    )


_LOOSE = """concat('{"a":', CASE event_id % 6 WHEN 0 THEN concat('"', event_id, '"') WHEN 1 THEN concat('', event_id) WHEN 2 THEN '" "' WHEN 3 THEN 'null' WHEN 4 THEN 'false' ELSE '"No"' END, '}')"""


@query(
    "e3_coercions",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('', event_id) WHEN 1 THEN concat('', event_id) WHEN 4 THEN 'false' WHEN 5 THEN 'No' END AS as_text,
      CASE WHEN event_id % 6 IN (0, 1) THEN event_id WHEN event_id % 6 = 4 THEN 0 END AS as_int, (event_id % 6 IN (0, 1) AND event_id <> 0) AS as_bool FROM events""",
)
def _(spark, sf):
    from ..functions.values import bool_at, int_at, text_at

    v = table(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(_LOOSE)).alias("v"))
    return v.select("event_id", text_at(col("v"), "$.a").alias("as_text"), int_at(col("v"), "$.a").alias("as_int"), bool_at(col("v"), "$.a").alias("as_bool"))


@query(
    "e5_event_rows",
    f"""SELECT {EID} AS event_id, {ISO.format('o_orderdate')} AS generated_at, {KIND_SQL} AS response_kind, concat('F', o_custkey) AS folder_key, {PURPOSE_SQL} AS folder_purpose,
      concat('order ', o_orderkey) AS query, o_orderkey % 2 = 0 AS show_open_items, o_orderkey % 40 AS file_count_total, o_orderkey % 20 AS file_count_in_dossier,
      CAST(NULL AS VARCHAR) AS overview, concat('seen,o', o_orderkey) AS observations, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS contract_status,
      'a.pdf' AS fact_sources FROM orders WHERE {DATED}""",
)
def _(spark, sf):
    r = ER.event_rows(good_lines(spark, sf))
    return r.select(
        "event_id", F.date_format("generated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), "response_kind", "folder_key", "folder_purpose", "query",
        "show_open_items", "file_count_total", "file_count_in_dossier", "overview", F.array_join("observations", ",").alias("observations"), "contract_status",
        F.array_join(col("key_facts")[0]["sources"], ",").alias("fact_sources"),
    )


@query(
    "e6_field_rows",
    f"""SELECT {EID} AS event_id, 'estimate_total' AS field_name, concat('', CAST(floor(o_totalprice) AS BIGINT)) AS field_value, 'high' AS confidence, 'a.pdf' AS source_file FROM orders WHERE {DATED}
    UNION ALL SELECT {EID}, 'contract_status', CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END, NULL, NULL FROM orders WHERE {DATED} AND o_orderkey % 3 <> 0""",
)
def _(spark, sf):
    return ER.field_rows(good_lines(spark, sf)).drop("generated_at", "folder_key")


@query(
    "e7_inventory_rows",
    f"""SELECT {EID} AS event_id, concat('doc ', l_partkey) AS doc_name, concat('u/', l_partkey) AS doc_uri, l_returnflag AS doc_type, l_returnflag AS bucket, l_returnflag = 'R' AS is_marker
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {DATED} AND l_linenumber <> 5""",
)
def _(spark, sf):
    return ER.inventory_rows(good_lines(spark, sf)).drop("generated_at", "folder_key")


@query(
    "e8_open_item_rows",
    f"""SELECT {EID} AS event_id, concat('item ', l_returnflag) AS label, l_returnflag AS bucket, CASE l_linestatus WHEN 'F' THEN 'found' ELSE 'not_found' END AS status,
      CAST(l_linenumber AS BIGINT) AS strict_count, CAST(l_linenumber + 1 AS BIGINT) AS total_count
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {DATED} AND NOT (l_linestatus = 'O' AND l_linenumber = 6)""",
)
def _(spark, sf):
    return ER.open_item_rows(good_lines(spark, sf)).drop("generated_at", "folder_key", "checklist_name")


# -- normalisation and fields ----------------------------------------------


def loose(spark, sf):
    return L.split_lines(L.parse_lines(event_lines(spark, sf)))[0].select(
        F.variant_get("v", "$.query", "string").alias("query"), F.variant_get("v", "$.response_kind", "string").alias("response_kind"),
        F.lit("HIGH").alias("confidence"), F.try_parse_json(F.lit('[{"title":"T"},3]')).alias("sources"), "v",
    )


@query(
    "e4_normalize_summary",
    f"""WITH l AS (SELECT l_orderkey,
        string_agg(concat_ws('|', concat('item ', l_returnflag), l_returnflag, CASE l_linestatus WHEN 'F' THEN 'found' ELSE 'not_found' END, l_linenumber, l_linenumber + 1, 'unknown'), ',' ORDER BY
          concat_ws('|', concat('item ', l_returnflag), l_returnflag, CASE l_linestatus WHEN 'F' THEN 'found' ELSE 'not_found' END, l_linenumber, l_linenumber + 1, 'unknown')) AS open_items,
        string_agg(item, ',' ORDER BY item) AS inventory
      FROM (SELECT *, concat_ws('|', l_returnflag, CASE WHEN l_linenumber = 5 THEN '' ELSE concat('doc ', l_partkey) END, concat('u/', l_partkey), l_returnflag, l_returnflag,
          CASE WHEN l_returnflag = 'A' THEN 'false' ELSE 'true' END) AS item FROM lineitem) x GROUP BY 1)
    SELECT concat('order ', o_orderkey) AS query, {KIND_SQL} AS response_kind, {PURPOSE_SQL} AS folder_purpose, 'claim_default' AS checklist_name, o_orderkey % 40 AS file_count_total,
      o_orderkey % 20 AS file_count_in_dossier, o_orderkey % 2 = 0 AS show_open_items, 'high' AS confidence, concat('seen,o', o_orderkey) AS observations,
      concat('Estimate total|', CAST(floor(o_totalprice) AS BIGINT), '|high|a.pdf') AS key_facts, coalesce(open_items, '') AS open_items, coalesce(inventory, '') AS inventory, 'T||' AS sources,
      concat(CASE WHEN {PURPOSE_SQL} <> 'unknown' THEN concat('estimate_total=', CAST(floor(o_totalprice) AS BIGINT), '|high|a.pdf,') ELSE '' END,
        'folder_name=F', o_custkey, '|high|-,folder_purpose=', {PURPOSE_SQL}, '|high|-') AS fields, 16 AS n_fields
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE {OK}""",
)
def _(spark, sf):
    n = ER.normalize_summary(loose(spark, sf))
    joined = lambda rows: F.array_join(F.array_sort(rows), ",")
    of = lambda c, *names: F.transform(c, lambda x: F.concat_ws("|", *[x[k].cast("string") for k in names]))
    inventory = F.flatten(F.transform(F.map_entries("document_inventory"), lambda g: F.transform(
        g["value"], lambda x: F.concat_ws("|", g["key"], *[x[k].cast("string") for k in ("name", "uri", "doc_type", "bucket", "is_marker")]))))
    facts_of = F.transform("key_facts", lambda x: F.concat_ws("|", x["label"], x["value"], x["confidence"], F.array_join(x["sources"], ";")))
    filled = F.filter(F.map_entries("structured_fields"), lambda e: e["value"]["value"].isNotNull())
    triples = F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), F.concat_ws("|", *[F.coalesce(e["value"][k], F.lit("-")) for k in ("value", "confidence", "source_file")])))
    return n.select(
        "query", "response_kind", "folder_purpose", "checklist_name", "file_count_total", "file_count_in_dossier", "show_open_items", "confidence",
        F.array_join("observations", ",").alias("observations"), joined(facts_of).alias("key_facts"),
        joined(of("open_items", "label", "bucket", "status", "strict_count", "total_count", "checklist_name")).alias("open_items"),
        joined(inventory).alias("inventory"), joined(of("sources", "title", "uri", "subfolder")).alias("sources"), joined(triples).alias("fields"),
        F.size("structured_fields").alias("n_fields"),
    )


# Facts of an order: one per line item, in line order; labels fall on two rules.
FACT_LABEL = "CASE l_linenumber % 4 WHEN 0 THEN 'Claim Number' WHEN 1 THEN 'Scope estimate total' WHEN 2 THEN 'Estimate amount' ELSE 'Invoice total' END"
FACT_VALUE = "CASE WHEN l_quantity < 10 THEN 'N/A' ELSE concat('v', l_partkey) END"
_FACTS = f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {FACT_VALUE} AS value,
  CASE l_linenumber % 4 WHEN 0 THEN 'claim_number' WHEN 3 THEN 'invoice_total' ELSE 'estimate_total' END AS field FROM lineitem"""


def facts(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct(
        "l_linenumber", "l_partkey", "l_quantity", F.expr(FACT_LABEL).alias("label"), F.expr(FACT_VALUE).alias("value"), F.lit("high").alias("confidence"),
        F.array(F.concat(F.lit("s"), "l_partkey")).alias("sources")).alias("f"))
    grouped = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    return grouped.select("l_orderkey", F.transform("fs", lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value"), f["confidence"].alias("confidence"), f["sources"].alias("sources"))).alias("key_facts"))


@query(
    "e14_fields_from_facts",
    f"""SELECT l_orderkey, field, CASE WHEN value <> 'N/A' THEN value END AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, field ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM ({_FACTS}) a) b WHERE rn = 1""",
)
def _(spark, sf):
    f = facts(spark, sf).select("l_orderkey", F.explode(ER.facts_to_fields(col("key_facts"))).alias("field", "t"))
    return f.select("l_orderkey", "field", col("t.value").alias("value"))


@query(
    "e15_timeline_dates",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS d, CASE l_returnflag WHEN 'A' THEN 'Invoice for appraisal' WHEN 'N' THEN 'Appraisal completed' ELSE 'Site Inspection' END AS event FROM lineitem WHERE l_linenumber % 3 <> 0),
      a AS (SELECT l_orderkey, arg_min(d, struct_pack(p := CASE WHEN event = 'Appraisal completed' THEN 0 ELSE 1 END, n := l_linenumber, k := l_partkey, d := d)) AS appraisal FROM t WHERE event <> 'Site Inspection' GROUP BY 1),
      i AS (SELECT l_orderkey, arg_min(d, struct_pack(n := l_linenumber, k := l_partkey, d := d)) AS inspection FROM t WHERE event = 'Site Inspection' GROUP BY 1)
    SELECT k.l_orderkey, appraisal, inspection FROM (SELECT DISTINCT l_orderkey FROM lineitem) k LEFT JOIN a USING (l_orderkey) LEFT JOIN i USING (l_orderkey)""",
)
def _(spark, sf):
    event = F.expr("CASE l_returnflag WHEN 'A' THEN 'Invoice for appraisal' WHEN 'N' THEN 'Appraisal completed' ELSE 'Site Inspection' END")
    date = F.when(col("l_linenumber") % 3 != 0, F.date_format("l_shipdate", "yyyy-MM-dd"))
    li = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", date.alias("date"), event.alias("event"), F.lit("high").alias("confidence"), F.array(F.lit("s")).alias("sources")).alias("t"))
    dates = ER.timeline_dates(col("timeline"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("t")).alias("timeline")).select(
        "l_orderkey", dates["appraisal_effective_date"]["date"].alias("appraisal"), dates["inspection_date"]["date"].alias("inspection"))


@query(
    "e16_status_fields",
    """SELECT l_orderkey, max(CASE WHEN l_returnflag = 'A' THEN r END) AS contract, max(CASE WHEN l_returnflag = 'N' THEN r END) AS insurance, max(CASE WHEN l_returnflag = 'R' THEN r END) AS photos
    FROM (SELECT l_orderkey, l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS r FROM lineitem) a GROUP BY 1""",
)
def _(spark, sf):
    bucket = F.expr("CASE l_returnflag WHEN 'A' THEN 'contract' WHEN 'N' THEN 'insurance' ELSE 'photos' END")
    status = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'found' WHEN 1 THEN 'needs_review' ELSE 'not_found' END")
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(bucket.alias("bucket"), status.alias("status"))).alias("oi"))
    best = ER.best_statuses(col("oi"))
    rank = lambda c: F.expr("CASE x WHEN 'found' THEN 2 WHEN 'needs_review' THEN 1 WHEN 'not_found' THEN 0 END".replace("x", c))
    return g.select("l_orderkey", best["contract_status"].alias("c"), best["insurance_status"].alias("i"), best["photos_status"].alias("p")).select(
        "l_orderkey", rank("c").alias("contract"), rank("i").alias("insurance"), rank("p").alias("photos"))


@query(
    "e17_unknown_keeps_identity",
    f"""WITH f AS (SELECT l_orderkey, field, value, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, field ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM ({_FACTS}) a) b WHERE rn = 1 AND value <> 'N/A'),
    p AS (SELECT o_orderkey, o_custkey, {PURPOSE_SQL} AS purpose FROM orders),
    e AS (SELECT o_orderkey, concat('folder_name=F', o_custkey, '|high|-') AS e FROM p UNION ALL SELECT o_orderkey, concat('folder_purpose=', purpose, '|high|-') FROM p
      UNION ALL SELECT o_orderkey, concat(field, '=', value, '|high|s', l_partkey) FROM p JOIN f ON l_orderkey = o_orderkey WHERE purpose <> 'unknown')
    SELECT o_orderkey, string_agg(e, ',' ORDER BY e) AS filled FROM e GROUP BY 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("F"), "o_custkey").alias("folder"), F.expr(PURPOSE_SQL).alias("purpose"))
    j = o.join(facts(spark, sf), col("l_orderkey") == col("o_orderkey"), "left")
    key_facts = F.coalesce(col("key_facts"), F.expr(f"cast(array() as {ER.FACT_TYPE})"))
    none = lambda t: F.expr(f"cast(array() as {t})")
    fields_of = ER.structured_fields(col("folder"), col("purpose"), key_facts, none(ER.TIMELINE_TYPE), none(ER.OPEN_ITEM_TYPE))
    filled = F.filter(F.map_entries(fields_of), lambda e: e["value"]["value"].isNotNull())
    cells = F.transform(filled, lambda e: F.concat(e["key"], F.lit("="), F.concat_ws("|", *[F.coalesce(e["value"][k], F.lit("-")) for k in ("value", "confidence", "source_file")])))
    return j.select("o_orderkey", F.array_join(F.array_sort(cells), ",").alias("filled"))


@query(
    "e18_conformance",
    f"""SELECT concat('order ', o_orderkey) AS query, 'confidence,sources,timeline' AS missing,
      array_to_string(list_filter(['missing keys', CASE WHEN o_orderkey % 50 = 7 THEN 'generated_at' END, 'document_inventory',
        CASE WHEN has_lines THEN 'open_items' END, CASE WHEN coalesce(no_status, false) THEN 'open_items status' END, 'structured_fields'], lambda x: x IS NOT NULL), ',') AS failures
    FROM (SELECT o_orderkey, l_orderkey IS NOT NULL AS has_lines, no_status FROM orders LEFT JOIN
      (SELECT l_orderkey, bool_or(l_linestatus = 'O' AND l_linenumber = 6) AS no_status FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey) a WHERE {OK}""",
)
def _(spark, sf):
    good = L.split_lines(L.parse_lines(event_lines(spark, sf)))[0]
    report = ER.conformance(good)
    return report.select(
        F.get_json_object("line", "$.query").alias("query"), F.array_join(F.array_sort("missing"), ",").alias("missing"), F.array_join("failures", ",").alias("failures"))


@query(
    "u6_key_difference",
    f"""SELECT concat('order ', o_orderkey) AS query,
      array_to_string(list_sort(list_filter(['confidence', 'sources', 'timeline', CASE WHEN o_orderkey % 3 = 0 THEN 'overview' END, CASE WHEN o_orderkey % 4 = 1 THEN 'checklist_name' END,
        CASE WHEN o_orderkey % 6 = 2 THEN 'observations' END], lambda x: x IS NOT NULL)), ',') AS missing,
      array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'summary' END, CASE WHEN o_orderkey % 4 = 1 THEN 'checklist' END, CASE WHEN o_orderkey % 5 = 0 THEN 'debug' END],
        lambda x: x IS NOT NULL)), ',') AS extra FROM orders WHERE {OK}""",
)
def _(spark, sf):
    # Keys are renamed, added and left out in the lines of some orders.
    value, key = col("value"), F.regexp_extract("value", r'"query":"order (\d+)"', 1).try_cast("long")
    for cond, old, new in (
        (key % 3 == 0, '"overview":', '"summary":'), (key % 4 == 1, '"checklist_name":', '"checklist":'),
        (key % 5 == 0, '"query":', '"debug":1,"query":'),
    ):
        value = F.when(cond, F.replace(value, F.lit(old), F.lit(new))).otherwise(value)
    value = F.when(key % 6 == 2, F.regexp_replace(value, r'"observations":\[.*?\],', "")).otherwise(value)
    report = ER.conformance(L.split_lines(L.parse_lines(event_lines(spark, sf).select(F.coalesce(value, "value").alias("value"))))[0])
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return report.select(F.get_json_object("line", "$.query").alias("query"), joined("missing").alias("missing"), joined("extra").alias("extra"))


# -- loads ------------------------------------------------------------------


def _version(spark, sf, cond: str, tag: str):
    """Event rows of a range of orders, their payload marked with a version."""
    e = table(spark, sf, "orders").filter(cond).select(
        col("o_orderkey").cast("string").alias("event_id"), F.to_date("o_orderdate").alias("event_date"), col("o_orderpriority").alias("response_kind"),
        F.expr(PURPOSE_SQL).alias("folder_purpose"), F.concat(F.lit(tag), F.when(col("o_orderkey") % 5 == 0, 0).otherwise(F.lit(1 if tag == "b" else 0))).alias("_p"))
    return e.withColumn("payload_json", F.when(col("event_id").cast("bigint") % 5 == 0, "same").otherwise(col("_p"))).withColumn("loaded_at", F.lit(tag)).drop("_p")


_A, _B = "o_orderkey % 10 < 7", "o_orderkey % 10 >= 4"


@query(
    "e9_upsert",
    f"SELECT concat('', o_orderkey) AS event_id, CASE WHEN {_B} THEN 'b' ELSE 'a' END AS loaded_at FROM orders",
)
def _(spark, sf):
    root = run_dir(spark, "upsert")
    first, again = _version(spark, sf, _A, "a"), _version(spark, sf, _B, "b")
    for n, rows in enumerate((first, W.latest_staging(again.unionByName(again)))):
        W.append(spark, root, {"events": rows}, "orders", f"v{n}")
    return W.current(spark, root).select("event_id", "loaded_at")


@query(
    "e10_replace_children",
    f"""SELECT concat('', l_orderkey) AS event_id, l_linenumber, 'b' AS version FROM lineitem WHERE l_orderkey % 10 >= 4 AND l_linenumber <= 2
    UNION ALL SELECT concat('', l_orderkey), l_linenumber, 'a' FROM lineitem WHERE l_orderkey % 10 < 7 AND NOT l_orderkey % 10 >= 4""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(col("l_orderkey").cast("string").alias("event_id"), "l_linenumber", col("l_orderkey").alias("k"))
    old = li.filter("k % 10 < 7").withColumn("version", F.lit("a")).drop("k")
    staged = li.filter("k % 10 >= 4")
    new = staged.filter("l_linenumber <= 2").withColumn("version", F.lit("b")).drop("k")
    # An event whose new version has no children loses its old ones as well.
    return W.replace_children(old, new, staged)


@query("j5_semi_join_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, sf):
    staged = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(col("o_orderkey").alias("l_orderkey")).distinct()
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(staged, "l_orderkey", "left_anti")


@query(
    "e11_upsert_changed",
    f"SELECT concat('', o_orderkey) AS event_id, CASE WHEN {_B} AND NOT ({_A} AND o_orderkey % 5 = 0) THEN 'b' ELSE 'a' END AS loaded_at FROM orders",
)
def _(spark, sf):
    return W.upsert_changed(_version(spark, sf, _A, "a"), _version(spark, sf, _B, "b")).select("event_id", "loaded_at")


@query(
    "s10_write_table",
    f"""SELECT event_id, response_kind, folder_key, strftime(generated_at, '%Y-%m-%d') AS event_date FROM {E}""",
)
def _(spark, sf):
    path = run_dir(spark, "table")
    W.write_table(W.with_day(events(spark, sf)), path, W.CLUSTER_KEYS["events"], part="event_date")
    return spark.read.parquet(path).select("event_id", "response_kind", "folder_key", col("event_date").cast("string").alias("event_date"))


@query(
    "a25_duplicate_ids",
    "SELECT concat('F', o_custkey, '|', strftime(o_orderdate, '%Y')) AS event_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("F"), "o_custkey", F.lit("|"), F.date_format("o_orderdate", "yyyy")).alias("event_id"))
    return W.duplicate_ids(o)


#: Rows of the four tables after a load, by event and what tells them apart.
LOADED_SQL = f"""SELECT 'events' AS t, {EID} AS event_id, '' AS what FROM orders WHERE {DATED}
    UNION ALL SELECT 'fields_long', {EID}, 'estimate_total' FROM orders WHERE {DATED}
    UNION ALL SELECT 'fields_long', {EID}, 'contract_status' FROM orders WHERE {DATED} AND o_orderkey % 3 <> 0
    UNION ALL SELECT 'inventory', {EID}, concat(l_returnflag, ' doc ', l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {DATED} AND l_linenumber <> 5
    UNION ALL SELECT 'open_items', {EID}, concat('item ', l_returnflag, ' ', l_linenumber) FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WHERE {DATED} AND NOT (l_linestatus = 'O' AND l_linenumber = 6)"""


def loaded(spark, root):
    """The current rows of all four tables."""
    what = {
        "events": F.lit(""), "fields_long": col("field_name"), "inventory": F.concat_ws(" ", "bucket", "doc_name"),
        "open_items": F.concat_ws(" ", "label", "strict_count"),
    }
    snap = W.Snapshot(spark, root)
    parts = [snap.table(n).select(F.lit(n).alias("t"), "event_id", w.alias("what")) for n, w in what.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("load_twice", LOADED_SQL)
def _(spark, sf):
    root = run_dir(spark, "load")
    good = L.split_lines(L.parse_lines(W.dealt_lines(cut(event_lines(spark, sf)))))[0]
    W.load(spark, good, root, dealt=True)
    W.load(spark, good, root, dealt=True)
    return loaded(spark, root)


@query(
    "reload_replaces_children",
    f"SELECT * FROM ({LOADED_SQL}) l WHERE t NOT IN ('inventory', 'open_items')",
)
def _(spark, sf):
    # The same events come again without documents and open items, then unchanged, then the tables are compacted.
    root = run_dir(spark, "reload")
    lines = cut(event_lines(spark, sf))
    bare = cut(lines.withColumn("value", F.regexp_replace("value", r'"document_inventory":\{.*?\},"open_items":\[.*?\]', '"document_inventory":{},"open_items":[]')))
    parse = lambda df: L.split_lines(L.parse_lines(df))[0]
    W.load(spark, parse(W.dealt_lines(lines)), root, dealt=True)
    W.load(spark, parse(W.dealt_lines(bare)), root, dealt=True)
    W.load(spark, parse(bare), root, only_changed=True)
    W.compact(spark, root)
    return loaded(spark, root)


@query("s7_event_sink", f"SELECT concat('', event_id) AS event_id, folder_key, contract_status, inspection_status FROM {E}")
def _(spark, sf):
    path = run_dir(spark, "log")
    e = events(spark, sf).select(col("event_id").cast("string").alias("event_id"), "folder_key", "contract_status", "inspection_status")
    L.append_events(e, path)
    good, _bad = L.read_events(spark, path)
    at = lambda k: F.variant_get("v", f"$.{k}", "string").alias(k)
    return good.select(*[at(c) for c in e.columns])
