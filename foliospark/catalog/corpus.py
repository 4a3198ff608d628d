"""Registered queries: scans, manifests, sync plans, row and table documents, text extraction, streams."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import classify as C
from ..functions import names as N
from ..operators import folders as FO
from ..operators import reports as R
from ..session import cut
from ..sources import corpus as CO
from ..streaming import streams as ST
from .base import CORPUS_SQL, SIDECAR_SQL, corpus, name_type_sql, query, run_dir, sidecar, table
from .folders import PASSED_SQL
from .names import CATEGORIES, HEURISTICS, TAGGED_SQL
from .warehouse import LOADED_SQL, event_lines, loaded

col = F.col
K = f"({CORPUS_SQL}) k"

# -- scans, sinks -----------------------------------------------------------


@query("s1_corpus_listing", f"SELECT path, name, regexp_extract(lower(name), '(\\.[^.]+)$', 1) AS ext, size_bytes FROM {K}")
def _(spark, sf):
    k = corpus(spark, sf)
    marker = k.select(F.concat("uri", F.lit("/")).alias("uri"), "size_bytes", "updated")
    files = k.select("uri", "size_bytes", "updated").unionByName(marker)
    return CO.listing(files, "store://corpus").select("path", "name", "ext", "size_bytes")


@query("s1_scan_files", "SELECT p_partkey AS n, length(p_name) + 1 AS size_bytes FROM part")
def _(spark, sf):
    # Writes the part names as files by key range, lists them, and checks sizes against their lines.
    root = run_dir(spark, "scan")
    table(spark, sf, "part").select(F.concat_ws("|", "p_partkey", "p_name").alias("value")).write.text(root)
    listed = CO.scan_corpus(spark, root, "*.txt").select("uri", "size_bytes")
    lines = spark.read.text(root).select(col("_metadata.file_path").alias("f"), "value")
    per_file = lines.groupBy("f").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    sized = lines.join(per_file, "f").join(listed.select(F.regexp_replace("uri", "^file:/*", "/").alias("u"), "size_bytes"), F.regexp_replace("f", "^file:/*", "/") == col("u"))
    name = F.substring_index("value", "|", -1)
    return sized.filter("bytes = size_bytes").select(F.substring_index("value", "|", 1).cast("bigint").alias("n"), (F.length(name) + 1).alias("size_bytes"))


@query(
    "s1_scan_to_manifest",
    """SELECT concat('F', p_partkey % 20, '/sub ', p_partkey % 3) AS folder, count(*) AS files, 'text/plain' AS mime FROM part GROUP BY 1""",
)
def _(spark, sf):
    # Files written below two levels of folders, listed, their folders found, a manifest built and read again.
    root = run_dir(spark, "mirror")
    rows = table(spark, sf, "part").select(
        F.concat(F.lit("F"), col("p_partkey") % 20).alias("a"), F.concat(F.lit("sub "), col("p_partkey") % 3).alias("b"),
        col("p_partkey").cast("string").alias("value"))
    rows.write.partitionBy("a", "b").text(f"{root}/mirror")
    files = CO.scan_corpus(spark, root, "*.txt", "mirror/a=F")
    path = F.regexp_replace(F.regexp_replace("path", "a=|b=", ""), "%20", " ")
    files = files.withColumn("path", path)
    folders = FO.folder_set(files)
    records = CO.build_manifest(files, F.struct(
        F.get(N.path_folders(path), F.lit(0)).alias("property"), F.get(N.path_folders(path), F.lit(1)).alias("category"),
        F.lit("").alias("doc_type"), F.lit("").alias("subpath"), col("name").alias("filename")))
    CO.write_manifest(records, f"{root}/manifest")
    back = CO.read_manifest(spark, f"{root}/manifest").select(
        "id", F.variant_get("data", "$.property", "string").alias("p"), F.variant_get("data", "$.category", "string").alias("c"))
    seen = back.join(folders.select(col("folder").alias("p")), "p", "left_semi").join(folders.select(col("folder").alias("c")), "c", "left_semi")
    seen = seen.join(records.select("id", col("content.mimeType").alias("mime")), "id").select(F.concat("p", F.lit("/"), "c").alias("folder"), "mime").distinct()
    lines = rows.groupBy(F.concat("a", F.lit("/"), "b").alias("folder")).agg(F.count("*").alias("files"))
    return lines.join(seen, "folder")


@query("s4_sidecar", f"SELECT uri, doc_type FROM ({SIDECAR_SQL}) s")
def _(spark, sf):
    # Sidecar files of one object each, with stray values that are no text.
    path = run_dir(spark, "sidecar")
    rows = cut(sidecar(spark, sf))
    files = max(1, rows.count() // 20000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("uri"), F.lit(files)))
    objects = rows.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("uri", "doc_type")))).alias("o"))
    objects.select("part", F.regexp_replace("o", r"\}$", ',"stray":{"a":1},"n":7}').alias("value")).write.partitionBy("part").text(path)
    return CO.read_sidecar(spark, path)


@query("s6_resume", f"SELECT uri FROM {K} WHERE file_no % 3 = 0")
def _(spark, sf):
    path = run_dir(spark, "resume")
    k = corpus(spark, sf)
    CO.write_csv(k.filter("file_no % 3 <> 0").select(col("uri").alias("blob_name"), "size_bytes"), path)
    done = CO.read_csv(spark, path, "blob_name string, size_bytes bigint")
    return CO.resume(k.select(col("uri").alias("blob_name")), done).select(col("blob_name").alias("uri"))


@query("s9_csv_export", f"SELECT uri, name, size_bytes FROM {K}")
def _(spark, sf):
    path = run_dir(spark, "csv")
    CO.write_csv(corpus(spark, sf).select("uri", "name", "size_bytes"), path)
    return CO.read_csv(spark, path, "uri string, name string, size_bytes bigint")


def records(spark, sf):
    k = corpus(spark, sf).withColumn("content_type", F.when(col("name").endswith(".pdf"), "application/pdf"))
    return CO.build_manifest(k, C.classify_path(col("path"), CATEGORIES, HEURISTICS, "General"))


_ISO = "strftime(make_timestamp(updated_s * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"


@query(
    "e19_build_manifest",
    f"""SELECT sha1(uri) AS id, t_property AS property, t_type AS doc_type, name AS title, {_ISO} AS updated, CASE WHEN name LIKE '%.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime
    FROM ({TAGGED_SQL}) t WHERE t_type IS NOT NULL""",
)
def _(spark, sf):
    r = records(spark, sf)
    return r.select("id", "structData.property", "structData.doc_type", "structData.title", "structData.updated", col("content.mimeType").alias("mime"))


@query("s8_manifest_sink", f"SELECT sha1(uri) AS id, path, 'structData_only' AS envelope, 'passthrough' AS content_class FROM ({TAGGED_SQL}) t WHERE t_type IS NOT NULL")
def _(spark, sf):
    path = run_dir(spark, "manifest")
    CO.write_manifest(records(spark, sf), path)
    return CO.read_manifest(spark, path).select("id", "path", "envelope", "content_class")


def manifest_lines(spark, sf):
    """Manifest lines in four envelopes, by file number; ids as the listing gives them."""
    k = corpus(spark, sf).withColumn("id", N.doc_id(col("path"))).withColumn("m", col("file_no") % 5)
    data = F.struct(
        F.when(col("m") != 2, col("name")).alias("title"),
        F.when(col("m") == 0, F.lit("contract")).when(col("m") == 1, "document").alias("document_type"),
        F.when(col("m") == 3, F.regexp_extract("path", "^mirror/([^/]+)/", 1)).alias("property"),
        F.when(col("m") == 4, col("uri")).alias("gcs_uri"),
    )
    uri = F.struct(F.lit("text/plain").alias("mimeType"), col("uri").alias("uri"))
    raw = F.struct(F.lit("text/plain").alias("mimeType"), F.base64(F.encode("name", "utf-8")).alias("rawBytes"))
    line = (
        F.when(col("m") == 0, F.to_json(F.struct("id", data.alias("structData"), uri.alias("content"))))
        .when(col("m") == 1, F.to_json(F.struct("id", F.to_json(data).alias("jsonData"), raw.alias("content"))))
        .when(col("m") == 2, F.to_json(F.struct(F.concat(F.lit("x"), "id").alias("id"), F.to_json(data).alias("jsonData"))))
        .when(col("m") == 3, F.to_json(F.struct("id", F.to_json(data).alias("structData"), uri.alias("content"))))
        .otherwise(F.to_json(F.struct("id", data.alias("structData"), F.to_json(data).alias("jsonData"))))
    )
    return k.select(line.alias("value"))


_ID = "substr(trim(regexp_replace(regexp_replace(path, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 128)"
_M = f"""SELECT *, file_no % 5 AS m, {_ID} AS plain_id, CASE WHEN file_no % 5 = 2 THEN 'x' ELSE '' END || {_ID} AS id, CASE WHEN file_no % 5 IN (0, 3, 4) THEN path ELSE '' END AS known_path,
  CASE file_no % 5 WHEN 0 THEN 'structData_only' WHEN 1 THEN 'jsonData_only' WHEN 2 THEN 'jsonData_only' WHEN 3 THEN 'structData_only' ELSE 'both' END AS envelope,
  CASE file_no % 5 WHEN 0 THEN 'passthrough' WHEN 1 THEN 'extracted' WHEN 3 THEN 'passthrough' ELSE 'pointer' END AS content_class FROM {K}"""


@query("s3_read_manifest", f"SELECT id, known_path AS path, envelope, content_class, CASE WHEN m = 2 THEN NULL ELSE name END AS title FROM ({_M}) m")
def _(spark, sf):
    return CO.parse_manifest(manifest_lines(spark, sf)).select("id", "path", "envelope", "content_class", F.variant_get("data", "$.title", "string").alias("title"))


@query("a16_content_classes", f"SELECT content_class, count(*) AS n FROM ({_M}) m GROUP BY 1")
def _(spark, sf):
    return R.counted(CO.parse_manifest(manifest_lines(spark, sf)), "content_class")


@query("a16_manifest_counts", f"SELECT t_property AS property, t_type AS doc_type, count(*) AS n FROM ({TAGGED_SQL}) t WHERE t_type IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return R.counted(records(spark, sf).select("structData.property", "structData.doc_type"), "property", "doc_type")


@query("a17_envelopes", f"SELECT envelope, array_to_string(list_slice(string_split(id, '_'), 1, 6), '_') AS id_prefix, count(*) AS n FROM ({_M}) m GROUP BY 1, 2")
def _(spark, sf):
    return R.counted(CO.parse_manifest(manifest_lines(spark, sf)), "envelope", CO.id_prefix(col("id")).alias("id_prefix"))


@query("j10_id_paths", f"SELECT plain_id AS id, min(path) AS id_path FROM ({_M}) m GROUP BY 1")
def _(spark, sf):
    return CO.id_paths(corpus(spark, sf))


_DATE = "CASE WHEN regexp_matches(name, '^[0-9]{8}') AND substr(name, 5, 2) BETWEEN '01' AND '12' AND substr(name, 7, 2) BETWEEN '01' AND '31' THEN substr(name, 1, 4) || '-' || substr(name, 5, 2) || '-' || substr(name, 7, 2) WHEN contains(lower(name), 'mar') THEN '2023-03' WHEN contains(lower(name), 'may') THEN '2023-05' WHEN contains(lower(name), 'dec') THEN '2023-12' END"
_REFRESHED = f"""SELECT *, split_part(path, '/', 2) AS property_new, CASE WHEN m = 0 THEN 'contract' ELSE {name_type_sql('name')} END AS type_new, {_DATE} AS date_new,
  CASE WHEN regexp_matches(name, '^[0-9]{{17,}}') THEN split_part(path, '/', 2) || ' — Scanned Document' ELSE name END AS title_new FROM ({_M}) a"""


@query(
    "e20_refresh_manifest",
    f"""SELECT id, CASE WHEN m = 2 THEN NULL ELSE property_new END AS property, CASE WHEN m = 2 THEN NULL ELSE type_new END AS document_type, CASE WHEN m = 2 THEN NULL ELSE date_new END AS doc_date,
      CASE WHEN m = 2 THEN NULL ELSE title_new END AS title, CASE WHEN m = 2 THEN 'no_path' ELSE 'changed' END AS status FROM ({_REFRESHED}) r""",
)
def _(spark, sf):
    m = CO.parse_manifest(manifest_lines(spark, sf))
    return CO.refresh_manifest(m, corpus(spark, sf)).select("id", "property", "document_type", "doc_date", "title", "status")


@query("a20_backfill_stats", f"SELECT CASE WHEN m = 2 THEN 'no_path' ELSE 'changed' END AS status, count(*) AS n FROM ({_M}) m GROUP BY 1")
def _(spark, sf):
    m = CO.parse_manifest(manifest_lines(spark, sf))
    return R.counted(CO.refresh_manifest(m, corpus(spark, sf)), "status")


# -- sync -------------------------------------------------------------------


def sync_plan(spark, sf, force=False):
    k = corpus(spark, sf)
    source = k.select("path", "size_bytes", col("updated_s").cast("string").alias("source_mtime"), F.when(col("file_no") % 2 == 0, "drive").otherwise("mail").alias("source"))
    mirrored = k.filter("file_no % 3 <> 0").select("path", F.when(col("file_no") % 4 == 0, "old").otherwise(col("updated_s").cast("string")).alias("source_mtime"))
    return CO.plan_sync(source, mirrored, force, allowed=(".pdf", ".docx", ".xlsx", ".jpg"))


_OUTCOME = "CASE WHEN name LIKE '%.html' THEN 'skipped_ext' WHEN file_no % 3 <> 0 AND file_no % 4 <> 0 THEN 'skipped_same' ELSE 'uploaded' END"


@query("s11_plan_sync", f"SELECT path, {_OUTCOME} AS outcome FROM {K}")
def _(spark, sf):
    return sync_plan(spark, sf).select("path", "outcome")


@query("s11_plan_sync_forced", f"SELECT path, CASE WHEN name LIKE '%.html' THEN 'skipped_ext' ELSE 'uploaded' END AS outcome FROM {K}")
def _(spark, sf):
    return sync_plan(spark, sf, True).select("path", "outcome")


_STATS = f"""SELECT source, count(*) AS walked, count(*) FILTER (WHERE outcome = 'uploaded') AS uploaded, count(*) FILTER (WHERE outcome = 'skipped_same') AS skipped_same, count(*) FILTER (WHERE outcome = 'skipped_ext') AS skipped_ext,
  CAST(0 AS BIGINT) AS errors, CAST(sum(CASE WHEN outcome = 'uploaded' THEN size_bytes ELSE 0 END) AS BIGINT) AS bytes FROM (SELECT CASE WHEN file_no % 2 = 0 THEN 'drive' ELSE 'mail' END AS source, {_OUTCOME} AS outcome, size_bytes FROM {K}) x GROUP BY 1"""


@query("s12_sync_stats", _STATS)
def _(spark, sf):
    return CO.sync_stats(sync_plan(spark, sf))


@query("s12_merged_stats", f"SELECT CAST(sum(walked) AS BIGINT) AS walked, CAST(sum(uploaded) AS BIGINT) AS uploaded, CAST(sum(skipped_same) AS BIGINT) AS skipped_same, CAST(sum(skipped_ext) AS BIGINT) AS skipped_ext, CAST(0 AS BIGINT) AS errors, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_STATS}) s")
def _(spark, sf):
    return CO.merge_stats(CO.sync_stats(sync_plan(spark, sf)))


@query("s14_mirror_path", f"SELECT file_no, CASE WHEN file_no % 4 = 0 THEN concat('mirror/', name) ELSE concat('mirror/', property, '/', category, '/', name) END AS path FROM {K}")
def _(spark, sf):
    parent = F.when(col("file_no") % 4 == 0, "/drives/1/root:").otherwise(F.concat(F.lit("/drives/1/root:/"), "property", F.lit("/"), "category", F.lit("/")))
    return corpus(spark, sf).select("file_no", CO.mirror_path(parent, col("name")).alias("path"))


@query(
    "s15_message_path",
    """SELECT o_orderkey, concat(CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END, '/',
      CASE WHEN o_orderkey % 7 = 0 THEN concat('id', o_orderkey) ELSE substr(lower(trim(regexp_replace(concat('Re: ', o_orderpriority, ' F', o_custkey, ' !'), '[^a-zA-Z0-9]+', '-', 'g'), '-')), 1, 40) END,
      '_', concat('id', o_orderkey)) AS path FROM orders""",
)
def _(spark, sf):
    subject = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN '!?' ELSE concat('Re: ', o_orderpriority, ' F', o_custkey, ' !') END")
    sent = F.when(col("o_orderkey") % 9 != 0, col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", CO.message_path(subject, sent, F.concat(F.lit("id"), "o_orderkey")).alias("path"))


# -- documents from rows ----------------------------------------------------


@query("s16_rows_to_docs", "SELECT concat('mirror/Properties/_csv/table/', c_custkey, '.txt') AS path, concat('c_name: ', c_name, chr(10), 'c_nationkey: ', c_nationkey, chr(10), 'c_mktsegment: ', c_mktsegment) AS text FROM customer")
def _(spark, sf):
    return CO.rows_to_docs(table(spark, sf, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query(
    "s17_table_rows_to_docs",
    """WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_orderkey // 256 ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS rn,
        count(*) OVER (PARTITION BY l_suppkey, l_orderkey // 256) AS n, l_orderkey // 256 AS g FROM lineitem)
    SELECT concat('tbl_', substr(md5(concat('s', l_suppkey, '_t', g + 1, '_', rn)), 1, 16)) AS id, concat('[s', l_suppkey, '] Order: ', l_orderkey, CASE WHEN l_returnflag = 'N' THEN '' ELSE concat(' | col_1: ', l_returnflag) END, ' | Part no: ', l_partkey) AS text
    FROM l WHERE n >= 4""",
)
def _(spark, sf):
    # A table holds one supplier's lines of 256 orders, which bounds its rows.
    li = table(spark, sf, "lineitem").withColumn("g", F.expr("l_orderkey div 256"))
    cells = F.array(F.concat(F.lit(" "), "l_orderkey"), F.when(col("l_returnflag") == "N", "  ").otherwise(col("l_returnflag")), F.concat("l_partkey", F.lit("\n")))
    header = F.array(F.array(F.lit("Order"), F.lit(" "), F.lit("Part  no")))
    rows = li.groupBy("l_suppkey", "g").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", cells.alias("c")))).alias("r"))
    tables = rows.select(
        F.concat(F.lit("s"), "l_suppkey").alias("source"), F.lit(1).alias("page"), col("g").cast("int").alias("table_idx"),
        F.concat(header, F.transform("r", lambda r: r["c"])).alias("rows"))
    return CO.table_rows_to_docs(tables).select("id", "text")


@query(
    "s18_extract_text",
    """SELECT concat('d/', doc_id, '.txt') AS path, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS error FROM documents
    UNION ALL SELECT concat('p/', page_id, '.html'), md5(regexp_replace(html, '<[^>]+>', ' ', 'g')), NULL FROM pages
    UNION ALL SELECT concat('c/', conv_id, '-', turn, '.up'), md5(concat('up ', text)), NULL FROM conversations
    UNION ALL SELECT concat('b/', item_id, '.bin'), md5(''), 'no decoder' FROM benchmark""",
)
def _(spark, sf):
    files = (
        table(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "utf-8").alias("content"))
        .unionByName(table(spark, sf, "pages").select(F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "utf-8").alias("content")))
        .unionByName(table(spark, sf, "conversations").select(F.concat(F.lit("c/"), "conv_id", F.lit("-"), "turn", F.lit(".up")).alias("path"), F.encode("text", "utf-8").alias("content")))
        .unionByName(table(spark, sf, "benchmark").select(F.concat(F.lit("b/"), "item_id", F.lit(".bin")).alias("path"), F.encode("text", "utf-8").alias("content")))
    )
    out = CO.extract_text(files, {".up": lambda raw, ext: "up " + raw.decode("utf-8")})
    return out.select("path", F.md5("text").alias("text_md5"), "error")


@query("s19_cached_text", f"SELECT file_no, CASE WHEN file_no % 3 = 0 AND file_no % 2 = 0 THEN concat('t', file_no) END AS cached_text FROM {K}")
def _(spark, sf):
    k = corpus(spark, sf)
    cache = k.filter("file_no % 3 = 0").select(
        CO.cache_path(col("path")).alias("path"), F.when(col("file_no") % 2 == 0, col("updated")).otherwise(col("updated") - F.expr("interval 1 hour")).alias("updated"), F.concat(F.lit("t"), "file_no").alias("text"))
    return CO.with_cached_text(k, cache).select("file_no", "cached_text")


# -- streams ----------------------------------------------------------------


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", col("ts").cast("timestamp"))


@query("s13_new_items", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'view')")
def _(spark, sf):
    feed = event_stream(spark, sf).withColumn("deleted", F.when(col("event_type") == "error", "gone")).withColumn("file", F.when(col("event_type") != "view", col("props")))
    return ST.run_to_table(ST.new_items(feed).select("event_id"), run_dir(spark, "feed"), "append")


@query("x2_stream_hourly", PASSED_SQL)
def _(spark, sf):
    hourly = ST.hourly_calls(event_stream(spark, sf), "ts", rules.CALL_THRESHOLDS)
    out = ST.run_to_table(hourly, run_dir(spark, "hourly"), "update", ["hour"])
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "calls", F.array_join("passed", ",").alias("passed"))


@query(
    "x3_stream_rate",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls FROM (
      SELECT unnest(list_transform(range(60), lambda i: date_trunc('second', ts) - to_seconds(CAST(i AS DOUBLE)))) AS w FROM events) x GROUP BY 1""",
)
def _(spark, sf):
    path = run_dir(spark, "rate")
    final = ST.run_to_table(ST.sliding_rate(event_stream(spark, sf), "ts"), path, "append")
    out = final.unionByName(ST.open_rate(spark, f"{path}/checkpoint"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "calls")


@query(
    "x4_idle_sessions",
    """WITH t AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM t)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s""",
)
def _(spark, sf):
    path = run_dir(spark, "sessions")
    closed = ST.run_to_table(ST.idle_sessions(event_stream(spark, sf), "ts", "user_id"), path, "append")
    out = closed.unionByName(ST.open_sessions(spark, f"{path}/checkpoint", "user_id"))
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("x6_unique_events", "SELECT event_id, event_type FROM events")
def _(spark, sf):
    twice = event_stream(spark, sf).union(event_stream(spark, sf))
    return ST.run_to_table(ST.unique_events(twice, "ts").select("event_id", "event_type"), run_dir(spark, "unique"), "append")


@query("x5_periodic_sync", "SELECT event_id FROM events")
def _(spark, sf):
    path = run_dir(spark, "periodic")
    writer = event_stream(spark, sf).select("event_id").writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    running = ST.periodic(writer, 1).start()
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{path}/rows")


@query("x1_stream_load", LOADED_SQL)
def _(spark, sf):
    root = run_dir(spark, "stream")
    lines = cut(event_lines(spark, sf))
    lines.write.text(f"{root}/log", compression="gzip")
    ST.stream_load(spark, f"{root}/log", f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    # The same lines arrive again in new files; nothing may double.
    lines.write.mode("append").text(f"{root}/log", compression="gzip")
    ST.stream_load(spark, f"{root}/log", f"{root}/tables", f"{root}/checkpoint").awaitTermination()
    return loaded(spark, f"{root}/tables")
