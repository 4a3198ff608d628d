"""Registered queries: folder joins, inventories, checklists, photos; audits and reports."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import classify as C
from ..functions import names as N
from ..operators import folders as FO
from ..operators import history as H
from ..operators import reports as R
from ..operators import search as S
from ..sources import corpus as CO
from .base import (
    CORPUS_SQL, EVENTS_SQL, FIELDS_SQL, ITEMS_SQL, SIDECAR_SQL, bucket_sql, corpus, events, fields, items, lit, name_type_sql,
    norm_sql, query, sidecar, table,
)
from .names import (
    AUDIT_FLAG_SQL, BUCKETED_SQL, CATEGORIES, GUESS_SQL, HEURISTICS, PURPOSE_OF_SQL, TAGGED_SQL, audit, property_items,
)

col = F.col
K = f"({CORPUS_SQL}) k"

SEG_SQL = f"""SELECT uri, name, path, file_no, size_bytes, seg, pos, CASE WHEN pos < n - 1 THEN parts[pos + 1] ELSE '' END AS subfolder, {norm_sql('seg')} AS folder_norm
FROM (SELECT uri, name, path, file_no, size_bytes, parts, len(parts) AS n, unnest(list_slice(parts, 1, -2)) AS seg, generate_subscripts(list_slice(parts, 1, -2), 1) AS pos
  FROM (SELECT *, string_split(path, '/') AS parts FROM {K}) a) b"""
ENUMERABLE = "regexp_matches(lower(name), '\\.(pdf|docx|doc|xlsx|xls|csv|txt|pptx|ppt|md|html)$')"
FOLDERS_SQL = f"SELECT DISTINCT unnest(list_slice(string_split(path, '/'), 2, -2)) AS folder FROM {K}"
ENUM_SQL = f"""SELECT f.folder, s.uri, s.name, s.path, s.subfolder, lower(s.name) LIKE '%.html' AS is_marker FROM ({SEG_SQL}) s JOIN ({FOLDERS_SQL}) f
  ON {norm_sql('f.folder')} = s.folder_norm WHERE s.folder_norm <> '' AND {ENUMERABLE}"""


def folders(spark, sf):
    return FO.folder_set(corpus(spark, sf))


@query("j1_corpus_sidecar", f"SELECT k.file_no, s.doc_type FROM {K} LEFT JOIN ({SIDECAR_SQL}) s USING (uri)")
def _(spark, sf):
    return corpus(spark, sf).join(sidecar(spark, sf), "uri", "left").select("file_no", "doc_type")


@query("j6_enumerate_folders", f"SELECT folder, uri, subfolder, is_marker FROM ({ENUM_SQL}) e")
def _(spark, sf):
    return FO.enumerate_folders(corpus(spark, sf), folders(spark, sf)).select("folder", "uri", "subfolder", "is_marker")


_DISTINCTIVE = f"(regexp_matches(w, '[0-9]') OR length(w) >= 4) AND w NOT IN ({', '.join(lit(x) for x in rules.CATEGORY_NOISE_WORDS)})"


@query(
    "j7_related_folders",
    f"""WITH p AS (SELECT DISTINCT concat(p_size, ' ', split_part(p_name, ' ', 1), ' ', p_brand) AS folder FROM part),
      w AS (SELECT DISTINCT folder, unnest(string_split({norm_sql('folder')}, ' ')) AS w FROM p)
    SELECT DISTINCT a.folder, b.folder AS related FROM w a JOIN w b ON a.w = b.w AND a.folder <> b.folder
    WHERE (regexp_matches(a.w, '[0-9][0-9]') OR a.w = 'zz') AND a.w NOT IN ('brand') AND a.folder IN (SELECT min(folder) FROM p GROUP BY split_part(folder, ' ', 1))""",
)
def _(spark, sf):
    # Words of fewer than two digits and the brand word are noise here, as category words are elsewhere.
    f = table(spark, sf, "part").select(F.expr("concat(p_size, ' ', split_part(p_name, ' ', 1), ' ', p_brand)").alias("folder")).distinct()
    seeds = f.groupBy(F.substring_index("folder", " ", 1)).agg(F.min("folder").alias("folder")).select("folder")
    noise = ["brand", "small", "blue", "cold", "large", *[str(i) for i in range(10)]]
    return FO.related_folders(seeds, f, noise)


@query(
    "j7_shared_words",
    f"""WITH w AS (SELECT DISTINCT folder, unnest(string_split({norm_sql('folder')}, ' ')) AS w FROM ({FOLDERS_SQL}) f),
      n AS (SELECT w, count(*) AS n FROM w WHERE w <> '' GROUP BY 1)
    SELECT folder, w.w AS word, n - 1 AS others, n AS held FROM w JOIN n ON n.w = w.w WHERE n > 1 AND {_DISTINCTIVE.replace('w NOT IN', 'w.w NOT IN').replace('matches(w', 'matches(w.w').replace('length(w)', 'length(w.w)')}""",
)
def _(spark, sf):
    # Every folder with every distinctive word it shares, and how many folders the word's blocks hold.
    links, members = FO.shared_words(folders(spark, sf))
    held = members.groupBy("word").agg(F.sum(F.size("folders")).alias("held"))
    return links.join(held, "word").select("folder", "word", "others", "held")


@query(
    "a7_folder_inventory",
    f"""WITH t AS (SELECT e.*, coalesce(nullif(s.doc_type, ''), {name_type_sql('name')}) AS doc_type FROM ({ENUM_SQL}) e LEFT JOIN ({SIDECAR_SQL}) s USING (uri)),
      b AS (SELECT folder, name, path, {bucket_sql('doc_type', 'name')} AS bucket FROM t),
      n AS (SELECT folder, bucket, count(*) AS n FROM b GROUP BY 1, 2),
      r AS (SELECT folder, name, row_number() OVER (PARTITION BY folder ORDER BY path) AS rn FROM b)
    SELECT folder, c.file_count, c.buckets, c.display, c.predicted_purpose, x.samples FROM
      (SELECT folder, CAST(sum(n) AS BIGINT) AS file_count, string_agg(bucket || '=' || n, ',' ORDER BY bucket) AS buckets,
        CASE WHEN sum(n) > 500 THEN '500+' ELSE concat('', CAST(sum(n) AS BIGINT)) END AS display,
        CASE WHEN bool_or(bucket IN ('insurance','estimate','photos')) THEN 'claim_restoration' WHEN bool_or(bucket IN ('appraisal','contract')) THEN 'property_appraisal' ELSE 'unknown' END AS predicted_purpose
       FROM n GROUP BY 1) c JOIN (SELECT folder, string_agg(name, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 3 GROUP BY 1) x USING (folder)""",
)
def _(spark, sf):
    files = FO.inventory_items(FO.enumerate_folders(corpus(spark, sf), folders(spark, sf)), sidecar(spark, sf))
    inv = FO.folder_inventory(files)
    return inv.select(
        "folder", "file_count", F.array_join(F.transform(F.map_entries("buckets"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("buckets"),
        col("file_count_display").alias("display"), "predicted_purpose", F.array_join("samples", "|").alias("samples"),
    )


CHECK_SQL = " UNION ALL ".join(
    f"SELECT {lit(name)} AS checklist_name, {lit(purpose)} AS folder_purpose, {i} AS ord, {lit(label)} AS label, {lit(bucket)} AS bucket, "
    f"[{', '.join(lit(s) for s in strict)}] AS strict" if strict else
    f"SELECT {lit(name)}, {lit(purpose)}, {i}, {lit(label)}, {lit(bucket)}, CAST(NULL AS VARCHAR[])"
    for name, purpose, lines in rules.CHECKLISTS for i, (label, bucket, strict) in enumerate(lines)
)


@query("e12_checklist_choice", f"SELECT property, CASE folder_purpose WHEN 'claim_restoration' THEN 'claim_default' WHEN 'property_appraisal' THEN 'property_default' ELSE 'unknown' END AS checklist FROM ({PURPOSE_OF_SQL}) p")
def _(spark, sf):
    p = FO.folder_purpose(property_items(spark, sf), "property")
    return p.select("property", FO.checklist_name(col("folder_purpose")).alias("checklist"))


@query(
    "e13_open_items",
    f"""WITH l AS (SELECT property, c.* FROM ({PURPOSE_OF_SQL}) p JOIN ({CHECK_SQL}) c USING (folder_purpose)),
      n AS (SELECT property, bucket, doc_type, count(*) AS n FROM ({BUCKETED_SQL}) b GROUP BY 1, 2, 3),
      j AS (SELECT l.property, l.checklist_name, l.label, l.bucket, CAST(coalesce(sum(n.n) FILTER (WHERE l.strict IS NULL OR list_contains(l.strict, n.doc_type)), 0) AS BIGINT) AS strict_count,
        CAST(coalesce(sum(n.n), 0) AS BIGINT) AS total_count FROM l LEFT JOIN n ON n.property = l.property AND n.bucket = l.bucket GROUP BY 1, 2, 3, 4)
    SELECT *, CASE WHEN total_count = 0 THEN 'not_found' WHEN strict_count > 0 THEN 'found' ELSE 'needs_review' END AS status FROM j""",
)
def _(spark, sf):
    it = property_items(spark, sf)
    lines = FO.open_items(FO.folder_purpose(it, "property"), it, FO.checklist_table(spark), "property")
    return lines.select("property", "checklist_name", "label", "bucket", "strict_count", "total_count", "status")


_TXT = "SELECT doc_id AS file_no, text FROM documents"


@query(
    "w7_dossier",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY size_bytes DESC, path) AS rank FROM {K}),
      b AS (SELECT *, CASE WHEN rank <= 5 THEN 3000 WHEN rank <= 15 THEN 800 ELSE 200 END AS budget FROM r WHERE rank <= 20),
      t AS (SELECT b.*, CASE WHEN lower(name) LIKE '%.html' THEN '' ELSE coalesce(text, '') END AS body FROM b LEFT JOIN ({_TXT}) d USING (file_no))
    SELECT category, uri, rank, budget AS char_budget, length(body) AS full_text_len, md5(substr(body, 1, budget)) AS snippet_md5, length(substr(body, 1, budget)) AS snippet_chars FROM t""",
)
def _(spark, sf):
    ranked = corpus(spark, sf).withColumn("is_marker", F.lower("name").endswith(".html"))
    texts = table(spark, sf, "documents").select(col("doc_id").alias("file_no"), "text").join(corpus(spark, sf).select("file_no", "uri"), "file_no")
    d = FO.dossier(ranked, texts, "category", [col("size_bytes").desc(), col("path")])
    return d.select("category", "uri", "rank", "char_budget", "full_text_len", F.md5("snippet").alias("snippet_md5"), "snippet_chars")


@query(
    "a22_subfolder_groups",
    f"""WITH e AS (SELECT * FROM ({ENUM_SQL}) x), r AS (SELECT *, row_number() OVER (PARTITION BY folder, subfolder ORDER BY name, uri) AS rn, count(*) OVER (PARTITION BY folder, subfolder) AS n FROM e)
    SELECT folder, subfolder, any_value(n) AS n, string_agg(name, '|' ORDER BY rn) AS samples FROM r WHERE rn <= 3 GROUP BY 1, 2""",
)
def _(spark, sf):
    g = FO.subfolder_groups(FO.enumerate_folders(corpus(spark, sf), folders(spark, sf)))
    return g.withColumn("samples", F.array_join("samples", "|"))


@query(
    "a13_folder_extensions",
    f"""SELECT f.folder, regexp_extract(lower(s.name), '(\\.[^.]+)$', 1) AS ext, count(*) AS n FROM ({SEG_SQL}) s JOIN ({FOLDERS_SQL}) f ON {norm_sql('f.folder')} = s.folder_norm GROUP BY 1, 2""",
)
def _(spark, sf):
    return FO.extension_counts(corpus(spark, sf), folders(spark, sf))


@query("a21_folder_words", f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split({norm_sql('folder')}, ' ')) AS word FROM ({FOLDERS_SQL}) f) w WHERE word <> '' GROUP BY 1")
def _(spark, sf):
    return FO.folder_word_counts(folders(spark, sf))


_PARENT = "regexp_extract(path, '^mirror/(.*)/[^/]*$', 1)"
_LAST2 = "array_to_string(list_slice(string_split(p, '/'), -2, -1), '/')"
POINTER_SQL = f"""SELECT k AS prop_key, split_part(k, '/', 1) AS property, photo_count, concat(split_part(k, '/', 1), '/', CASE WHEN contains(k, '/') THEN split_part(k, '/', -1) ELSE 'photos' END) AS url FROM (
  SELECT {_LAST2} AS k, count(*) AS photo_count FROM (SELECT {_PARENT} AS p FROM {K} WHERE lower(name) LIKE '%.jpg') a GROUP BY 1) b"""


def photo_files(spark, sf):
    return corpus(spark, sf).withColumn("parent", F.regexp_extract("path", "^mirror/(.*)/[^/]*$", 1))


@query("a23_photo_pointers", f"SELECT *, concat(property, ' — Photos (', photo_count, ' images)') AS title FROM ({POINTER_SQL}) p")
def _(spark, sf):
    return FO.photo_pointers(photo_files(spark, sf)).select("prop_key", "property", "photo_count", "url", "title")


@query("a23_photo_pointers_scoped", f"SELECT CASE WHEN b = '' THEN a ELSE a || '/' || b END AS prop_key, count(*) AS photo_count FROM (SELECT split_part(p, '/', 2) AS a, split_part(p, '/', 3) AS b FROM (SELECT {_PARENT} AS p FROM {K} WHERE lower(name) LIKE '%.jpg') x) y GROUP BY 1")
def _(spark, sf):
    return FO.photo_pointers(photo_files(spark, sf), "Properties").select("prop_key", "photo_count")


@query("a24_photo_index", f"SELECT property, photo_count, url FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY photo_count DESC, prop_key DESC) AS rn FROM ({POINTER_SQL}) p) q WHERE rn = 1")
def _(spark, sf):
    return FO.photo_index(FO.photo_pointers(photo_files(spark, sf))).select("property", "photo_count", "url")


# -- reports ----------------------------------------------------------------


@query("a1_count_percent", "SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 1) AS pct FROM events GROUP BY 1")
def _(spark, sf):
    return R.count_percent(table(spark, sf, "events"), "event_type")


@query(
    "a2_row_counts",
    f"""SELECT 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM ({EVENTS_SQL}) e UNION ALL SELECT 'response_kind', response_kind, count(*) FROM ({EVENTS_SQL}) e GROUP BY 2
    UNION ALL SELECT 'folder_purpose', folder_purpose, count(*) FROM ({EVENTS_SQL}) e GROUP BY 2 UNION ALL SELECT 'inspection_status', coalesce(inspection_status, '(missing)'), count(*) FROM ({EVENTS_SQL}) e GROUP BY 2""",
)
def _(spark, sf):
    return R.row_counts(events(spark, sf), ("response_kind", "folder_purpose", "inspection_status"))


@query("a2_top_folders", f"SELECT folder_key, count(*) AS n FROM ({EVENTS_SQL}) e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return R.top_counts(events(spark, sf), "folder_key", 10, "folder_key")


@query("a2_distinct_folders", f"SELECT count(DISTINCT folder_key) AS folders FROM ({EVENTS_SQL}) e")
def _(spark, sf):
    return events(spark, sf).select("folder_key").distinct().agg(F.count("*").alias("folders"))


_COVER = f"""SELECT field_name, count(*) AS populated, (SELECT count(*) FROM orders) AS eligible, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS pct, count(source_file) AS with_source
  FROM ({FIELDS_SQL}) f WHERE field_value IS NOT NULL GROUP BY 1"""


def coverage(spark, sf):
    total = table(spark, sf, "orders").agg(F.count("*").alias("n")).scalar()
    return R.field_coverage(fields(spark, sf), total)


@query("a3_field_coverage", f"""SELECT c.*, d.confidences FROM ({_COVER}) c JOIN (SELECT field_name, string_agg(confidence || '=' || n, ',' ORDER BY confidence) AS confidences FROM
  (SELECT field_name, coalesce(confidence, 'None') AS confidence, count(*) AS n FROM ({FIELDS_SQL}) f GROUP BY 1, 2) x GROUP BY 1) d USING (field_name)""")
def _(spark, sf):
    c = coverage(spark, sf)
    text = F.array_join(F.transform(F.map_entries("confidences"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return c.withColumn("confidences", text)


@query("a6_promotion", f"SELECT field_name, CASE WHEN 100.0 * populated / eligible >= 70 THEN 'promote' ELSE 'keep_nullable' END AS recommendation FROM ({_COVER}) c")
def _(spark, sf):
    return R.promotion(coverage(spark, sf), 70.0).select("field_name", "recommendation")


@query(
    "a4_status_distribution",
    f"""SELECT label, status, count(*) AS n, false AS overall FROM ({ITEMS_SQL}) i GROUP BY 1, 2 UNION ALL SELECT NULL, status, count(*), true FROM ({ITEMS_SQL}) i GROUP BY 2""",
)
def _(spark, sf):
    return R.status_distribution(items(spark, sf))


@query("a5_bucket_distribution", f"SELECT bucket, count(DISTINCT event_id) AS records, count(*) AS docs FROM ({ITEMS_SQL}) i GROUP BY 1")
def _(spark, sf):
    return R.bucket_distribution(items(spark, sf))[0]


@query("a5_docs_per_record", f"SELECT count(*) AS records, round(avg(n), 4) AS avg_docs, min(n) AS min_docs, max(n) AS max_docs FROM (SELECT event_id, count(*) AS n FROM ({ITEMS_SQL}) i GROUP BY 1) x")
def _(spark, sf):
    return R.bucket_distribution(items(spark, sf))[1]


_COV_LABEL = "CASE WHEN coalesce(doc_type, '') = '' THEN '(empty / no sidecar entry)' WHEN doc_type IN ('other','document','unknown') THEN doc_type ELSE '(classified -- out of audit scope)' END"


@query("a8_classification_coverage", f"SELECT {_COV_LABEL} AS label, count(*) AS n FROM {K} LEFT JOIN ({SIDECAR_SQL}) s USING (uri) GROUP BY 1")
def _(spark, sf):
    joined = corpus(spark, sf).join(sidecar(spark, sf), "uri", "left")
    return R.counted(joined, R.coverage_label(col("doc_type")).alias("label"))


def guesses(spark, sf):
    g = corpus(spark, sf).withColumn("g", C.guess(col("name"), col("path")))
    return g.withColumn("guess_bucket", F.coalesce("g.bucket", F.lit("(no_guess)"))).withColumn("guess_basis", col("g.basis")).withColumn("extension", N.last_dot_ext(col("name"))).drop("g")


_G = f"(SELECT file_no, name, uri, path, coalesce(g_bucket, '(no_guess)') AS guess_bucket, g_basis AS guess_basis, regexp_extract(lower(name), '(\\.[^.]*)$', 1) AS extension FROM ({GUESS_SQL}) g) g"


@query(
    "a9_guess_rollups",
    f"""SELECT 'basis' AS kind, guess_basis AS value, count(*) AS n FROM {_G} GROUP BY 2 UNION ALL SELECT 'bucket', guess_bucket, count(*) FROM {_G} GROUP BY 2 UNION ALL SELECT 'extension', extension, count(*) FROM {_G} GROUP BY 2""",
)
def _(spark, sf):
    kinds = {"basis": "guess_basis", "bucket": "guess_bucket", "extension": "extension"}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), col(c).alias("value")) for k, c in kinds.items()])).alias("r")
    return R.counted(guesses(spark, sf).select(rows).select("r.*"), "kind", "value")


@query(
    "a10_leverage",
    f"""SELECT audited, actionable, claim_relevant, round(p, 1) AS pct, CASE WHEN p >= 30 THEN 'worth_it' WHEN p >= 10 THEN 'marginal' ELSE 'low_leverage' END AS verdict FROM (
    SELECT count(*) AS audited, count(*) FILTER (WHERE guess_bucket <> '(no_guess)') AS actionable, count(*) FILTER (WHERE guess_bucket IN ('insurance','estimate','photos')) AS claim_relevant,
      100.0 * count(*) FILTER (WHERE guess_bucket <> '(no_guess)') / count(*) AS p FROM {_G}) x""",
)
def _(spark, sf):
    return R.leverage(guesses(spark, sf))


def _pattern_sql(expr: str) -> str:
    for pattern, mark in rules.NAME_PATTERN_STEPS:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(mark)}, 'g')"
    return expr


@query("a11_name_patterns", f"SELECT {_pattern_sql('lower(name)')} AS pattern, count(*) AS n FROM {K} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return R.top_counts(corpus(spark, sf), N.name_pattern(col("name")), 15, "pattern")


@query("a12_corpus_counts", f"SELECT concat(split_part(path, '/', 1), '/') AS prefix, regexp_extract(lower(name), '(\\.[^.]+)$', 1) AS ext, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM {K} GROUP BY 1, 2")
def _(spark, sf):
    return R.corpus_counts(corpus(spark, sf))


_SUMMARY_SQL = f"""SELECT 'tier' AS kind, production_tier AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 1) AS pct FROM ({AUDIT_FLAG_SQL}) a GROUP BY 2
  UNION ALL SELECT 'flag', flag, count(*), round(100.0 * count(*) / (SELECT count(*) FROM part), 1) FROM ({AUDIT_FLAG_SQL}) a WHERE flag <> '' GROUP BY 2"""


@query("a14_extraction_summary", _SUMMARY_SQL)
def _(spark, sf):
    return R.extraction_summary(audit(spark, sf))


@query(
    "a14_extraction_hints",
    f"""SELECT hint FROM (SELECT unnest([CASE WHEN max(pct) FILTER (WHERE value = 'tier1_extracted') > 70 THEN 'extraction_healthy' END, CASE WHEN max(pct) FILTER (WHERE value = 'thin_text_layer_accepted') > 5 THEN 'thin_text_layers' END,
      CASE WHEN max(pct) FILTER (WHERE value = 'tier2_ocr_live') > 5 THEN 'ocr_pending' END, CASE WHEN max(pct) FILTER (WHERE value = 'tier3_passthrough') > 10 THEN 'passthrough_names' END]) AS hint FROM ({_SUMMARY_SQL}) s) h WHERE hint IS NOT NULL""",
)
def _(spark, sf):
    return R.extraction_hints(R.extraction_summary(audit(spark, sf)))


@query(
    "a15_discovery",
    f"""SELECT 'class' AS kind, CASE WHEN strict_ok THEN 'strict' WHEN t_type IS NOT NULL THEN 'heuristic' ELSE 'unclassified' END AS value, count(*) AS n FROM ({TAGGED_SQL}) t GROUP BY 2
    UNION ALL SELECT 'property', property, count(*) FROM {K} WHERE len(string_split(path, '/')) >= 5 GROUP BY 2
    UNION ALL SELECT 'skipped_category', category, count(*) FROM {K} WHERE file_no % 6 <> 0 AND category = '99-Misc' GROUP BY 2""",
)
def _(spark, sf):
    classified = corpus(spark, sf).select(
        "path", C.classify_strict(col("path"), CATEGORIES).alias("strict"), C.classify_heuristic(col("path"), HEURISTICS, "General").alias("heuristic")
    )
    return R.discovery(classified, categories=list(CATEGORIES))


def old_new(spark, sf):
    """The stored sidecar and the one that reclassification gives."""
    old = sidecar(spark, sf)
    return old, CO.reclassify(corpus(spark, sf), old)


NEW_SQL = f"SELECT k.uri, CASE WHEN s.doc_type = 'large_pdf_pointer' THEN s.doc_type ELSE {name_type_sql('k.name')} END AS doc_type FROM {K} LEFT JOIN ({SIDECAR_SQL}) s USING (uri)"
DIFF_SQL = f"""SELECT uri, o.doc_type AS before, n.doc_type AS after, CASE WHEN o.doc_type IS NULL THEN 'added' WHEN n.doc_type IS NULL THEN 'removed' WHEN o.doc_type = n.doc_type THEN 'unchanged' ELSE 'changed' END AS change
  FROM ({SIDECAR_SQL}) o FULL OUTER JOIN ({NEW_SQL}) n USING (uri)"""
MOVES_SQL = f"SELECT coalesce(before, '(none)') AS before, coalesce(after, '(none)') AS after, count(*) AS n FROM ({DIFF_SQL}) d WHERE change <> 'unchanged' GROUP BY 1, 2"


@query("e21_reclassify", NEW_SQL)
def _(spark, sf):
    return old_new(spark, sf)[1]


@query("j4_sidecar_diff", DIFF_SQL)
def _(spark, sf):
    return R.sidecar_diff(*old_new(spark, sf))


@query("u4_key_union", f"SELECT change, count(*) AS n FROM ({DIFF_SQL}) d GROUP BY 1")
def _(spark, sf):
    return R.counted(R.sidecar_diff(*old_new(spark, sf)), "change")


@query(
    "a18_type_shift",
    f"""SELECT doc_type, coalesce(b, 0) AS before_n, coalesce(a, 0) AS after_n, coalesce(a, 0) - coalesce(b, 0) AS delta FROM (SELECT before AS doc_type, count(*) AS b FROM ({DIFF_SQL}) d WHERE before IS NOT NULL GROUP BY 1) x
    FULL OUTER JOIN (SELECT after AS doc_type, count(*) AS a FROM ({DIFF_SQL}) d WHERE after IS NOT NULL GROUP BY 1) y USING (doc_type)""",
)
def _(spark, sf):
    return R.type_shift(R.sidecar_diff(*old_new(spark, sf)))


@query("a19_transitions", f"SELECT * FROM ({MOVES_SQL}) m ORDER BY n DESC, before, after LIMIT 20")
def _(spark, sf):
    return R.transitions(R.sidecar_diff(*old_new(spark, sf)), 20)


@query("a19_improved_share", f"SELECT count(*) FILTER (WHERE before = 'document') AS generic_before, count(*) FILTER (WHERE before = 'document' AND coalesce(after, 'document') <> 'document') AS improved, round(100.0 * count(*) FILTER (WHERE before = 'document' AND coalesce(after, 'document') <> 'document') / count(*) FILTER (WHERE before = 'document'), 1) AS pct FROM ({DIFF_SQL}) d")
def _(spark, sf):
    return R.improved_share(R.sidecar_diff(*old_new(spark, sf)))


@query("w6_transition_samples", f"SELECT before, after, uri, sample, n FROM (SELECT coalesce(before, '(none)') AS before, coalesce(after, '(none)') AS after, uri, row_number() OVER (PARTITION BY before, after ORDER BY uri) AS sample, count(*) OVER (PARTITION BY before, after) AS n FROM ({DIFF_SQL}) d WHERE change <> 'unchanged') x WHERE n >= 5 AND sample <= 3")
def _(spark, sf):
    return R.transition_samples(R.sidecar_diff(*old_new(spark, sf)), 3, 5)


@query("w5_samples_per_bucket", f"SELECT guess_bucket, uri, sample FROM (SELECT *, row_number() OVER (PARTITION BY guess_bucket ORDER BY name, uri) AS sample FROM {_G}) x WHERE sample <= 8")
def _(spark, sf):
    return R.samples_per(guesses(spark, sf), ["guess_bucket"], ["name", "uri"], 8).select("guess_bucket", "uri", "sample")


@query(
    "w8_read_limit",
    f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN {rules.LIST_LIMIT} WHEN 1 THEN {rules.FACT_READ_LIMIT} ELSE {rules.SYNTHESIS_READ_LIMIT} END AS read_limit FROM orders""",
)
def _(spark, sf):
    asked = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'list all files' WHEN 1 THEN 'what is the price' ELSE 'tell me more' END")
    return table(spark, sf, "orders").select("o_orderkey", R.read_limit(asked).alias("read_limit"))


@query("w8_head", f"SELECT uri, size_bytes FROM {K} ORDER BY size_bytes DESC, uri LIMIT 100")
def _(spark, sf):
    return R.head(corpus(spark, sf).select("uri", "size_bytes"), [col("size_bytes").desc(), col("uri")], rules.LIST_LIMIT)


# -- time -------------------------------------------------------------------

_LAST_DAY = "(SELECT max(CAST(ts AS DATE)) FROM events)"


def _today(spark, sf):
    return table(spark, sf, "events").agg(F.max(F.to_date("ts")).alias("d")).scalar()


@query("a26_daily_usage", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= {_LAST_DAY} + INTERVAL 80 DAY - INTERVAL 90 DAY GROUP BY 1")
def _(spark, sf):
    # As seen 80 days after the last event, so that the window of 90 days cuts the log.
    return R.daily_usage(table(spark, sf, "events"), "ts", F.date_add(_today(spark, sf), 80)).withColumn("day", col("day").cast("string"))


@query("a26_usage_totals", "SELECT count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS today, count(*) FILTER (WHERE strftime(ts, '%Y-%m') = '2024-01') AS this_month, count(*) AS all_time FROM events")
def _(spark, sf):
    return R.usage_totals(table(spark, sf, "events"), "ts", F.lit("2024-01-15").cast("date"))


@query(
    "a27_cost_estimate",
    f"""SELECT round(d, 2) AS doc_hosting, round(s, 4) AS storage, round(q, 2) AS api_queries, round(d + s + q, 2) AS total_monthly FROM (
      SELECT count(*) / 1000.0 * 2.5 AS d, sum(size_bytes) / 1073741824.0 * 0.026 AS s, (SELECT count(*) FROM events) / 1000.0 * 4.0 AS q FROM {K}) x""",
)
def _(spark, sf):
    asked = table(spark, sf, "events").agg(F.count("*").alias("n")).scalar()
    totals = corpus(spark, sf).agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("bytes")).withColumn("asked", asked)
    return totals.select(*R.cost_estimate(col("docs"), col("bytes"), col("asked")))


_SESS = """WITH t AS (SELECT {k} ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > CAST({gap} AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS o FROM events WINDOW w AS ({p} ORDER BY ts, event_id)),
  g AS (SELECT *, sum(o) OVER ({p} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM t)
  SELECT {k} strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS run_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS run_end, count(*) AS n FROM g GROUP BY {k} s"""


def _stamped(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("run_start", "run_end")})


@query("w3_runs", _SESS.format(k="", p="", gap=900))
def _(spark, sf):
    return _stamped(H.runs(table(spark, sf, "events"), "ts"))


@query("w3_runs_per_user", _SESS.format(k="user_id,", p="PARTITION BY user_id", gap=3600))
def _(spark, sf):
    return _stamped(H.runs(table(spark, sf, "events"), "ts", 3600, ["user_id"]))


@query("w3_latest_run", f"SELECT * FROM ({_SESS.format(k='', p='', gap=900)}) r ORDER BY run_start DESC LIMIT 1")
def _(spark, sf):
    return _stamped(H.latest_run(table(spark, sf, "events"), "ts"))


PASSED_SQL = f"""SELECT strftime(h, '%Y-%m-%d %H') AS hour, calls, array_to_string(list_filter({list(rules.CALL_THRESHOLDS)}, lambda t: t <= calls), ',') AS passed
  FROM (SELECT date_trunc('hour', ts) AS h, count(*) AS calls FROM events GROUP BY 1) x"""


@query("x2_hourly_thresholds", PASSED_SQL)
def _(spark, sf):
    h = H.hourly_thresholds(table(spark, sf, "events"), "ts", rules.CALL_THRESHOLDS)
    return h.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "calls", F.array_join("passed", ",").alias("passed"))


_TRAILING = "SELECT a.event_id, count(*) AS trailing, count(*) >= {cap} AS at_cap FROM events a JOIN events b ON epoch_us(b.ts) <= epoch_us(a.ts) AND epoch_us(b.ts) >= epoch_us(a.ts) - {us} GROUP BY 1"


@query("x3_trailing_rate", _TRAILING.format(cap=rules.MINUTE_CALL_CAP, us=60_000_000))
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts").join(H.trailing_counts(e, "ts", 60, rules.MINUTE_CALL_CAP), "ts").select("event_id", "trailing", "at_cap")


@query("x3_trailing_rate_wide", _TRAILING.format(cap=5, us=600_000_000))
def _(spark, sf):
    # The events are sparse: ten minutes and a cap of five reach both sides of the comparison.
    e = table(spark, sf, "events")
    return e.select("event_id", "ts").join(H.trailing_counts(e, "ts", 600, 5), "ts").select("event_id", "trailing", "at_cap")


# -- set operations ---------------------------------------------------------


@query(
    "u1_priority_union",
    f"""WITH a AS (SELECT uri, 0 AS priority FROM {K} WHERE category = 'Claims' UNION ALL SELECT uri, 1 FROM {K} WHERE property LIKE '%Brand#1%' UNION ALL SELECT uri, 2 FROM {K} WHERE contains(lower(name), 'invoice'))
    SELECT uri, min(priority) AS priority FROM a GROUP BY 1""",
)
def _(spark, sf):
    k = corpus(spark, sf).select("uri", "category", "property", "name")
    parts = [k.filter("category = 'Claims'"), k.filter("property like '%Brand#1%'"), k.filter(F.lower("name").contains("invoice"))]
    return S.priority_union([p.select("uri") for p in parts], ["uri"])


@query(
    "u2_two_pass_union",
    f"""WITH a AS (SELECT property, file_no, 0 AS priority, file_no AS rank FROM {K} WHERE category <> 'Claims' UNION ALL SELECT property, file_no, 1, -file_no FROM {K} WHERE file_no % 2 = 0),
      b AS (SELECT *, row_number() OVER (PARTITION BY property, file_no ORDER BY priority, rank) AS rn FROM a)
    SELECT property, file_no, priority, row_number() OVER (PARTITION BY property ORDER BY priority, rank, file_no) AS position FROM b WHERE rn = 1""",
)
def _(spark, sf):
    k = corpus(spark, sf)
    first = k.filter("category <> 'Claims'").select("property", "file_no", col("file_no").alias("rank"))
    second = k.filter("file_no % 2 = 0").select("property", "file_no", (-col("file_no")).alias("rank"))
    return S.two_pass(first, second, ["property", "file_no"]).drop("rank")


@query("u3_first_per_title", f"SELECT title, min(file_no) AS file_no FROM (SELECT regexp_replace(name, '[0-9]+', '') AS title, file_no FROM {K}) x GROUP BY 1")
def _(spark, sf):
    t = corpus(spark, sf).select(F.regexp_replace("name", "^([^0-9]*)[0-9]+", "$1").alias("title"), "file_no")
    return S.first_per(t, ["title"], ["file_no"])


@query("u5_common_paths", f"SELECT path, 'both' AS side FROM {K} WHERE category = 'Claims' AND file_no % 2 = 0 UNION ALL SELECT path, 'missed' FROM {K} WHERE category = 'Claims' AND file_no % 2 <> 0")
def _(spark, sf):
    k = corpus(spark, sf)
    a, b = k.filter("category = 'Claims'").select("path"), k.filter("file_no % 2 = 0").select("path")
    return S.common_paths(a, b).withColumn("side", F.lit("both")).unionByName(S.missed_paths(a, b).withColumn("side", F.lit("missed")))


@query(
    "a28_retrieval_overlap",
    f"""SELECT property, count(*) FILTER (WHERE a AND b) AS overlap, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b
    FROM (SELECT property, contains(lower(name), 'e') AS a, category = 'Claims' OR category = '99-Misc' AS b FROM {K}) x WHERE a OR b GROUP BY 1""",
)
def _(spark, sf):
    k = corpus(spark, sf)
    return S.path_overlap(k.filter(F.lower("name").contains("e")), k.filter("category in ('Claims', '99-Misc')"), "property")


