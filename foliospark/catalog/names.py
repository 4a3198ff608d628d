"""Registered queries: name, path and id functions; classifiers and predicates."""

from pyspark.sql import functions as F

from .. import rules
from ..functions import classify as C
from ..functions import names as N
from ..functions.templates import clean_answer, fill_templates, placeholder_queries, placeholders
from ..operators.folders import with_doc_type
from .base import (
    CORPUS_SQL, EVENTS_SQL, ITEMS_SQL, SIDECAR_SQL, TEXT_SQL, bucket_sql, case_of, corpus, events, items, lit, matches,
    name_type_sql, norm_sql, query, sidecar, sql_list, stem_sql, table, texts,
)

K = f"({CORPUS_SQL}) k"
col = F.col

# -- names ------------------------------------------------------------------


@query("n1_normalize_name", f"SELECT file_no, {norm_sql('name')} AS name_norm, {norm_sql('property')} AS property_norm FROM {K}")
def _(spark, sf):
    return corpus(spark, sf).select(
        "file_no", N.normalize_name(col("name")).alias("name_norm"), N.normalize_name(col("property")).alias("property_norm")
    )


@query(
    "n2_normalize_title",
    rf"SELECT file_no, trim(regexp_replace({stem_sql('lower(name)')}, '[\s_\-.]+', ' ', 'g')) AS title_norm FROM {K}",
)
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.normalize_title(col("name")).alias("title_norm"))




@query(
    "n3_strip_filler",
    f"""SELECT conv_id, turn, array_to_string(list_filter(string_split(n, ' '), lambda w: w <> '' AND w NOT IN ({sql_list(rules.QUERY_STOP_WORDS)})), ' ') AS core
    FROM (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS n FROM conversations) t""",
)
def _(spark, sf):
    norm = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    return table(spark, sf, "conversations").select("conv_id", "turn", N.strip_filler(norm).alias("core"))


@query(
    "n4_distinctive_words",
    f"""SELECT file_no, array_to_string(list_sort(list_distinct(list_filter(string_split({norm_sql('name')}, ' '),
      lambda w: (regexp_matches(w, '[0-9]') OR length(w) >= 4) AND w NOT IN ({sql_list(rules.CATEGORY_NOISE_WORDS)})))), ' ') AS words FROM {K}""",
)
def _(spark, sf):
    words = N.distinctive(N.normalize_name(col("name")))
    return corpus(spark, sf).select("file_no", F.array_join(F.array_sort(words), " ").alias("words"))


@query(
    "n5_extract_property",
    f"""SELECT file_no, split_part(path, '/', 2) AS whole,
      CASE WHEN len(string_split(path, '/')) >= 4 THEN split_part(path, '/', 3) ELSE '' END AS scoped FROM {K}""",
)
def _(spark, sf):
    return corpus(spark, sf).select(
        "file_no", N.extract_property(col("path")).alias("whole"), N.extract_property(col("path"), "Properties").alias("scoped")
    )


@query(
    "n6_path_folders",
    f"SELECT DISTINCT unnest(list_slice(string_split(path, '/'), 2, -2)) AS folder FROM {K}",
)
def _(spark, sf):
    from ..operators.folders import folder_set

    return folder_set(corpus(spark, sf))


@query(
    "n7_extension_flags",
    f"""SELECT file_no, regexp_matches(lower(name), '\\.(pdf|docx|doc|xlsx|xls|csv|txt|pptx|ppt|md)$') AS searchable,
      lower(name) LIKE '%.html' AS marker, regexp_matches(lower(name), '\\.(pdf|docx|doc|xlsx|xls|csv|txt|pptx|ppt|md|html)$') AS enumerable FROM {K}""",
)
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.ext_flags(col("name")).alias("f")).select("file_no", "f.*")


_MONTH_CASES = [(f"contains(lower(name), {lit(m)})", lit(f"2024-{i:02d}")) for i, m in enumerate(rules.MONTHS, 1)]


@query(
    "n8_extract_date",
    f"""SELECT file_no, CASE WHEN regexp_matches(name, '^[0-9]{{8}}') AND substr(name, 1, 4) BETWEEN '2015' AND '2030'
      AND substr(name, 5, 2) BETWEEN '01' AND '12' AND substr(name, 7, 2) BETWEEN '01' AND '31'
      THEN substr(name, 1, 4) || '-' || substr(name, 5, 2) || '-' || substr(name, 7, 2)
      ELSE {case_of(_MONTH_CASES, "''")} END AS doc_date FROM {K}""",
)
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.extract_date(col("name"), 2024).alias("doc_date"))


_ID = "substr(trim(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 128)"


@query(
    "n9_doc_id",
    f"""WITH i AS (SELECT p_partkey, concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '_' END, p_type, '/', p_name) AS path FROM part),
    d AS (SELECT *, {_ID.format('path')} AS id FROM i), f AS (SELECT id, min(path) AS first FROM d GROUP BY id)
    SELECT p_partkey, d.id AS plain_id, CASE WHEN path = first THEN d.id ELSE substr(d.id, 1, 120) || '_' || substr(sha1(path), 1, 7) END AS doc_id
    FROM d JOIN f USING (id)""",
)
def _(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "path", F.expr("concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '_' END, p_type, '/', p_name)")
    )
    return N.with_unique_doc_id(part).select("p_partkey", N.doc_id(col("path")).alias("plain_id"), "doc_id")


@query("n10_content_id", f"SELECT file_no, sha1(uri) AS id FROM {K}")
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.doc_sha1(col("uri")).alias("id"))


@query(
    "n11_repair_title",
    f"""SELECT file_no, CASE WHEN regexp_matches(name, '^[0-9]{{17,}}') THEN property || ' — ' || 'Scanned Document' ELSE name END AS title FROM {K}""",
)
def _(spark, sf):
    return corpus(spark, sf).select(
        "file_no", N.repair_title(col("name"), col("property"), C.doc_type_from_name(col("name"))).alias("title")
    )


@query(
    "n12_extract_context",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey % 100000, ' Oak O''Neil Lane')
      WHEN c_custkey % 3 = 1 THEN concat('JOB-2024-', lpad(concat('', c_custkey % 1000), 3, '0')) END AS context FROM customer""",
)
def _(spark, sf):
    text = F.expr(
        """CASE c_custkey % 3 WHEN 0 THEN concat('show me ', c_custkey % 100000, ' oak o''neil LANE summary please')
        WHEN 1 THEN concat('status of job-2024-', lpad(concat('', c_custkey % 1000), 3, '0'), '?') ELSE concat('balance ', c_name) END"""
    )
    return table(spark, sf, "customer").select("c_custkey", N.extract_context(text).alias("context"))


def _steps_sql(expr: str) -> str:
    for pattern, mark in rules.NAME_PATTERN_STEPS:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(mark)}, 'g')"
    return expr


_STAMPED = "concat(replace(name, '.', ' (2).'), ' 2024-01-', lpad(concat('', 1 + file_no % 28), 2, '0'), ' in 2019')"


@query("n13_name_pattern", f"SELECT file_no, {_steps_sql(f'lower({_STAMPED})')} AS pattern FROM {K}")
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.name_pattern(F.expr(_STAMPED)).alias("pattern"))


_ADDRESS = "concat(c_custkey, ' ', c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN ' Street' WHEN 1 THEN ' Ave. N' WHEN 2 THEN '-Lane' ELSE '' END)"


@query(
    "n14_normalize_address",
    f"""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower({_ADDRESS}), '{rules.STREET_PATTERN}', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS address FROM customer""",
)
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.normalize_address(F.expr(_ADDRESS)).alias("address"))


@query("n15_category_name", f"SELECT file_no, regexp_replace(category, '^[0-9]{{1,3}}-', '') AS category FROM {K}")
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.category_name(col("category")).alias("category"))


@query(
    "n16_source_uri",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('l/', page_id) WHEN 2 THEN concat('s/', page_id) ELSE concat('d/', page_id) END AS uri FROM pages""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    at = lambda i, c: F.when(col("page_id") % 4 == i, c).otherwise("")
    late = lambda tag: F.concat(F.lit(tag), col("page_id"))
    return p.select("page_id", N.source_uri(at(0, col("url")), at(1, late("l/")), at(2, late("s/")), late("d/")).alias("uri"))


@query(
    "n17_snippet_text",
    r"""SELECT page_id, substr(array_to_string(list_filter(list_transform(list_slice(string_split(html, '</p>'), 1, 3),
      lambda s: regexp_replace(regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '^\s+', ''), '\s+$', '')), lambda s: s <> ''), ' ... '), 1, 600) AS snippet FROM pages""",
)
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.snippet_text(F.split("html", "</p>")).alias("snippet"))


# -- filters ----------------------------------------------------------------


@query("f1_since", f"SELECT event_id FROM ({EVENTS_SQL}) e WHERE generated_at >= TIMESTAMP '1998-01-01'")
def _(spark, sf):
    from ..sources.events_log import since

    return events(spark, sf).filter(since(col("generated_at"), "1998-01-01")).select("event_id")


@query("f2_meta_filter", f"SELECT file_no FROM {K} WHERE category = 'Claims' AND property LIKE '10 %' AND property = '10 Brand#3 water claim'")
def _(spark, sf):
    return corpus(spark, sf).filter(C.meta_filter(category="Claims", property="10 Brand#3 water claim", person=None)).select("file_no")


@query(
    "f3_exclude_with_fallback",
    f"""WITH t AS (SELECT property, uri, {name_type_sql('name')} AS doc_type FROM {K}),
    w AS (SELECT * FROM t WHERE doc_type IS DISTINCT FROM 'scanned_document')
    SELECT property, uri, false AS fell_back FROM w UNION ALL SELECT property, uri, true FROM t WHERE property NOT IN (SELECT property FROM w)""",
)
def _(spark, sf):
    from ..operators.search import excluding_type

    typed = with_doc_type(corpus(spark, sf), None).select("property", "uri", "doc_type")
    return excluding_type(typed, "property").drop("doc_type")


_AUDITED = f"({CORPUS_SQL}) k LEFT JOIN ({SIDECAR_SQL}) s USING (uri)"


@query(
    "f4_audit_filter",
    f"SELECT file_no FROM {_AUDITED} WHERE (doc_type IS NULL OR doc_type IN ('other','document','unknown')) AND contains(lower(path), 'claim')",
)
def _(spark, sf):
    joined = corpus(spark, sf).join(sidecar(spark, sf), "uri", "left")
    return joined.filter(C.audit_filter(col("doc_type"), col("path"), folder="Claim")).select("file_no")


_FILLER_FIELD = "CASE o_orderkey % 2 WHEN 0 THEN 'property_address' ELSE 'claim_number' END"
_FILLER_VALUE = """CASE o_orderkey % 8 WHEN 0 THEN 'N/A' WHEN 1 THEN ' -- ' WHEN 2 THEN concat(o_orderkey, ' Elm, NY 11111')
  WHEN 3 THEN '1930' WHEN 4 THEN '1930' WHEN 5 THEN 'TBD' WHEN 6 THEN concat(o_orderkey, ' Elm') ELSE concat('C-', o_orderkey) END"""
_GENERAL = "|".join(f"(?:{p})" for p in rules.PLACEHOLDERS)


@query(
    "f5_placeholder",
    f"""SELECT o_orderkey, {matches('trim(v)', _GENERAL)} OR (f = 'property_address' AND {matches('trim(v)', '|'.join(f'(?:{p})' for p in rules.FIELD_PLACEHOLDERS['property_address']))})
      OR (f = 'claim_number' AND trim(v) = '1930') AS filler FROM (SELECT o_orderkey, {_FILLER_FIELD} AS f, {_FILLER_VALUE} AS v FROM orders) o""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", C.is_placeholder(F.expr(_FILLER_FIELD), F.expr(_FILLER_VALUE)).alias("filler")
    )


@query(
    "f6_folder_name_flags",
    f"SELECT file_no, property LIKE '% Forms' AS is_admin, property LIKE '%water claim' AS is_claim FROM {K}",
)
def _(spark, sf):
    return corpus(spark, sf).select("file_no", N.is_admin(col("property")).alias("is_admin"), N.is_claim(col("property")).alias("is_claim"))


_ASK = """CASE o_orderkey % 7 WHEN 0 THEN concat('what is missing for F', o_custkey) WHEN 1 THEN concat('Summarize F', o_custkey)
  WHEN 2 THEN concat('how much is it worth? ', o_custkey) WHEN 3 THEN concat('list all files of F', o_custkey)
  WHEN 4 THEN concat('building permit date for ', o_custkey) WHEN 5 THEN concat('signed contract F', o_custkey) ELSE concat('photos of F', o_custkey) END"""


@query(
    "f7_should_render",
    f"SELECT o_orderkey, (o_orderkey % 7 = 0 OR o_orderstatus = 'F') AS render FROM orders",
)
def _(spark, sf):
    purpose = F.when(col("o_orderstatus") == "F", rules.CLAIM).otherwise("unknown")
    return table(spark, sf, "orders").select("o_orderkey", C.should_render_open_items(purpose, F.expr(_ASK)).alias("render"))


# -- classifiers ------------------------------------------------------------

CATEGORIES = {"02-Financials": "finance", "04-Permits": "permit", "06-Invoices": "billing", "07-Photos": "image", "Claims": "legal"}
HEURISTICS = [
    {"pattern": r"\.(jpg|jpeg|png)$", "doc_type": "image"},
    {"pattern": "invoice|receipt", "doc_type": "billing", "property": "Ledger"},
    {"pattern": "permit", "doc_type": "permit"},
    {"pattern": "appraisal|deed", "doc_type": "legal"},
]
STRICT_SQL = f"(file_no % 6 <> 0 AND category <> '99-Misc')"
STRICT_TYPE_SQL = case_of([(f"category = {lit(k)}", lit(v)) for k, v in CATEGORIES.items()])
HEUR_TYPE_SQL = case_of([(matches("name", r["pattern"]), lit(r["doc_type"])) for r in HEURISTICS])
HEUR_PROP_SQL = case_of([(matches("name", r["pattern"]), lit(r.get("property") or "General")) for r in HEURISTICS])


@query(
    "c1_strict_tags",
    f"""SELECT file_no, property, regexp_replace(category, '^[0-9]{{1,3}}-', '') AS category, {STRICT_TYPE_SQL} AS doc_type, '' AS subpath, name AS filename
    FROM {K} WHERE {STRICT_SQL}""",
)
def _(spark, sf):
    tagged = corpus(spark, sf).select("file_no", C.classify_strict(col("path"), CATEGORIES).alias("t"))
    return tagged.filter("t is not null").select("file_no", "t.*")


@query(
    "c2_heuristic_tags",
    f"""SELECT file_no, {HEUR_PROP_SQL} AS property, upper(substr({HEUR_TYPE_SQL}, 1, 1)) || substr({HEUR_TYPE_SQL}, 2) AS category,
      {HEUR_TYPE_SQL} AS doc_type, '' AS subpath, name AS filename FROM {K} WHERE {HEUR_TYPE_SQL} IS NOT NULL""",
)
def _(spark, sf):
    tagged = corpus(spark, sf).select("file_no", C.classify_heuristic(col("path"), HEURISTICS, "General").alias("t"))
    return tagged.filter("t is not null").select("file_no", "t.*")


TAGGED_SQL = f"""SELECT k.*, {STRICT_SQL} AS strict_ok, CASE WHEN {STRICT_SQL} THEN property ELSE {HEUR_PROP_SQL} END AS t_property,
  CASE WHEN {STRICT_SQL} THEN {STRICT_TYPE_SQL} ELSE {HEUR_TYPE_SQL} END AS t_type FROM {K}"""


@query("c3_tags", f"SELECT file_no, t_property AS property, t_type AS doc_type FROM ({TAGGED_SQL}) t WHERE t_type IS NOT NULL")
def _(spark, sf):
    tagged = corpus(spark, sf).select("file_no", C.classify_path(col("path"), CATEGORIES, HEURISTICS, "General").alias("t"))
    return tagged.filter("t is not null").select("file_no", "t.property", "t.doc_type")


@query("c4_type_from_name", f"SELECT file_no, {name_type_sql('name')} AS doc_type FROM {K}")
def _(spark, sf):
    return corpus(spark, sf).select("file_no", C.doc_type_from_name(col("name")).alias("doc_type"))


def content_sql(source: str, content_rules, key: str = "doc_id", min_chars: int = 0) -> str:
    """Check SQL of the content rules: type, confidence and number of signals."""
    cols, cases_t, cases_c, cases_n = [], [], [], []
    for i, (t, strong, weak) in enumerate(content_rules):
        s = " OR ".join(matches("text", p) for p in strong) or "false"
        w = " + ".join(f"CAST({matches('text', p)} AS INTEGER)" for p in weak) or "0"
        cols += [f"({s}) AS s{i}", f"({w}) AS w{i}"]
        cases_t.append((f"s{i} OR w{i} >= 2", lit(t)))
        cases_c += [(f"s{i}", "'strong'"), (f"w{i} >= 2", "'weak'")]
        cases_n += [(f"s{i}", "1"), (f"w{i} >= 2", f"w{i}")]
    long = f"length(text) >= {min_chars}"
    return f"""SELECT {key}, CASE WHEN long THEN {case_of(cases_t)} END AS doc_type, CASE WHEN long THEN {case_of(cases_c)} END AS confidence,
      CAST(CASE WHEN long THEN {case_of(cases_n, '0')} ELSE 0 END AS INTEGER) AS n_signals
      FROM (SELECT {key}, {long} AS long, {', '.join(cols)} FROM ({source}) src) m"""


TEST_RULES = [
    ("license_note", [r"copyright|license"], [r"estion", r"ndly"]),
    ("prose", [r"\bnever occurs\b"], [r"thon", r"thth", r"estion"]),
    ("french", [], [r"\bles?\b", r"\bdes\b", r"eaux"]),
]


def _verdict(df, key, content_rules, min_chars=0):
    v = df.select(key, C.classify_text(col("text"), content_rules, min_chars).alias("v"))
    return v.select(key, "v.doc_type", "v.confidence", F.size("v.signals").alias("n_signals"))


@query("c5_content_type", content_sql(TEXT_SQL, rules.CONTENT_RULES))
def _(spark, sf):
    return _verdict(texts(spark, sf), "doc_id", rules.CONTENT_RULES)


@query("c5_content_type_long_texts", content_sql("SELECT doc_id, text FROM documents", TEST_RULES, min_chars=rules.CONTENT_MIN_CHARS))
def _(spark, sf):
    return _verdict(table(spark, sf, "documents"), "doc_id", TEST_RULES, rules.CONTENT_MIN_CHARS)


@query("c5_content_type_test_rules", content_sql("SELECT doc_id, text FROM documents", TEST_RULES))
def _(spark, sf):
    return _verdict(table(spark, sf, "documents"), "doc_id", TEST_RULES)


_RESOLVED = f"SELECT k.*, c.doc_type AS content_type FROM {K} LEFT JOIN ({content_sql(TEXT_SQL, rules.CONTENT_RULES)}) c ON c.doc_id = k.file_no"


def _resolved(spark, sf, pointer_bytes=None):
    content = _verdict(texts(spark, sf), "doc_id", rules.CONTENT_RULES).select(col("doc_id").alias("file_no"), col("doc_type").alias("content_type"))
    joined = corpus(spark, sf).join(content, "file_no", "left")
    return joined.select("file_no", C.resolve_doc_type(col("name"), col("size_bytes"), col("content_type"), pointer_bytes).alias("doc_type"))


@query("c6_resolved_type", f"SELECT file_no, coalesce(content_type, {name_type_sql('name')}) AS doc_type FROM ({_RESOLVED}) r")
def _(spark, sf):
    return _resolved(spark, sf)


@query(
    "c6_large_pdf_pointers",
    f"""SELECT file_no, CASE WHEN lower(name) LIKE '%.pdf' AND size_bytes > {rules.LARGE_PDF_BYTES} THEN 'large_pdf_pointer'
      ELSE coalesce(content_type, {name_type_sql('name')}) END AS doc_type FROM ({_RESOLVED}) r""",
)
def _(spark, sf):
    return _resolved(spark, sf, rules.LARGE_PDF_BYTES)


LAYERED_SQL = f"SELECT k.*, coalesce(nullif(s.doc_type, ''), {name_type_sql('name')}) AS doc_type FROM {K} LEFT JOIN ({SIDECAR_SQL}) s USING (uri)"


@query("c7_layered_type", f"SELECT file_no, doc_type FROM ({LAYERED_SQL}) t")
def _(spark, sf):
    return with_doc_type(corpus(spark, sf), sidecar(spark, sf)).select("file_no", "doc_type")


@query(
    "c8_needs_ocr",
    f"""SELECT file_no, {matches('name', rules.SCAN_NAME)} OR (size_bytes > 500000 AND regexp_matches({stem_sql('name')}, '^[0-9]+$')) AS needs_ocr FROM {K}""",
)
def _(spark, sf):
    return corpus(spark, sf).select("file_no", C.needs_ocr(col("path"), col("size_bytes")).alias("needs_ocr"))


AUDIT_SQL = f"""SELECT file_no, size_bytes, chars, ocr, CAST(floor(chars / greatest(size_bytes / 1000000.0, 0.01)) AS BIGINT) AS chars_per_mb,
  CASE WHEN chars > 0 THEN 'tier1_extracted' WHEN ocr AND file_no % 2 = 0 THEN 'tier2_ocr_cached' WHEN ocr THEN 'tier2_ocr_live' ELSE 'tier3_passthrough' END AS production_tier
  FROM (SELECT file_no, size_bytes, {matches('name', rules.SCAN_NAME)} AS ocr, CAST(CASE WHEN file_no % 4 = 0 THEN 0 ELSE file_no % 150 END AS BIGINT) AS chars FROM {K}) a"""
AUDIT_FLAG_SQL = f"""SELECT *, CASE WHEN chars > 0 AND chars_per_mb < 200 THEN 'thin_text_layer_accepted' WHEN ocr AND chars > 0 THEN 'scan_pattern_but_tier1_succeeded'
  WHEN production_tier = 'tier2_ocr_live' THEN 'ocr_pending_first_run' WHEN production_tier = 'tier3_passthrough' THEN 'passthrough_check_filename' ELSE '' END AS flag FROM ({AUDIT_SQL}) a"""


def audit(spark, sf):
    """Extraction audit rows of the corpus with derived character counts."""
    rows = corpus(spark, sf).select(
        "file_no", "size_bytes", C.needs_ocr(col("path"), F.lit(0)).alias("ocr"),
        F.when(col("file_no") % 4 == 0, 0).otherwise(col("file_no") % 150).cast("bigint").alias("chars"),
    )
    rows = rows.withColumn("chars_per_mb", C.chars_per_mb(col("chars"), col("size_bytes")))
    rows = rows.withColumn("production_tier", C.extraction_tier(col("chars"), col("ocr"), col("file_no") % 2 == 0))
    return rows.withColumn("flag", C.extraction_flag(col("chars"), col("size_bytes"), col("ocr"), col("production_tier")))


@query("c9_extraction_tier", f"SELECT file_no, production_tier FROM ({AUDIT_SQL}) a")
def _(spark, sf):
    return audit(spark, sf).select("file_no", "production_tier")


@query("c10_extraction_flag", f"SELECT file_no, chars_per_mb, flag FROM ({AUDIT_FLAG_SQL}) a")
def _(spark, sf):
    return audit(spark, sf).select("file_no", "chars_per_mb", "flag")


@query("c11_bucket", f"SELECT file_no, {bucket_sql('doc_type', 'name')} AS bucket FROM ({LAYERED_SQL}) t")
def _(spark, sf):
    typed = with_doc_type(corpus(spark, sf), sidecar(spark, sf))
    return typed.select("file_no", C.bucket_of(col("doc_type"), col("name")).alias("bucket"))


_HAY = "lower(concat(name, ' ', path))"


def _guess_cases(i: int):
    cases = [(matches(_HAY, r[2], ""), lit(r[i]) if i < 2 else "'filename_match'") for r in rules.GUESS_RULES]
    return cases + [(matches("lower(name)", p, ""), lit((b, t)[i]) if i < 2 else "'extension'") for p, b, t in rules.GUESS_EXT_RULES]


GUESS_SQL = f"""SELECT k.*, {case_of(_guess_cases(0))} AS g_bucket, {case_of(_guess_cases(1))} AS g_type, {case_of(_guess_cases(2), "'no_signal'")} AS g_basis FROM {K}"""


@query("c12_guess", f"SELECT file_no, g_bucket, g_type, g_basis FROM ({GUESS_SQL}) g")
def _(spark, sf):
    g = C.guess(col("name"), col("path"))
    return corpus(spark, sf).select("file_no", g.alias("g")).select(
        "file_no", col("g.bucket").alias("g_bucket"), col("g.doc_type").alias("g_type"), col("g.basis").alias("g_basis")
    )


_INTENT_SQL = case_of([(matches("lower(q)", p, ""), lit(t)) for p, t in rules.QUERY_INTENT_RULES])


@query("c13_query_intent", f"SELECT o_orderkey, {_INTENT_SQL} AS intent FROM (SELECT o_orderkey, {_ASK} AS q FROM orders) o")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.query_intent(F.expr(_ASK)).alias("intent"))


def _any_sql(col_, phrases):
    return " OR ".join(f"contains({col_}, {lit(p)})" for p in phrases)


@query(
    "c14_query_mode",
    f"""SELECT o_orderkey, CASE WHEN {_any_sql('lower(q)', rules.LIST_PHRASES)} THEN 'list' WHEN {_any_sql('lower(q)', rules.FACT_PHRASES)} THEN 'fact' ELSE 'synthesis' END AS mode
    FROM (SELECT o_orderkey, {_ASK} AS q FROM orders) o""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.query_mode(F.expr(_ASK)).alias("mode"))


@query(
    "c15_is_summary",
    f"SELECT o_orderkey, {matches('q', '|'.join(f'(?:{p})' for p in rules.SUMMARY_PATTERNS))} AS is_summary FROM (SELECT o_orderkey, {_ASK} AS q FROM orders) o",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", C.is_summary_query(F.expr(_ASK)).alias("is_summary"))


BUCKETED_SQL = f"SELECT t.*, {bucket_sql('doc_type', 'name')} AS bucket, lower(name) LIKE '%.html' AS is_marker FROM ({LAYERED_SQL}) t"
PURPOSE_OF_SQL = f"""SELECT property, CASE WHEN property LIKE '% Forms' THEN 'unknown'
  WHEN bool_or(bucket IN ('insurance','estimate','photos')) THEN 'claim_restoration'
  WHEN property LIKE '%water claim' AND (bool_or(bucket IN ('report','contract','invoice')) OR bool_or(is_marker)) THEN 'claim_restoration'
  WHEN bool_or(bucket IN ('appraisal','contract')) AND property NOT LIKE '%water claim' THEN 'property_appraisal' ELSE 'unknown' END AS folder_purpose,
  CASE WHEN bool_or(bucket IN ('insurance','estimate','photos')) THEN 'claim_restoration' WHEN bool_or(bucket IN ('appraisal','contract')) THEN 'property_appraisal' ELSE 'unknown' END AS predicted
  FROM ({BUCKETED_SQL}) b GROUP BY property"""


def property_items(spark, sf):
    """Files with type, bucket and marker flag, grouped by their property folder."""
    from ..operators.folders import inventory_items

    files = inventory_items(corpus(spark, sf), sidecar(spark, sf))
    return files.withColumn("is_marker", F.lower("name").endswith(".html"))


@query("c16_folder_purpose", f"SELECT property, folder_purpose FROM ({PURPOSE_OF_SQL}) p")
def _(spark, sf):
    from ..operators.folders import folder_purpose

    return folder_purpose(property_items(spark, sf), "property").select("property", "folder_purpose")


@query("c17_predicted_purpose", f"SELECT property, predicted FROM ({PURPOSE_OF_SQL}) p")
def _(spark, sf):
    sets = property_items(spark, sf).groupBy("property").agg(F.collect_set("bucket").alias("b"))
    return sets.select("property", C.predicted_purpose_from(col("b")).alias("predicted"))


@query(
    "c18_evidence_grade",
    f"""WITH i AS (SELECT event_id, count(*) AS total, count(*) FILTER (WHERE is_marker) AS markers, count(*) FILTER (WHERE bucket = 'A') AS facts,
        count(DISTINCT CASE WHEN bucket = 'A' THEN l_suppkey END) AS srcs,
        count(DISTINCT CASE WHEN bucket = 'A' AND l_suppkey % 2 = 0 THEN l_suppkey END) AS forms FROM ({ITEMS_SQL}) x GROUP BY event_id),
      e AS (SELECT event_id, folder_purpose AS purpose, event_id % 10 = 0 AS scanned, event_id % 6 = 0 AS template FROM ({EVENTS_SQL}) y)
    SELECT event_id, CASE WHEN total >= 5 AND (facts <= 1 OR scanned) THEN 'low-evidence'
      WHEN total <= 3 OR markers = total OR (total <= 4 AND total - markers <= 2) THEN 'skeleton'
      WHEN purpose = 'unknown' AND (template OR (forms * 2 >= srcs AND srcs >= 3)) THEN 'template/admin'
      WHEN purpose = 'unknown' AND facts >= 2 THEN 'mixed/admin'
      WHEN purpose <> 'unknown' AND facts >= 3 AND srcs >= 1 AND NOT scanned THEN 'healthy' ELSE 'partial' END AS grade
    FROM i JOIN e USING (event_id)""",
)
def _(spark, sf):
    source = F.concat(F.lit("s"), col("l_suppkey"), F.when(col("l_suppkey") % 2 == 0, ".docx").otherwise(".pdf"))
    per_event = items(spark, sf).groupBy("event_id").agg(
        F.collect_list(F.struct("is_marker")).alias("items"),
        F.collect_list(
            F.when(col("bucket") == "A", F.struct(F.array(source).alias("sources")))
        ).alias("key_facts"),
    )
    e = events(spark, sf).select(
        "event_id", "folder_purpose", F.when(col("event_id") % 6 == 0, "Job Forms").otherwise("12 Elm").alias("folder_name"),
        F.when(col("event_id") % 10 == 0, "A scanned set").otherwise("Fine").alias("overview"),
    )
    j = per_event.join(e, "event_id")
    return j.select(
        "event_id", C.evidence_grade(col("folder_purpose"), col("folder_name"), col("key_facts"), col("items"), col("overview")).alias("grade")
    )


@query(
    "c19_tag_warnings",
    f"""SELECT file_no, array_to_string(list_filter([CASE WHEN file_no % 5 = 0 THEN 'missing required tag: property' END,
      CASE WHEN file_no % 4 = 0 THEN 'unknown doc_type: odd' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM {K}""",
)
def _(spark, sf):
    tags = F.struct(
        F.when(col("file_no") % 5 != 0, col("property")).alias("property"), col("category"),
        F.when(col("file_no") % 4 == 0, "odd").otherwise("legal").alias("doc_type"), col("name").alias("filename"),
    )
    return corpus(spark, sf).withColumn("t", tags).select("file_no", F.array_join(C.tag_warnings(col("t")), "; ").alias("warnings"))


@query(
    "c20_count_confidence",
    """SELECT o_custkey, n, CASE WHEN n = 0 THEN 'none' WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS by_count,
      CASE WHEN n = 0 THEN 'none' WHEN n >= 5 AND direct THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS by_excerpt
    FROM (SELECT c_custkey AS o_custkey, count(o_orderkey) AS n, coalesce(bool_or(o_orderstatus = 'P'), false) AS direct FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) t""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.bool_or(col("o_orderstatus") == "P").alias("direct"))
    c = table(spark, sf, "customer").select(col("c_custkey").alias("o_custkey"))
    j = c.join(o, "o_custkey", "left").fillna({"n": 0, "direct": False})
    return j.select("o_custkey", "n", C.count_confidence(col("n")).alias("by_count"), C.excerpt_confidence(col("n"), col("direct")).alias("by_excerpt"))


# -- templates --------------------------------------------------------------

TEMPLATE_SQL = "concat('Pay {{total}} by {{ due date }} to {{who', o_custkey % 3, '}}; total {{total}}.')"
ANSWER_SQL = """CASE o_orderkey % 6 WHEN 0 THEN concat('The answer is: ', o_totalprice, '.') WHEN 1 THEN 'It cannot be answered from here'
  WHEN 2 THEN 'TEST 1' WHEN 3 THEN concat('Based on the documents, ', o_orderkey) WHEN 4 THEN '' ELSE concat(' value ', o_orderkey, '. ') END"""


@query(
    "t1_placeholders",
    "SELECT o_orderkey, concat('total|due date|who', o_custkey % 3) AS names FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(placeholders(F.expr(TEMPLATE_SQL)), "|").alias("names"))


@query(
    "t2_clean_answer",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('', o_totalprice) WHEN 3 THEN concat('', o_orderkey) WHEN 5 THEN concat('value ', o_orderkey)
      ELSE 'Not Available' END AS text, o_orderkey % 6 IN (0, 3, 5) AS valid FROM orders""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", clean_answer(F.expr(ANSWER_SQL)).alias("a")).select("o_orderkey", "a.*")


def _without_preambles(text: str) -> str:
    for pattern in rules.PREAMBLES:
        text = f"trim(regexp_replace({text}, {lit(pattern)}, '', 'i'))"
    return text


@query(
    "t2_clean_long_answer",
    f"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents
      UNION ALL SELECT 1000000000 + doc_id, concat('Based on the provided documents, ', left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 200)) FROM documents
      UNION ALL SELECT 2000000000 + doc_id, concat(left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400), ' This is not mentioned in the files.') FROM documents),
    s AS (SELECT doc_id, t, string_split_regex(replace(replace(replace(t, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)), chr(1)) AS parts,
      ({" OR ".join(f"contains(lower(t), {lit(p)})" for p in rules.FAIL_PHRASES)}) OR (contains(t, 'TEST') AND length(t) < 20) AS failed FROM d),
    p AS (SELECT doc_id, t, failed, CASE WHEN length(t) > 300 THEN coalesce(list_filter(list_transform(list_slice(parts, 1, 3), lambda x: trim(x)),
      lambda x: length(x) > 10 AND NOT ({" OR ".join(f"starts_with(lower(x), {lit(p)})" for p in rules.PREAMBLE_STARTS)}))[1], parts[1]) ELSE t END AS one FROM s),
    o AS (SELECT doc_id, t, failed, {_without_preambles("one")} AS p FROM p),
    e AS (SELECT doc_id, t, failed, CASE WHEN length(p) < 50 AND p LIKE '%.' THEN trim(left(p, length(p) - 1)) ELSE p END AS p FROM o)
    SELECT doc_id, length(t) AS chars, CASE WHEN t <> '' AND NOT failed AND p <> '' THEN p ELSE {lit(rules.NOT_AVAILABLE)} END AS picked FROM e""",
)
def _(spark, sf):
    # All texts; each again behind a preamble, and again with a failure phrase at its end.
    t = F.trim(F.regexp_replace("text", r"\s+", " "))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    led = d.select((col("doc_id") + 1_000_000_000).alias("doc_id"), F.concat(F.lit("Based on the provided documents, "), F.left("t", F.lit(200))).alias("t"))
    failed = d.select((col("doc_id") + 2_000_000_000).alias("doc_id"), F.concat(F.left("t", F.lit(400)), F.lit(" This is not mentioned in the files.")).alias("t"))
    d = d.unionByName(led).unionByName(failed)
    return d.select("doc_id", F.length("t").alias("chars"), clean_answer(col("t"))["text"].alias("picked"))


@query(
    "t3_fill_template",
    """SELECT o_orderkey, concat('Pay ', o_totalprice, ' by ', CASE WHEN o_orderkey % 2 = 0 THEN concat('', o_orderpriority) ELSE 'Not Available' END,
      ' to Not Available; total ', o_totalprice, '.') AS filled FROM orders""",
)
def _(spark, sf):
    o = table(spark, sf, "orders")
    templates = o.select("o_orderkey", F.expr(TEMPLATE_SQL).alias("text"))
    answers = o.select("o_orderkey", F.lit("total").alias("placeholder"), col("o_totalprice").cast("string").alias("answer")).unionByName(
        o.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("due date").alias("placeholder"), col("o_orderpriority").alias("answer"))
    )
    return fill_templates(templates, answers, "o_orderkey").select("o_orderkey", "filled")


@query(
    "j12_placeholder_query",
    """SELECT p_partkey, coalesce(CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'What is the ring worth?' END, p_name) AS query FROM part""",
)
def _(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("placeholder"))
    known = names.filter(col("placeholder").endswith("_ring")).select("placeholder").distinct().withColumn("query", F.lit("What is the ring worth?"))
    return placeholder_queries(names, known).select("p_partkey", "query")


