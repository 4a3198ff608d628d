"""Registry of named queries and the roles the shared test tables play.

The test tables hold no folders, so files are derived from ``part``, events
from ``orders`` and their child rows from ``lineitem``. Each derivation is one
SQL text that both engines read the same way.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..session import shared_dir, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its check."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place for one run."""
    return shared_dir(spark, f"runs/{name}-{uuid.uuid4().hex[:12]}")


CORPUS_SQL = """
SELECT file_no, property, category, name, path, concat('store://corpus/', path) AS uri, size_bytes, updated_s
FROM (
  SELECT file_no, property, category, concat(stem, ext) AS name, size_bytes, updated_s,
    concat('mirror/Properties/', property, '/',
           CASE WHEN file_no % 6 = 0 THEN '' ELSE concat(category, '/') END, stem, ext) AS path
  FROM (
    SELECT p_partkey AS file_no,
      concat(p_size, ' ', p_brand,
             CASE WHEN p_size % 10 = 0 THEN ' water claim' WHEN p_size % 10 = 1 THEN ' Forms' ELSE '' END) AS property,
      CASE p_type WHEN 'ECONOMY' THEN '02-Financials' WHEN 'STANDARD' THEN '04-Permits'
                  WHEN 'PROMO' THEN '06-Invoices' WHEN 'SMALL' THEN '07-Photos'
                  WHEN 'MEDIUM' THEN '99-Misc' ELSE 'Claims' END AS category,
      CASE WHEN p_partkey % 7 = 0
           THEN concat('2023', lpad(concat('', 1 + p_partkey % 14), 2, '0'),
                       lpad(concat('', 1 + p_partkey % 31), 2, '0'), lpad(concat('', p_partkey), 9, '0'))
           ELSE concat(split_part(p_name, ' ', 1), sep, term, sep, p_partkey) END AS stem,
      CASE p_partkey % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.XLSX' WHEN 3 THEN '.jpg' ELSE '.html' END AS ext,
      CAST(CASE WHEN p_size = 50 THEN 9000000 ELSE p_size * 20000 END AS BIGINT) AS size_bytes,
      CAST(1704067200 + p_partkey * 3600 AS BIGINT) AS updated_s
    FROM (
      SELECT *, CASE p_partkey % 3 WHEN 0 THEN '_' WHEN 1 THEN ' ' ELSE '-' END AS sep,
        CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'invoice' WHEN 'widget' THEN 'estimate'
          WHEN 'anvil' THEN 'contract' WHEN 'bolt' THEN 'photos' WHEN 'gear' THEN 'appraisal'
          WHEN 'gizmo' THEN 'permit' WHEN 'plate' THEN 'deed' ELSE 'notes may' END AS term
      FROM part) p
  ) q
) r
"""

SIDECAR_SQL = f"""
SELECT uri, CASE WHEN file_no % 11 = 0 THEN 'large_pdf_pointer' WHEN file_no % 2 = 0 THEN 'document' ELSE 'contract' END AS doc_type
FROM ({CORPUS_SQL}) k WHERE file_no % 3 <> 0
"""

# Phrases that reach the content rules, spread over whole document texts.
TEXT_SQL = """
SELECT doc_id, concat(text, CASE doc_id % 9
    WHEN 0 THEN ' Invoice Number: 12-A and the amount due.'
    WHEN 1 THEN ' the subject property and its market value'
    WHEN 2 THEN ' market value only'
    WHEN 3 THEN ' date of loss; deductible, carrier'
    WHEN 4 THEN ' grand total and subtotal'
    WHEN 5 THEN ' in witness whereof the market value of the subject property'
    WHEN 6 THEN ' very truly yours, counsel for the client'
    WHEN 7 THEN ' Air quality test and building permit'
    ELSE '' END) AS text
FROM documents
"""

KIND_SQL = """CASE o_orderpriority WHEN '3-MEDIUM' THEN 'open_items_only' WHEN '4-NOT SPECIFIED' THEN 'open_items_unknown' ELSE 'folder_summary' END"""
PURPOSE_SQL = """CASE o_orderstatus WHEN 'F' THEN 'claim_restoration' WHEN 'O' THEN 'property_appraisal' ELSE 'unknown' END"""

# Events: the roles of an order.
EVENTS_SQL = f"""
SELECT o_orderkey AS event_id, concat('F', o_custkey) AS folder_key, o_orderdate AS generated_at,
  {KIND_SQL} AS response_kind, {PURPOSE_SQL} AS folder_purpose, o_orderstatus AS contract_status,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS inspection_status,
  CAST(o_orderkey % 40 AS BIGINT) AS file_count_total, CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderpriority AS confidence
FROM orders
"""
ITEMS_SQL = f"""
SELECT e.event_id, e.folder_key, e.generated_at, e.response_kind, concat('item ', l_returnflag) AS label,
  CASE l_linestatus WHEN 'F' THEN 'not_found' WHEN 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'found' ELSE 'needs_review' END END AS status,
  concat('doc ', l_partkey) AS doc_name, l_returnflag AS bucket, l_returnflag = 'R' AS is_marker, l_linenumber AS line_no, l_suppkey
FROM ({EVENTS_SQL}) e JOIN lineitem ON l_orderkey = e.event_id
"""
FIELDS_SQL = f"""
SELECT event_id, folder_key, generated_at, 'estimate_total' AS field_name, concat('', total) AS field_value, confidence, 'a.pdf' AS source_file FROM ({EVENTS_SQL}) a
UNION ALL
SELECT event_id, folder_key, generated_at, 'contract_status', contract_status, 'high', NULL FROM ({EVENTS_SQL}) b WHERE event_id % 3 <> 0
UNION ALL
SELECT event_id, folder_key, generated_at, 'inspection_status', inspection_status, 'medium', 'b.pdf' FROM ({EVENTS_SQL}) c WHERE inspection_status IS NOT NULL
"""


def sql_table(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    views(spark, sf_dir, *tables)
    return spark.sql(sql)


def part_view(spark: SparkSession, sf_dir: str) -> None:
    """Parts as a view; their names and paths are made in as many tasks as a shuffle has."""
    spread(table(spark, sf_dir, "part"), "p_partkey").createOrReplaceTempView("part")


#: Rows of orders and line items that one task gets, so that its memory does not grow with the tables.
ROWS_A_TASK = 1_000_000


def order_views(spark: SparkSession, sf_dir: str) -> None:
    """Orders and line items as views, both dealt by order, so that they meet and are grouped without another shuffle."""
    keys = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    tables = {n: table(spark, sf_dir, n) for n in keys}
    least = max(t.count() for t in tables.values()) // ROWS_A_TASK + 1
    for n, t in tables.items():
        spread(t, keys[n], least=least).createOrReplaceTempView(n)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    part_view(spark, sf_dir)
    df = spark.sql(CORPUS_SQL)
    return df.withColumn("updated", F.timestamp_seconds("updated_s"))


def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part_view(spark, sf_dir)
    return spark.sql(SIDECAR_SQL)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_table(spark, sf_dir, TEXT_SQL, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_table(spark, sf_dir, EVENTS_SQL, "orders")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order_views(spark, sf_dir)
    return spark.sql(ITEMS_SQL)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_table(spark, sf_dir, FIELDS_SQL, "orders")


# -- pieces of check SQL ----------------------------------------------------


def lit(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A search pattern for the checking engine, which has no lookarounds and
    knows only ASCII word boundaries; the rules mean Unicode ones."""
    pattern = re.sub(r"(^|[|(]|\(\?:)\\b", r"\1(?:^|[^\\p{L}\\p{N}_])", pattern)
    pattern = re.sub(r"\\b", r"(?:$|[^\\p{L}\\p{N}_])", pattern)
    return (
        pattern.replace("(?<![a-z0-9])", "(^|[^a-z0-9])").replace("(?![a-z0-9])", "($|[^a-z0-9])")
        .replace(r"(?<!\d)", r"(^|[^0-9])").replace(r"(?!\d)", r"($|[^0-9])")
    )


def matches(col: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({col}, {lit(re2(pattern))}{', ' + lit(flags) if flags else ''})"


def case_of(cases: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def stem_sql(name: str) -> str:
    return rf"regexp_replace({name}, '^(.+)\.[^.]+$', '\1')"


def norm_sql(text: str) -> str:
    """Normalised name of a last component."""
    base = rf"regexp_replace(lower(regexp_extract({text}, '([^/]*)/*$', 1)), '\.[a-z0-9]{{1,5}}$', '')"
    return rf"trim(regexp_replace({base}, '[^a-z0-9]+', ' ', 'g'))"


def name_type_sql(name: str, rule_list=rules.NAME_TYPE_RULES) -> str:
    cases = [(matches(f"lower({stem_sql(name)})", p), lit(t)) for p, t in rule_list]
    cases += [(f"lower({name}) LIKE '%{e}'", lit(t)) for e, t in rules.NAME_TYPE_EXTS]
    return case_of(cases, lit(rules.DEFAULT_TYPE))


def bucket_sql(doc_type: str, name: str) -> str:
    cases = [(f"lower(trim(coalesce({doc_type}, ''))) = {lit(k)}", lit(v)) for k, v in rules.TYPE_BUCKETS.items()]
    cases.append((matches(f"lower({name})", r"\.(xlsx|xls|csv)$", ""), "'spreadsheet'"))
    cases.append((matches(f"lower({name})", r"\.(jpg|jpeg|png|heic|heif|tiff|tif|webp|gif)$", ""), "'photos'"))
    return case_of(cases, "'other'")


def sql_list(values) -> str:
    return ", ".join(lit(v) for v in values)
