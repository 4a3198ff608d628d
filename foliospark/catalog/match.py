"""Registered queries: name matching, folder detection, ranked search, photo lookup."""

from pyspark.sql import functions as F

from .. import rules
from ..functions.names import normalize_name, normalize_title
from ..operators import folders as FO
from ..operators import history as H
from ..operators import match as M
from ..operators import search as S
from ..operators.text_index import TextIndex
from ..session import apart, cut
from .base import CORPUS_SQL, case_of, corpus, lit, matches, norm_sql, part_view, query, run_dir, sidecar, sql_list, table
from .folders import ENUM_SQL, FOLDERS_SQL, folders
from .names import LAYERED_SQL

col = F.col
K = f"({CORPUS_SQL}) k"
STOP, NOISE = sql_list(rules.QUERY_STOP_WORDS), sql_list(rules.CATEGORY_NOISE_WORDS)
SPLIT = "list_distinct(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
DIST = "(regexp_matches(w, '[0-9]') OR length(w) >= 4)"

# Queries: one per part name, worded four ways; some name a property folder.
ASKED_SQL = """SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat('show me the ', p_name) WHEN 1 THEN concat(p_size, ' ', p_brand, ' status please')
    WHEN 2 THEN concat(split_part(p_name, ' ', 1), ' invoice and estimate ', p_size) ELSE split_part(p_name, ' ', 1) END AS query FROM part"""


def asked(spark, sf):
    part_view(spark, sf)
    return spark.sql(ASKED_SQL)


def score_sql(source: str, text: str = "query") -> str:
    """Brute-force scores of every (query, file) pair: CTEs ending in ``s``."""
    return f"""
WITH q AS (SELECT query, {norm_sql(text)} AS nq FROM ({source}) a),
 c AS (SELECT *, array_to_string(list_filter(string_split(nq, ' '), lambda w: w NOT IN ({STOP})), ' ') AS c0 FROM q WHERE nq <> ''),
 d AS (SELECT query, nq, CASE WHEN c0 = '' THEN nq ELSE c0 END AS cq FROM c),
 f AS (SELECT uri, name, {norm_sql('name')} AS n FROM {K}),
 x AS (SELECT query, uri, name, nq, cq, n, {SPLIT.format('nq')} AS qw, {SPLIT.format('cq')} AS cw, {SPLIT.format('n')} AS nw FROM d CROSS JOIN f WHERE n <> ''),
 y AS (SELECT *, list_intersect(qw, nw) AS ov, list_filter(list_intersect(qw, nw), lambda w: {DIST}) AS od, list_filter(nw, lambda w: {DIST}) AS nd,
   list_filter(list_intersect(cw, nw), lambda w: {DIST} AND w NOT IN ({STOP})) AS cd FROM x),
 z AS (SELECT *, len(cd) * 1.0::DOUBLE / greatest(len(nd), 1) AS cov, len(cd) * 1.0::DOUBLE / greatest(len(cw), 1) AS ratio FROM y),
 s AS (SELECT query, uri, name, CASE WHEN n = nq OR n = cq THEN 1000.0::DOUBLE WHEN contains(n, nq) OR contains(n, cq) THEN 100.0::DOUBLE + 50.0::DOUBLE / length(n)
   WHEN contains(nq, n) OR contains(cq, n) THEN 100.0::DOUBLE + 10.0 * len(string_split(n, ' ')) WHEN len(od) = 0 THEN 0.0
   WHEN len(cd) >= 2 AND cov >= 0.5 AND ratio >= 0.7 THEN 100.0::DOUBLE + 5.0::DOUBLE * len(cd) + 20.0::DOUBLE * ratio
   WHEN len(cd) >= 3 AND cov >= 0.4 THEN 100.0::DOUBLE + 5.0::DOUBLE * len(cd)
   ELSE 30.0::DOUBLE * (len(ov) * 1.0::DOUBLE / len(qw)) + 5.0::DOUBLE * len(od) END AS score FROM z)"""


SCORE_SQL = score_sql(ASKED_SQL)


@query(
    "m1_name_matches",
    SCORE_SQL + " SELECT query, uri, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rank FROM s WHERE score > 0) t WHERE rank <= 5",
)
def _(spark, sf):
    return M.name_matches(asked(spark, sf), corpus(spark, sf)).select("query", "uri", F.round("score", 6).alias("score"), "rank")


FOLDER_NORM = f"(SELECT folder, {norm_sql('folder')} AS fn FROM ({FOLDERS_SQL}) f0 WHERE {norm_sql('folder')} <> '')"


def detect_sql(source: str) -> str:
    """Brute-force folder detection over every (query, folder) pair: CTEs ending in ``best``."""
    return f"""
WITH q AS (SELECT query, {norm_sql('query')} AS nq FROM ({source}) a),
 c AS (SELECT *, array_to_string(list_filter(string_split(nq, ' '), lambda w: w NOT IN ({STOP})), ' ') AS sq, {SPLIT.format('nq')} AS qw FROM q WHERE nq <> ''),
 f AS (SELECT folder, fn, {SPLIT.format('fn')} AS fw FROM {FOLDER_NORM} g),
 freq AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(fn, ' ')) AS w FROM f) u GROUP BY 1),
 lim AS (SELECT greatest(3, least(5, CAST(floor(count(*) * 0.005) AS INTEGER))) AS m FROM f),
 rare AS (SELECT list(w) AS words FROM freq, lim WHERE n <= m AND w NOT IN ({NOISE})),
 x AS (SELECT c.query, c.nq, c.sq, c.qw, f.folder, f.fn, f.fw, list_intersect(list_filter(c.qw, lambda w: {DIST} AND w NOT IN ({STOP})), f.fw) AS ov,
   list_filter(f.fw, lambda w: {DIST}) AS fd, rare.words AS rare FROM c CROSS JOIN f CROSS JOIN rare),
 y AS (SELECT *, len(list_filter(ov, lambda w: list_contains(rare, w))) AS strong FROM x),
 p AS (SELECT query, folder, 1 AS pass, 0 AS s1, 0 AS s2 FROM y WHERE fn = nq OR fn = sq
   UNION ALL SELECT query, folder, 2, 0, 0 FROM y WHERE contains(concat(' ', nq, ' '), concat(' ', fn, ' '))
   UNION ALL SELECT query, folder, 3, strong, len(ov) FROM y WHERE strong > 0
   UNION ALL SELECT query, folder, 4, 0, 0 FROM y WHERE len(list_filter(fd, lambda w: w NOT IN ({NOISE}))) > 0 AND len(list_filter(fd, lambda w: NOT list_contains(qw, w))) = 0),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pass, s1 DESC, s2 DESC, length(folder) DESC, folder) AS rn FROM p) t WHERE rn = 1)"""


DETECT_SQL = detect_sql(ASKED_SQL)


@query("m2_detect_folder", DETECT_SQL + " SELECT q.query, best.folder, best.pass FROM q LEFT JOIN best ON q.query = best.query")
def _(spark, sf):
    return M.detect_folders(asked(spark, sf), folders(spark, sf))


@query("m3_anchor_limit", f"SELECT CAST(greatest(3, least(5, CAST(floor(count(*) * 0.005) AS INTEGER))) AS BIGINT) AS max_folders FROM ({FOLDERS_SQL}) f")
def _(spark, sf):
    return folders(spark, sf).agg(M.anchor_limit(F.count("*")).alias("max_folders"))


_INTENT = case_of([(matches("lower(b.query)", p, ""), lit(t)) for p, t in rules.QUERY_INTENT_RULES])
RANK_SQL = DETECT_SQL + f""",
 e AS (SELECT e.folder, e.uri, e.name, e.path, e.subfolder, e.is_marker, t.doc_type FROM ({ENUM_SQL}) e JOIN ({LAYERED_SQL}) t USING (uri)),
 r AS (SELECT b.query, e.uri, e.path, e.subfolder, {_INTENT} AS intent, e.doc_type,
   len(list_intersect(list_filter({SPLIT.format('CASE WHEN c.sq = ' + chr(39) * 2 + ' THEN c.nq ELSE c.sq END')}, lambda w: {DIST} AND w NOT IN ({STOP})), {SPLIT.format(norm_sql('e.name'))})) AS hits
   FROM best b JOIN e ON e.folder = b.folder JOIN c ON c.query = b.query),
 ranked AS (SELECT *, CASE WHEN intent = doc_type THEN 200.0::DOUBLE ELSE 0.0 END + hits * 4 AS score FROM r)"""


def folder_files(spark, sf):
    """Files of the folder each query is about, with their types."""
    found = M.detect_folders(asked(spark, sf), folders(spark, sf)).filter("folder is not null").select("query", "folder")
    files = FO.with_doc_type(FO.enumerate_folders(corpus(spark, sf), found.select("folder").distinct()), sidecar(spark, sf))
    return found.join(apart(files), "folder")


@query("m4_rank_folder_files", RANK_SQL + " SELECT query, uri, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM ranked) t WHERE rank <= 10")
def _(spark, sf):
    return M.ranked_files(folder_files(spark, sf), 10, ("query",)).select("query", "uri", "score", "rank")


@query("w4_top_k", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) t WHERE rank <= 3")
def _(spark, sf):
    return M.top_n(table(spark, sf, "orders"), ["o_custkey"], [col("o_totalprice").desc(), col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


FOUND_SQL = DETECT_SQL + " SELECT q.query, best.folder FROM q LEFT JOIN best ON q.query = best.query"
_FOLDER_WORDS = f"array_to_string(list_filter(string_split({norm_sql('folder')}, ' '), lambda w: {DIST} AND w NOT IN ({NOISE})), ' ')"
SUBJECT_SQL = f"SELECT query, coalesce(nullif({_FOLDER_WORDS}, ''), query) AS subject FROM ({FOUND_SQL}) fd"


@query(
    "m5_name_union",
    score_sql(SUBJECT_SQL, "subject") + f"""
  SELECT t.query, sb.subject, t.uri, split_part(t.uri, '/', -2) AS subfolder, t.uri LIKE '%.html' AS is_marker, round(t.score, 6) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rank FROM s WHERE score > 0) t JOIN ({SUBJECT_SQL}) sb ON sb.query = t.query
  WHERE rank <= 50 AND regexp_matches(lower(t.name), '\\.(pdf|docx|doc|xlsx|xls|csv|txt|pptx|ppt|md|html)$')""",
)
def _(spark, sf):
    found = M.detect_folders(asked(spark, sf), folders(spark, sf))
    return M.name_union(found, corpus(spark, sf), 50).select("query", "subject", "uri", "subfolder", "is_marker", F.round("score", 6).alias("score"))


_TITLE = rf"trim(regexp_replace(regexp_replace(lower({{0}}), '^(.+)\.[^.]+$', '\1'), '[\s_\-.]+', ' ', 'g'))"


@query(
    "m6_resolve_names",
    SCORE_SQL + f""", hits AS (SELECT query, uri, name, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, uri) AS rank FROM s WHERE score > 0) t WHERE rank <= 10),
  n AS (SELECT *, {_TITLE.format('query')} AS q, {_TITLE.format('name')} AS t FROM hits),
  r AS (SELECT query, uri, rank, CASE WHEN t = '' THEN 1.0::DOUBLE / rank WHEN t = q THEN 100.0 WHEN contains(t, q) THEN 50.0::DOUBLE + 1.0::DOUBLE / rank WHEN contains(q, t) THEN 40.0::DOUBLE + 1.0::DOUBLE / rank
    ELSE 10.0::DOUBLE * len(list_intersect({SPLIT.format('q')}, {SPLIT.format('t')})) / greatest(len({SPLIT.format('q')}), 1) + 1.0::DOUBLE / rank END AS sc FROM n)
  SELECT query, uri, round(sc, 6) AS resolve_score, choice FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sc DESC, rank) AS choice FROM r) c WHERE choice <= 6""",
)
def _(spark, sf):
    hits = M.name_matches(asked(spark, sf), corpus(spark, sf), 10)
    scored = hits.withColumn("resolve_score", M.resolve_score(normalize_title(col("query")), normalize_title(col("name")), col("rank")))
    return M.resolve_names(scored, "query").select("query", "uri", F.round("resolve_score", 6).alias("resolve_score"), "choice")


BM25_SQL = r"""
WITH d AS (SELECT doc_id, source, lang, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS toks FROM documents),
 st AS (SELECT count(*) AS n, avg(len(toks)) AS avgl FROM d),
 tf AS (SELECT doc_id, source, lang, len AS len, term, count(*) AS tf FROM (SELECT doc_id, source, lang, len(toks) AS len, unnest(toks) AS term FROM d) u GROUP BY 1, 2, 3, 4, 5),
 q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM benchmark),
 df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY 1),
 h AS (SELECT q.item_id, tf.doc_id, tf.source, tf.lang, ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * 2.2::DOUBLE / (tf.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tf.len / st.avgl)) AS part
   FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = q.term CROSS JOIN st)"""


@query(
    "m7_text_search",
    BM25_SQL + " SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM h GROUP BY 1, 2) s) r WHERE rank <= 10",
)
def _(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", col("text").alias("query"))
    return S.text_search(b, table(spark, sf, "documents").select("doc_id", "text")).select("item_id", "doc_id", "score", "rank")


@query(
    "m7_stored_index",
    BM25_SQL + " SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM h GROUP BY 1, 2) s) r WHERE rank <= 10",
)
def _(spark, sf):
    # All documents are indexed, some with an older text and some beside ids that go away; then the changes come.
    docs = table(spark, sf, "documents").select("doc_id", "text")
    index = TextIndex(spark, run_dir(spark, "index"))
    late = F.pmod(F.xxhash64("doc_id"), F.lit(50)) == 0
    old = docs.withColumn("text", F.when(late, F.concat_ws(" ", F.lit("an older text"), F.substring("text", 1, 200))).otherwise(col("text")))
    extra = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(20)) == 1).withColumn("doc_id", -1 - col("doc_id"))
    index.update(old.unionByName(extra))
    index.update(docs.filter(late), extra.select("doc_id"))
    b = table(spark, sf, "benchmark").select("item_id", col("text").alias("query"))
    return index.search(b).select("item_id", "doc_id", "score", "rank")


_WANT = "CASE item_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'en' ELSE 'xx' END"


def filtered_search(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", col("text").alias("query"), F.expr(_WANT).alias("want"))
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    wanted = col("lang") == col("want")
    scores = cut(S.text_scores(b, docs, carry=["lang"], own=["item_id", "want"], n=10, keep=wanted))
    kept = S.best_hits(b, scores, keep=wanted, own=["item_id", "want"])
    return b, scores, kept.select("item_id", "doc_id", "score", "rank")


_FILTERED = f"(SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM h WHERE lang = {_WANT} GROUP BY 1, 2) s) r WHERE rank <= 10)"
_ALL = "(SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(part), 6) AS score FROM h GROUP BY 1, 2) s) r WHERE rank <= 10)"


@query("m7_filtered_search", BM25_SQL + f" SELECT * FROM {_FILTERED} x")
def _(spark, sf):
    return filtered_search(spark, sf)[2]


@query(
    "m8_filter_fallback",
    BM25_SQL + f" SELECT item_id, doc_id, score, rank, false AS fell_back FROM {_FILTERED} x UNION ALL SELECT item_id, doc_id, score, rank, true FROM {_ALL} y WHERE item_id NOT IN (SELECT item_id FROM {_FILTERED} z)",
)
def _(spark, sf):
    b, scores, kept = filtered_search(spark, sf)
    everything = S.best_hits(b, scores, own=["item_id", "want"]).select("item_id", "doc_id", "score", "rank")
    return S.with_fallback(kept, everything, "item_id")


@query(
    "m9_carry_context",
    """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND turn % 3 = 0 THEN concat('c', conv_id, '-', turn) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations""",
)
def _(spark, sf):
    t = table(spark, sf, "conversations").withColumn("ctx", F.when((col("role") == "user") & (col("turn") % 3 == 0), F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn")))
    return H.carry_context(t, "conv_id", "turn", "ctx", block=4).select("conv_id", "turn", "carried")


_CONTEXT = "CASE WHEN length(query) % 2 = 0 THEN '4 Brand#9' END"
_OPEN_SQL = f"SELECT query, {_CONTEXT} AS context FROM ({FOUND_SQL}) fd WHERE folder IS NULL AND {_CONTEXT} IS NOT NULL"
_STRONG_SQL = score_sql(f"SELECT query FROM ({_OPEN_SQL}) op") + " SELECT DISTINCT query FROM s WHERE score >= 100"
_CARRIED_SQL = f"SELECT query, concat(context, ' ', query) AS both_text FROM ({_OPEN_SQL}) op WHERE query NOT IN ({_STRONG_SQL})"
_INHERITED_SQL = detect_sql(f"SELECT DISTINCT both_text AS query FROM ({_CARRIED_SQL}) ca") + f" SELECT cb.query, best.folder FROM ({_CARRIED_SQL}) cb JOIN best ON best.query = cb.both_text"


@query(
    "m9_matter_routing",
    f"""SELECT fd.query, {_CONTEXT.replace('query', 'fd.query')} AS context, coalesce(fd.folder, inh.folder) AS folder,
      CASE WHEN fd.folder IS NOT NULL THEN 'query' WHEN inh.folder IS NOT NULL THEN 'context' END AS source
    FROM ({FOUND_SQL}) fd LEFT JOIN ({_INHERITED_SQL}) inh ON inh.query = fd.query""",
)
def _(spark, sf):
    k, f = corpus(spark, sf), folders(spark, sf)
    q = asked(spark, sf).withColumn("context", F.when(F.length("query") % 2 == 0, F.lit("4 Brand#9")))
    return M.route_matters(q, k, f)


@query(
    "j8_contained_folders",
    f"""SELECT q.nq AS norm_q, f.folder FROM (SELECT DISTINCT {norm_sql('query')} AS nq FROM ({ASKED_SQL}) a) q JOIN {FOLDER_NORM} f ON contains(concat(' ', q.nq, ' '), concat(' ', f.fn, ' '))""",
)
def _(spark, sf):
    q = asked(spark, sf).select(normalize_name(col("query")).alias("norm_q")).distinct()
    return M.contained_folders(q, folders(spark, sf))


_ADDR = "SELECT DISTINCT concat(c_custkey % 60, CASE c_custkey % 4 WHEN 0 THEN ' Brand 1 Street' WHEN 1 THEN ' brand' WHEN 2 THEN ' water Ave' ELSE ' Unknown Rd' END) AS address FROM customer"
_ANORM = "trim(regexp_replace(regexp_replace(lower(trim({0})), '" + rules.STREET_PATTERN + "', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "j9_photo_lookup",
    f"""WITH a AS (SELECT address, {_ANORM.format('address')} AS an FROM ({_ADDR}) x), k AS (SELECT DISTINCT property, {_ANORM.format('property')} AS kn FROM {K})
    SELECT address, property FROM a CROSS JOIN k WHERE an = kn OR (an <> '' AND len(list_filter({SPLIT.format('an')}, lambda w: NOT list_contains(string_split(kn, ' '), w))) = 0)
      OR (len(list_filter(regexp_extract_all(address, '[0-9]+'), lambda n: contains(kn, n))) > 0 AND len(list_filter({SPLIT.format('an')}, lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) > 2 AND contains(kn, w))) > 0)""",
)
def _(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("customer")
    index = corpus(spark, sf).select("property").distinct()
    return M.photo_lookup(spark.sql(_ADDR), index).select("address", "property")


@query(
    "j11_segment_similarity",
    f"""WITH s AS (SELECT sg, count(*) AS n FROM (SELECT {norm_sql('seg')} AS sg FROM (SELECT unnest(list_slice(string_split(path, '/'), 1, -2)) AS seg FROM {K}) u) v WHERE sg <> '' GROUP BY 1),
      f AS (SELECT * FROM {FOLDER_NORM} g), j AS (SELECT folder, fn, sg, n, string_split(fn, ' ') AS fw, string_split(sg, ' ') AS sw FROM f CROSS JOIN s)
    SELECT folder, CAST(sum(CASE WHEN sg = fn THEN n ELSE 0 END) AS BIGINT) AS strict_hits,
      CAST(sum(CASE WHEN (contains(sg, fn) AND sg <> fn) OR (contains(fn, sg) AND length(sg) >= 10) THEN n ELSE 0 END) AS BIGINT) AS contains_hits,
      CAST(sum(CASE WHEN len(fw) >= 5 AND len(sw) >= 5 AND list_slice(fw, 1, 5) = list_slice(sw, 1, 5) AND fn <> sg THEN n ELSE 0 END) AS BIGINT) AS prefix5_hits,
      CAST(sum(CASE WHEN len(fw) >= 10 AND len(sw) >= 10 AND list_slice(fw, 1, 10) = list_slice(sw, 1, 10) AND fn <> sg THEN n ELSE 0 END) AS BIGINT) AS prefix10_hits FROM j GROUP BY 1""",
)
def _(spark, sf):
    return M.segment_similarity(corpus(spark, sf), folders(spark, sf)).select("folder", "strict_hits", "contains_hits", "prefix5_hits", "prefix10_hits")


