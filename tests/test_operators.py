"""Operators on small fixtures, against brute force where SQL is no help."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from foliospark.functions.names import normalize_name
from foliospark.operators import folders as FO
from foliospark.operators import history as H
from foliospark.operators import match as M
from foliospark.operators import search as S
from foliospark.plans import event_rows as ER
from foliospark.plans import queries as Q
from foliospark.plans import warehouse as W
from foliospark.sources import corpus as CO
from foliospark.sources import events_log as L
from foliospark.streaming import streams as ST

WORDS = "spring ring string it permits alder birch 12 27 legal the photos a e bolt".split()


def strings(seed, n):
    rnd = random.Random(seed)
    return sorted({" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))) for _ in range(n)})


def test_contained_pairs_is_exact(spark):
    probes, targets = strings(1, 60), strings(2, 80)
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    got = {tuple(r) for r in M.contained_pairs(p, t).collect()}
    assert got == {(a, b) for a in probes for b in targets if a in b}


def test_contained_pairs_with_long_words(spark):
    probes = ["abcdefghij", "bcdefghijk", "hij", "a"]
    targets = ["xabcdefghijkx", "abcdefgh", "zz hijack"]
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    got = {tuple(r) for r in M.contained_pairs(p, t).collect()}
    assert got == {(a, b) for a in probes for b in targets if a in b}


def test_probes_whose_inner_words_no_target_has_are_dropped(spark):
    probes, targets = strings(3, 80), strings(4, 80)
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    left = {r.probe for r in M.containable(p, t, "probe", "target").collect()}
    assert {a for a in probes if any(a in b for b in targets)} <= left
    p = spark.createDataFrame([(x,) for x in ("t invoice estimate 1", "t invoice 1", "t 1", "1", "")], "probe string")
    t = spark.createDataFrame([("hot invoice 12",), ("hot estimate 21",)], "target string")
    assert {r.probe for r in M.containable(p, t, "probe", "target").collect()} == {"t invoice 1", "t 1", "1", ""}


def test_probes_whose_last_word_begins_no_target_word_are_dropped(spark):
    probes, targets = strings(5, 80), strings(6, 30)
    p = spark.createDataFrame([(x,) for x in probes], "probe string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    left = {r.probe for r in M.endable(p, t, "probe", "target").collect()}
    assert {a for a in probes if any(a in b for b in targets)} <= left
    p = spark.createDataFrame([(x,) for x in ("hot invoice 1", "hot invoice 21", "hot invoice 2", "voice", "hot voice", "hot invoicesandmore", "invoiceforms")], "probe string")
    t = spark.createDataFrame([("hot invoice 12",), ("invoiceformat",)], "target string")
    assert {r.probe for r in M.endable(p, t, "probe", "target").collect()} == {"hot invoice 1", "voice", "invoiceforms"}


@pytest.mark.parametrize("sent, least", [(4_000_000, 25.0), (-1, 0.0)])
def test_a_least_score_gives_the_rows_of_a_filter(spark, monkeypatch, sent, least):
    """Against all pairs, with names in lists, and with joins that send tables to the tasks or shuffle both sides."""
    from foliospark import session

    monkeypatch.setattr(session, "SENT", sent)
    monkeypatch.setattr(M, "RARE_NAMES", 3)
    rnd = random.Random(7)
    some = "alder birch invoice estimate roof 12 27 red survey".split()
    files = [(f"u{i:03d}", " ".join(rnd.choice(some) for _ in range(rnd.randint(1, 4))) + f" {i}.pdf") for i in range(150)]
    asked = sorted({" ".join(rnd.choice(some) for _ in range(rnd.randint(1, 5))) for _ in range(12)})
    c = spark.createDataFrame(files, "uri string, name string")
    q = spark.createDataFrame([(x,) for x in asked], "query string")
    norm = normalize_name(F.col("query"))
    pairs = q.crossJoin(c).withColumn("score", M.match_score(norm, M.core_query(norm), normalize_name(F.col("name")))).filter("score > 0")
    best = M.top_n(pairs.filter(F.col("score") >= least), ["query"], [F.col("score").desc(), F.col("uri")], 4)
    want = sorted((r["query"], r["uri"], round(r["score"], 6), r["rank"]) for r in best.collect())
    got = M.name_matches(q, c, 4, least=least).collect()
    assert sorted((r["query"], r["uri"], round(r["score"], 6), r["rank"]) for r in got) == want and want


def test_routing_makes_no_lists_of_names_that_cannot_score_enough(spark, monkeypatch):
    monkeypatch.setattr(M, "RARE_NAMES", 3)
    written = []
    cut = M.cut
    monkeypatch.setattr(M, "cut", lambda df: written.append(set(df.columns)) or cut(df))
    files = [(f"u{i}", f"mirror/27 Birch Road/alder {i}.pdf", f"alder {i}.pdf") for i in range(20)]
    c = spark.createDataFrame(files, "uri string, path string, name string")
    q = spark.createDataFrame([("alder of which", "27 Birch Road"), ("alder 7", "27 Birch Road")], "query string, context string")
    got = {r["query"]: (r["folder"], r["source"]) for r in M.route_matters(q, c, FO.folder_set(c)).collect()}
    assert got == {"alder of which": ("27 Birch Road", "context"), "alder 7": (None, None)}
    assert written and not any("at" in columns for columns in written)


def test_name_union_of_a_uri_that_comes_twice_has_its_rows_once(spark):
    c = spark.createDataFrame([("u", "mirror/Birch/birch.pdf", "birch.pdf")] * 2, "uri string, path string, name string")
    q = spark.createDataFrame([(1, "birch", "Birch")], "query_id int, query string, folder string")
    assert [(r.uri, r.subfolder) for r in M.name_union(q, c).collect()] == [("u", "Birch")] * 2


def test_name_matches_cut_is_exact_with_equal_names(spark):
    files = [(f"u{i:02d}", "Alder invoice.pdf" if i % 2 else "alder-invoice.docx") for i in range(20)] + [("z", "alder notes.pdf")]
    c = spark.createDataFrame(files, "uri string, name string")
    q = spark.createDataFrame([(1, "show me the alder invoice"), (2, "  "), (3, "unrelated")], "query_id int, query string")
    rows = M.name_matches(q, c, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.uri, r.score) for r in rows] == [(1, "u00", 1000.0), (1, "u01", 1000.0), (1, "u02", 1000.0)]


@pytest.mark.parametrize("query, folder, step", [
    ("summarize 27 Birch Road", "27 Birch Road", 1), ("what about dorsey ann legal today", "Dorsey, Ann - Legal", 2),
    ("dorsey papers", "Dorsey, Ann - Legal", 3), ("show me all the photos", None, None), ("permits", None, None),
])
def test_detect_folder(spark, query, folder, step):
    f = spark.createDataFrame([(x,) for x in ["27 Birch Road", "Dorsey, Ann - Legal", "IT", "Job Photos", "Birch"]], "folder string")
    q = spark.createDataFrame([(query,)], "query string")
    row = M.detect_folders(q, f).first()
    assert (row["folder"], row["pass"]) == (folder, step)


def test_name_union_seeds_with_folder_words(spark):
    c = spark.createDataFrame(
        [("s://b/mirror/Dorsey, Ann - Legal/Pack.pdf",), ("s://b/mirror/Mail/Re Dorsey claim.pdf",), ("s://b/mirror/Mail/dorsey.css",), ("s://b/mirror/x/legal.pdf",)], "uri string"
    ).withColumn("path", F.regexp_replace("uri", "^s://b/", "")).withColumn("name", F.substring_index("uri", "/", -1))
    q = spark.createDataFrame([(1, "everything", "Dorsey, Ann - Legal")], "query_id int, query string, folder string")
    rows = M.name_union(q, c).collect()
    assert [(r.name, r.subfolder, r.subject) for r in rows] == [("Re Dorsey claim.pdf", "Mail", "dorsey")]


def test_route_matters_inherits_context_unless_a_file_is_named(spark):
    c = spark.createDataFrame([("u1", "mirror/27 Birch Road/roof survey.pdf", "roof survey.pdf")], "uri string, path string, name string")
    f = FO.folder_set(c)
    q = spark.createDataFrame([("what is missing", "27 Birch Road"), ("roof survey", "27 Birch Road"), ("27 birch road", None)], "query string, context string")
    got = {r["query"]: (r["folder"], r["source"]) for r in M.route_matters(q, c, f).collect()}
    assert got == {"what is missing": ("27 Birch Road", "context"), "roof survey": (None, None), "27 birch road": ("27 Birch Road", "query")}


def test_enumerate_keeps_first_position_and_all_equal_folders(spark):
    c = spark.createDataFrame([("u", "m/A-B/x/a b/f.pdf", "f.pdf"), ("v", "m/A-B/g.css", "g.css")], "uri string, path string, name string")
    f = spark.createDataFrame([("A B",), ("a_b",)], "folder string")
    assert sorted((r.folder, r.uri, r.subfolder) for r in FO.enumerate_folders(c, f).collect()) == [("A B", "u", "x"), ("a_b", "u", "x")]


def test_runs_split_only_above_the_gap_and_across_days(spark):
    t0 = datetime(2026, 1, 1, 23, 50)
    at = [t0, t0 + timedelta(seconds=900), t0 + timedelta(seconds=1801), t0 + timedelta(days=3)]
    df = spark.createDataFrame([(x,) for x in at], "ts timestamp_ntz")
    assert sorted(r.n for r in H.runs(df, "ts").collect()) == [1, 1, 2]
    assert H.latest_run(df, "ts").first().run_start == at[-1]


def test_previous_value_equals_plain_lag_with_a_hot_key(spark):
    from pyspark.sql import Window

    df = spark.range(600).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 20) END AS k", "timestamp_seconds(id * 7919 % 400000) AS t", "id % 4 AS s")
    got = Q.with_previous(df, "k", "t", "id", ["s"], "hour").select("id", "prev_s")
    want = df.withColumn("prev_s", F.lag("s").over(Window.partitionBy("k").orderBy("t", "id"))).select("id", "prev_s")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_carry_context_over_blocks(spark):
    df = spark.createDataFrame([(1, i, "x" if i == 2 else None) for i in range(12)], "c int, t int, ctx string")
    got = [r.carried for r in H.carry_context(df, "c", "t", "ctx", block=3).orderBy("t").collect()]
    assert got == [None, None] + ["x"] * 10


LINE = (
    '{"schema_version":"1.1","response_kind":"folder_summary","generated_at":"%s","query":"q%s","folder_name":"27 Birch",'
    '"structured_fields":{"a":{"value":%s,"confidence":null,"source_file":""}},"document_inventory":{"contract":[{"name":"d"},{"uri":"u"},3,{"name":"e","is_marker":"false","bucket":"x"}]},'
    '"open_items":[{"label":"L","status":"found","strict_count":"2","total_count":2.9},{"label":"M"}]}'
)


def log(spark):
    lines = [LINE % ("2026-01-05T10:00:00Z", 1, '"v"'), LINE % ("2026-01-05T10:00:00Z", 1, '"v"'), LINE % ("2026-01-05T10:00:00Z", 2, '""'),
             LINE % ("2026-01-06T10:00:00Z", 3, '" "'), LINE % ("2026-01-06T10:00:00Z", 4, "0"), LINE % ("junk", 5, "null"), "", "  ", "not json", "[1,2]"]
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_event_shaping(spark):
    good, bad = L.split_lines(L.parse_lines(log(spark)))
    good = ER.with_event_id(good)
    assert (good.count(), bad.count(), ER.undated(good).count()) == (6, 2, 1)
    assert good.select("event_id").distinct().count() == 5
    assert sorted(str(r.field_value) for r in ER.field_rows(good).collect()) == ["0", "None", "v", "v"]
    inv = {(r.doc_name, r.bucket, r.is_marker) for r in ER.inventory_rows(good).collect()}
    assert inv == {("d", "contract", False), ("e", "x", False)}
    items = {(r.label, r.strict_count, r.total_count) for r in ER.open_item_rows(good).collect()}
    assert items == {("L", 2, 2)}


def counts(spark, root):
    return {n: W.current(spark, root, n).count() for n in ("events", *W.CHILDREN)}


def test_load_twice_and_shuffled_gives_the_same_tables(spark, tmp_path):
    root = str(tmp_path)
    good = L.split_lines(L.parse_lines(log(spark)))[0]
    W.load(spark, good, root)
    first = counts(spark, root)
    W.load(spark, good.orderBy(F.rand(3)), root)
    assert counts(spark, root) == first == {"events": 4, "fields_long": 3, "inventory": 8, "open_items": 4}


def test_stream_equals_batch(spark, tmp_path):
    log(spark).repartition(3).write.text(f"{tmp_path}/log")
    ST.stream_load(spark, f"{tmp_path}/log", f"{tmp_path}/s", f"{tmp_path}/c", quarantine=f"{tmp_path}/bad").awaitTermination()
    W.load(spark, L.split_lines(L.parse_lines(log(spark)))[0], f"{tmp_path}/b")
    assert counts(spark, f"{tmp_path}/s") == counts(spark, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 2


def test_only_changed_rows_are_touched(spark):
    old = spark.createDataFrame([("1", "p", 1), ("2", "p", 1)], "event_id string, payload_json string, v int")
    new = spark.createDataFrame([("1", "p", 2), ("2", "x", 2), ("3", "p", 2)], "event_id string, payload_json string, v int")
    assert sorted(tuple(r) for r in W.upsert_changed(old, new).collect()) == [("1", "p", 1), ("2", "x", 2), ("3", "p", 2)]


def facts(one, items):
    arr = ", ".join(f"named_struct('label', '{a}', 'value', '{b}', 'confidence', 'high', 'sources', array('s'))" for a, b in items)
    return one(lambda x: ER.facts_to_fields(F.expr(f"array({arr})")), 1)


def test_first_fact_wins_and_a_filler_closes_its_field(one):
    got = facts(one, [("Claim number", "1930"), ("Claim number", "C-9"), ("Estimate total", "5"), ("Asbestos Estimate Total", "6"), ("Estimate Total", "7")])
    assert got["claim_number"] is None and got["estimate_total"]["value"] == "5" and set(got) == {"claim_number", "estimate_total"}


def test_fields_of_unknown_purpose_keep_identity_only(one):
    none = lambda t: F.expr(f"cast(array() as {t})")
    got = one(lambda n, p: ER.structured_fields(n, p, none(ER.FACT_TYPE), none(ER.TIMELINE_TYPE), F.expr(
        "array(named_struct('label','a','bucket','contract','status','found','strict_count',1L,'total_count',1L,'checklist_name','x'))")), "27 Birch", "unknown")
    assert len(got) == 16 and got["folder_name"]["value"] == "27 Birch" and got["contract_status"]["value"] is None


def test_search_orders_and_filters(spark):
    d = spark.createDataFrame([(1, "roof roof leak", "a"), (2, "roof", "b"), (3, "garden", "a")], "doc_id int, text string, kind string")
    q = spark.createDataFrame([(7, "the roof", "b"), (8, "roof", "none")], "query_id int, query string, want string")
    assert sorted((r.query_id, r.doc_id) for r in S.text_search(q, d, keep=F.col("kind") == F.col("want"), carry=["kind"]).collect()) == [(7, 2)]
    assert {r.doc_id for r in S.text_search(q.drop("want"), d).filter("query_id = 8").collect()} == {1, 2}


def test_manifest_lines_are_read_where_they_were_dealt(spark):
    """No filter on the parsed line goes down to the few tasks before the shuffle."""
    rows = spark.createDataFrame([(i, f'  {{"id": "a{i}", "structData": {{"title": "t"}}}}' if i % 3 else " ") for i in range(9)], "n int, value string")
    parsed = CO.parse_manifest(rows.repartition(3, "n").select("value"))
    below = parsed._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "parse_json" not in below and "Filter" not in below
    assert sorted(r["id"] for r in parsed.collect()) == [f"a{i}" for i in (1, 2, 4, 5, 7, 8)]


def test_orders_are_dealt_to_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """As many tasks as the rows ask for, however few bytes they are; joined and grouped without another shuffle."""
    from foliospark.catalog import base

    spark.range(400).selectExpr("id as o_orderkey", "id % 7 as o_custkey", "'F' as o_orderstatus", "1.5 as o_totalprice",
                                "timestamp'2024-01-01' as o_orderdate", "'3-MEDIUM' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1600).selectExpr("id % 400 as l_orderkey", "id as l_partkey", "id % 9 as l_suppkey", "cast(id div 400 as int) as l_linenumber", "'R' as l_returnflag",
                                 "'O' as l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(base, "ROWS_A_TASK", 50)
    rows = base.items(spark, str(tmp_path))
    assert spark.table("lineitem").rdd.getNumPartitions() >= 32 and rows.count() == 1600
    plan = rows.hint("merge").groupBy("event_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan.replace("BroadcastExchange", "")


def test_lists_keep_only_objects(spark):
    """Items that are none, keys with null and lists that are none, read in one go."""
    line = """{"generated_at": "2024-01-02T03:04:05Z", "folder_name": "F", "query": "q", "response_kind": "folder_summary",
      "document_inventory": {"A": [{"name": "x", "is_marker": 0, "bucket": null}, 3, null, {"uri": "u"}, {"name": " "}], "B": 5, "C": null, "D": [{"name": 7, "is_marker": "0", "uri": {"a": 1}}]},
      "open_items": [{"label": "l", "status": "found", "strict_count": "4", "total_count": "z"}, "s", {"label": "l"}]}"""
    good = ER.with_event_id(L.split_lines(L.parse_lines(spark.createDataFrame([(line.replace("\n", " "),)], "value string")))[0])
    got = sorted(tuple(r)[3:] for r in ER.inventory_rows(good).collect())
    assert got == [("7", '{"a":1}', None, "D", False), ("x", None, None, "A", False)]
    assert [tuple(r)[3:] for r in ER.open_item_rows(good).collect()] == [(None, "l", None, "found", 4, None)]
    loose = good.selectExpr("'q' as query", "'folder_summary' as response_kind", "'high' as confidence", "parse_json('[]') as sources", "v")
    n = ER.normalize_summary(loose).first()
    assert {k: [(x["name"], x["is_marker"]) for x in v] for k, v in n["document_inventory"].items()} == {"A": [("x", False), ("", False), (" ", False)], "D": [("7", True)]}
    assert "document_inventory" in ER.conformance(good).first()["failures"]


def test_scores_are_summed_where_the_document_is(spark):
    """Every document holds "the": its counts are not dealt by word, and the rows handed on are those the cut needs."""
    docs = spark.createDataFrame([(i, f"the {'alder' if i % 3 else 'birch'} {i % 7}", "de" if i % 5 else "en") for i in range(300)], "doc_id long, text string, lang string")
    q = spark.createDataFrame([(1, "the alder 3", "en"), (2, "the birch", "xx")], "item_id int, query string, want string")
    own, keep = ["item_id", "want"], F.col("lang") == F.col("want")
    whole = S.text_scores(q, docs, carry=["lang"], own=own)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(term" not in plan.split("hashpartitioning(doc_id")[0]
    few = S.text_scores(q, docs, carry=["lang"], own=own, n=5, keep=keep)
    assert few.count() <= 20 < whole.count()
    rows = lambda scores, k: sorted(map(tuple, S.best_hits(q, scores, 5, keep=k, own=own).collect()))
    assert rows(few, keep) == rows(whole, keep) != [] and rows(few, None) == rows(whole, None)


def test_scan_lists_files_without_reading_them(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.TXT").write_text("hello")
    df = CO.scan_corpus(spark, str(tmp_path))
    assert [(r.path, r.name, r.ext, r.size_bytes) for r in df.collect()] == [("a/f.TXT", "f.TXT", ".txt", 5)]
    read = re.findall(r"FileScan binaryFile \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())
    assert read and all("content" not in cols for cols in read)


def test_bad_bytes_and_failing_decoders_do_not_stop_extraction(spark):
    df = spark.createDataFrame([("a.txt", b"ok \xff"), ("b.pdf", b"x"), ("c.zip", b"y")], "path string, content binary")
    rows = {r.path: (r.text, r.error) for r in CO.extract_text(df, {".pdf": lambda raw, ext: 1 / 0}).collect()}
    assert rows["a.txt"] == ("ok \ufffd", None) and rows["b.pdf"][1].startswith("ZeroDivisionError") and rows["c.zip"] == ("", "no decoder")


def test_name_list_keeps_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("b\n# no\n\n a \n")
    assert [r.name for r in L.read_name_list(spark, str(tmp_path / "l.txt")).orderBy("position").collect()] == ["b", "a"]


def test_photo_index_prefers_larger_then_later(spark):
    p = spark.createDataFrame([("A", "u1", 3, "t", "A/1"), ("A", "u2", 3, "t", "A/2"), ("A", "u0", 1, "t", "A/9")], "property string, url string, photo_count int, title string, prop_key string")
    assert FO.photo_index(p).first().url == "u2"


def test_sidecar_drops_other_values(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"u1": "deed", "u2": 5,\n "u3": {"x": 1}}')
    assert [tuple(r) for r in CO.read_sidecar(spark, str(tmp_path / "s.json")).collect()] == [("u1", "deed")]


def test_normalised_names_agree_in_and_out_of_lambdas(spark):
    df = spark.createDataFrame([("A/B c.PDF",)], "p string")
    assert df.select(F.transform(F.split("p", "/"), lambda x: normalize_name(x)).alias("x")).first().x == ["a", "b c"]


def test_paths_keep_their_top_folder_without_a_prefix(spark):
    df = spark.createDataFrame([("mirror/Alder claim/x.pdf",), ("Birch/sub/y.pdf",), ("z.pdf",), ("mirrored/a/b.pdf",)], "path string")
    assert {r.folder for r in FO.folder_set(df).collect()} == {"Alder claim", "Birch", "sub", "mirrored", "a"}


def test_listing_is_strict_about_its_root(spark, tmp_path):
    rows = lambda *uris: spark.createDataFrame([(u, 1, None) for u in uris], "uri string, size_bytes long, updated timestamp")
    for root in ("file:///b/mirror", "/b/mirror", "file:/b/mirror/"):
        got = CO.listing(rows("file:/b/mirror/Alder claim/x.pdf", "/b/mirror/y.bin", "file:/b/mirror/dir/"), root)
        assert {(r.path, r.content_type) for r in got.collect()} == {("Alder claim/x.pdf", "application/pdf"), ("y.bin", "application/octet-stream")}
    assert [r.path for r in CO.listing(rows("s3a://m/a/x.pdf", "s3a://m/b/x.pdf"), "s3a://m", "a/").collect()] == ["a/x.pdf"]
    with pytest.raises(Exception, match="not below"):
        CO.listing(rows("file:/c/mirror/x.pdf"), "/b/mirror").collect()


def event_line(name, day, items):
    return (
        f'{{"schema_version":"1.1","response_kind":"folder_summary","generated_at":"{day}T00:00:00Z","query":"{name}","folder_name":"{name}",'
        f'"folder_purpose":"unknown","open_items":[{",".join(items)}]}}'
    )


def open_items(spark, root):
    return sorted((r.event_id, r.label) for r in W.current(spark, root, "open_items").collect())


def test_reload_leaves_no_stale_children(spark, tmp_path):
    root, item = str(tmp_path), '{"label":"deed","bucket":"contract","status":"found"}'
    load = lambda *lines, **how: W.load(
        spark, L.split_lines(L.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))[0], root, **how)
    assert W.current(spark, root) is None
    load(event_line("a", "2024-01-05", [item]), event_line("b", "2024-02-05", [item]))
    before = open_items(spark, root)
    assert len(before) == 2
    load(event_line("a", "2024-01-05", []))
    assert len(open_items(spark, root)) == 1 and W.current(spark, root).count() == 2
    load(event_line("a", "2024-01-05", []), event_line("b", "2024-02-05", [item]), only_changed=True)
    assert W.read_table(spark, f"{root}/events").count() == 3
    W.compact(spark, root)
    assert W.read_table(spark, f"{root}/events").count() == 2 and len(open_items(spark, root)) == 1


def test_a_load_that_died_is_not_seen(spark, tmp_path):
    root, item = str(tmp_path), '{"label":"deed","bucket":"contract","status":"found"}'
    good = L.split_lines(L.parse_lines(spark.createDataFrame([(event_line("a", "2024-01-05", [item]),)], "value string")))[0]
    W.load(spark, good, root)
    staged = W.stage(W.one_line_each(W.rows.with_event_id(good)))
    W.write_table(staged["open_items"].withColumn("version", F.lit("9")), f"{root}/open_items", W.CLUSTER_KEYS["open_items"], "append")
    assert len(open_items(spark, root)) == 1


def test_latest_joins_prune_partitions(spark, tmp_path):
    events = spark.range(200).select(
        (F.col("id") % 5).cast("string").alias("folder_key"), F.lit("folder_summary").alias("response_kind"), F.col("id").cast("string").alias("event_id"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int))").alias("generated_at"))
    for name in ("events", "fields"):
        W.write_table(W.with_day(events.withColumn("field_name", F.lit("x"))), f"{tmp_path}/{name}", ("folder_key",))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    last = Q.latest_times(read("events").filter("response_kind = 'folder_summary'"), "folder_key", "generated_at", "event_month")
    joined = Q.at_latest(read("fields"), last, "folder_key", "generated_at", "event_month")
    assert joined.count() == 5
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString()


def test_templates_say_what_is_missing(spark):
    from foliospark.functions.templates import fill_templates

    t = spark.createDataFrame([(1, "a\u0000 {{ who }} owes {{what}}"), (2, "plain")], "template_id long, text string")
    a = spark.createDataFrame([(1, "who", "Kim")], "template_id long, placeholder string, answer string")
    assert {r.template_id: r.filled for r in fill_templates(t, a).collect()} == {1: "a\u0000 Kim owes Not Available", 2: "plain"}


def test_calls_at_the_cap(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, s),) for s in (0, 1, 2, 30)], "ts timestamp")
    got = {r.ts.second: (r.trailing, r.at_cap) for r in H.trailing_counts(e, "ts", 10, 3).collect()}
    assert got == {0: (1, False), 1: (2, False), 2: (3, True), 30: (1, False)}


# ---- commits


def _tables(spark, rows):
    """Event rows and one child each of ``(id, text)``."""
    base = spark.createDataFrame(rows, "event_id string, payload_json string").withColumn("event_date", F.expr("date '2024-01-05'"))
    events = base.withColumn("folder_purpose", F.lit("p")).withColumn("response_kind", F.lit("k"))
    items = base.select("event_id", "event_date", F.lit("b").alias("bucket"), F.lit("f").alias("folder_key"), F.col("payload_json").alias("doc_name"))
    return {"inventory": items, "events": events}


def _read(snap):
    return (
        sorted(tuple(r) for r in snap.table("events").select("event_id", "payload_json").collect()),
        sorted(tuple(r) for r in snap.table("inventory").select("event_id", "doc_name").collect()),
    )


def _both(*rows):
    return (list(rows), list(rows))


def test_commits_order_loads_whatever_the_clock(spark, tmp_path, monkeypatch):
    import time

    root = str(tmp_path / "t")
    assert W.current(spark, root) is None
    now = time.time_ns()
    monkeypatch.setattr(time, "time_ns", lambda: now)
    assert W.append(spark, root, _tables(spark, [("a", "1"), ("b", "1")]), "s", "0") == 1
    monkeypatch.setattr(time, "time_ns", lambda: now - 3_600_000_000_000)
    assert W.append(spark, root, _tables(spark, [("b", "2"), ("c", "2")]), "other", "0") == 2
    assert _read(W.Snapshot(spark, root)) == _both(("a", "1"), ("b", "2"), ("c", "2"))


def test_a_replayed_batch_adds_no_version(spark, tmp_path):
    from foliospark.plans import commits

    root = str(tmp_path / "t")
    for _ in range(3):
        assert W.append(spark, root, _tables(spark, [("a", "1")]), "s", "7") == 1
    W.append(spark, root, _tables(spark, [("a", "2")]), "s", "8")
    assert W.append(spark, root, _tables(spark, [("a", "lost")]), "s", "7") == 1
    assert commits.last(spark, root) == 2 and _read(W.Snapshot(spark, root)) == _both(("a", "2"))


def test_a_load_without_commit_is_never_seen(spark, tmp_path, monkeypatch):
    from foliospark.plans import commits

    root = str(tmp_path / "t")
    W.append(spark, root, _tables(spark, [("a", "1")]), "s", "0")
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            W.append(spark, root, _tables(spark, [("a", "half"), ("b", "half"), ("c", "half")]), "s", "1")
    assert _read(W.Snapshot(spark, root)) == _both(("a", "1"))
    W.append(spark, root, _tables(spark, [("a", "2"), ("b", "2")]), "s", "1")
    assert _read(W.Snapshot(spark, root)) == _both(("a", "2"), ("b", "2"))


def test_a_snapshot_stays_as_it_was(spark, tmp_path):
    root = str(tmp_path / "t")
    W.append(spark, root, _tables(spark, [("a", "1")]), "s", "0")
    early = W.Snapshot(spark, root)
    events = early.table("events")
    W.append(spark, root, _tables(spark, [("a", "2"), ("b", "2")]), "s", "1")
    assert _read(early) == _both(("a", "1")) and events.count() == 1
    W.compact(spark, root)
    assert _read(W.Snapshot(spark, root, 1)) == _both(("a", "1"))
    assert _read(W.Snapshot(spark, root)) == _both(("a", "2"), ("b", "2"))


def test_loads_beside_a_compaction_stay(spark, tmp_path):
    from foliospark.plans import commits

    root = str(tmp_path / "t")
    W.append(spark, root, _tables(spark, [("a", "1"), ("b", "1")]), "s", "0")
    real = commits.commit

    def late(spark, root, load, source, batch, base=None, months=None):
        if source == "compact":  # a load commits while the compaction writes
            commits.commit = real
            W.append(spark, root, _tables(spark, [("b", "2")]), "s", "1")
        return real(spark, root, load, source, batch, base, months)

    commits.commit = late
    try:
        W.compact(spark, root)
    finally:
        commits.commit = real
    assert _read(W.Snapshot(spark, root)) == _both(("a", "1"), ("b", "2"))
    W.compact(spark, root)
    W.append(spark, root, _tables(spark, [("a", "3")]), "s", "2")
    assert _read(W.Snapshot(spark, root)) == _both(("a", "3"), ("b", "2"))


def test_two_loads_never_share_a_number(spark, tmp_path, monkeypatch):
    from foliospark.plans import commits

    root = str(tmp_path / "t")
    assert commits.commit(spark, root, "l-one", "s", "0") == 1
    real, asked = commits.last, []

    def behind(spark, root):
        asked.append(1)
        return 0 if len(asked) == 1 else real(spark, root)

    monkeypatch.setattr(commits, "last", behind)
    assert commits.commit(spark, root, "l-two", "s", "1") == 2
    assert [tuple(r) for r in commits.log(spark, root).select("seq", "load").orderBy("seq").collect()] == [(1, "l-one"), (2, "l-two")]


def test_a_stream_batch_that_runs_twice_loads_once(spark, tmp_path):
    from foliospark.plans import commits

    root = f"{tmp_path}/tables"
    log = tmp_path / "log"
    log.mkdir()
    line = '{"generated_at":"2024-01-0%dT00:00:00Z","folder_name":"F","response_kind":"folder_summary","query":"q"}\n'
    (log / "a.txt").write_text(line % 1)
    ST.stream_load(spark, str(log), root, f"{tmp_path}/check").awaitTermination()
    (log / "b.txt").write_text(line % 2)
    # The commit of the last batch is taken from the checkpoint, as if the driver had died before writing it.
    for f in (tmp_path / "check" / "commits").iterdir():
        f.unlink()
    ST.stream_load(spark, str(log), root, f"{tmp_path}/check").awaitTermination()
    assert commits.last(spark, root) == 2 and W.current(spark, root).count() == 2


def test_stream_rate_and_sessions_read_the_rest_from_state(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:{s:02d}", u) for s in (0, 0, 0, 1, 5, 59) for u in ("x", "y")] + [("2024-01-01 02:00:00", "x"), ("2024-01-01 02:00:30", "x")]
    src = f"{tmp_path}/src"
    spark.createDataFrame(rows, "t string, u string").select(F.col("t").cast("timestamp").alias("ts"), "u").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, u string").parquet(src)
    final = ST.run_to_table(ST.sliding_rate(stream, "ts", 60, 1), f"{tmp_path}/rate", "append")
    both = final.unionByName(ST.open_rate(spark, f"{tmp_path}/rate/checkpoint", 60, 1))
    want = spark.read.parquet(src).groupBy(F.window("ts", "60 seconds", "1 second").alias("w")).count()
    assert sorted((r["start"], r["calls"]) for r in both.collect()) == sorted((r["w"]["start"], r["count"]) for r in want.collect())
    assert ST.open_rate(spark, f"{tmp_path}/rate/checkpoint", 60, 1).count() > 0
    closed = ST.run_to_table(ST.idle_sessions(stream, "ts", "u", "600 seconds", "1 hour"), f"{tmp_path}/idle", "append")
    rest = ST.open_sessions(spark, f"{tmp_path}/idle/checkpoint", "u")
    assert sorted(r["n"] for r in closed.collect()) == [6, 6] and [(r["u"], r["n"]) for r in rest.collect()] == [("x", 2)]
    with pytest.raises(ValueError):
        ST.sliding_rate(stream, "ts", 60, 7)


# ---- stored index


def _hits(rows):
    return sorted((r["query"], r["doc_id"], r["score"], r["rank"]) for r in rows.collect())


def test_stored_index_equals_a_rebuild_after_deltas(spark, tmp_path):
    from foliospark.operators.text_index import TextIndex

    rnd = random.Random(4)
    text = lambda: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 30)))
    queries = spark.createDataFrame([("spring ring",), ("the birch legal",), ("nothing here",), ("12 photos e",)], "query string")
    index = TextIndex(spark, str(tmp_path / "i"), carry=["lang"])
    assert index.search(queries).count() == 0
    live = {}
    for step in range(5):
        add = {rnd.randrange(60): (text(), rnd.choice(["en", "de"])) for _ in range(25 if step == 0 else 6)}
        gone = {rnd.randrange(60) for _ in range(5 if step else 0)}
        docs = spark.createDataFrame([(i, *v) for i, v in add.items()], "doc_id long, text string, lang string")
        index.update(docs, spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None, batch=str(step))
        live = {i: v for i, v in live.items() if i not in gone} | add
        if step == 3:
            index.merge()
        whole = spark.createDataFrame([(i, *v) for i, v in live.items()], "doc_id long, text string, lang string")
        assert _hits(index.search(queries)) == _hits(S.text_search(queries, whole, carry=["lang"]))
    keep = F.col("lang") == "en"
    assert _hits(index.search(queries, keep=keep)) == _hits(S.text_search(queries, whole, keep=keep, carry=["lang"]))


def test_stored_index_reads_no_text_and_loads_a_batch_once(spark, tmp_path):
    from foliospark.operators.text_index import TextIndex
    from foliospark.plans import commits

    root = str(tmp_path / "i")
    index = TextIndex(spark, root)
    docs = spark.createDataFrame([(1, "alder birch"), (1, "alder"), (2, None), (None, "alder")], "doc_id long, text string")
    assert index.update(docs, batch="b") == index.update(docs, batch="b") == 1
    assert commits.last(spark, root) == 1
    got = index.search(spark.createDataFrame([("alder",)], "query string"))
    assert [(r["doc_id"], r["rank"]) for r in got.collect()] == [(1, 1)]
    fields = {n for t in ("postings", "lengths") for n in spark.read.parquet(f"{root}/{t}").columns}
    assert fields == {"bucket", "term", "doc_id", "tf", "len", "load"}
    index.update(None, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert index.search(spark.createDataFrame([("alder",)], "query string")).count() == 0


# ---- sidecars and decoders


def test_one_large_sidecar_object_is_read_in_ranges(spark, tmp_path, monkeypatch):
    import json

    rnd = random.Random(9)
    odd = ['a,b', 'say "x, y"', "back\\", 'end\\"', "{", "}", "[1,2]", '","', ":", "é,", "\\,", ""]
    rows = {f"u/{i}," + rnd.choice(odd): rnd.choice([*odd, "contract"]) for i in range(3000)}
    stray = {"n": 7, "inner": {"a": "x,y", "b": [1, {"c": "}"}]}, "none": None, "list": ["p", "q,"], "flag": True}
    items = [*rows.items(), *stray.items()]
    rnd.shuffle(items)
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "one.json").write_text(json.dumps(dict(items), ensure_ascii=False) + "\n")
    (tmp_path / "s" / "two.json").write_text(json.dumps({"k,1": "v", "k2": 3}, indent=2))
    (tmp_path / "s" / "none.json").write_text("{}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = [tuple(r) for r in CO.read_sidecar(spark, str(tmp_path / "s")).collect()]
        tasks = spark.read.option("lineSep", ",").text(str(tmp_path / "s" / "one.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tasks > 10 and sorted(got) == sorted([*rows.items(), ("k,1", "v")])


def test_only_files_with_a_decoder_reach_python(spark):
    files = spark.createDataFrame([("a.txt", b"plain"), ("b.html", b"<p>x</p>"), ("c.up", b"coded"), ("d.up", b"\xff"), ("e.bin", b"z"), ("f", b"q")], "path string, content binary")
    seen = spark.sparkContext.accumulator(0)

    def up(raw, ext):
        seen.add(1)
        return raw.decode("utf-8").upper()

    got = {r["path"]: (r["text"].strip(), (r["error"] or "")[:12]) for r in CO.extract_text(files, {".up": up}).collect()}
    assert got == {"a.txt": ("plain", ""), "b.html": ("x", ""), "c.up": ("CODED", ""), "d.up": ("", "UnicodeDecod"), "e.bin": ("", "no decoder"), "f": ("", "no decoder")}
    assert seen.value == 2


def test_a_filter_on_the_second_key_alone_skips_row_groups(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.expr("date_add(date '2024-03-01', cast(id % 28 as int))").alias("event_date"),
        F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(40))).alias("bucket"), F.concat(F.lit("f"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(400))).alias("folder_key"),
    )
    path = str(tmp_path / "t")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        W.write_table(rows, path, ("bucket", "folder_key"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    table = spark.read.parquet(path)
    assert table.count() == 60_000

    def rows_read(cond):
        hits = table.filter(cond)
        hits._jdf.queryExecution().executedPlan().execute().count()
        plan, found = hits._jdf.queryExecution().executedPlan(), []

        def walk(node):
            if "FileSourceScan" in node.getClass().getSimpleName():
                found.append(node.metrics().apply("numOutputRows").value())
            if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
                walk(node.executedPlan())
            children = node.children()
            for i in range(children.size()):
                walk(children.apply(i))

        walk(plan)
        return sum(found), hits.count()

    # 32 files hold five bits of the curve: two of either key and one of the day.
    for cond, most in (("folder_key = 'f7'", 40_000), ("bucket = 'p3'", 40_000), ("event_date = date '2024-03-05'", 55_000)):
        read, hits = rows_read(cond)
        assert 0 < hits <= read < most, (cond, read, hits)


def test_related_folders_through_shared_words(spark, monkeypatch):
    monkeypatch.setattr(FO, "MEMBERS", 5)
    names = [f"{i % 13} birch road {i}" for i in range(40)] + ["alder legal", "Alder, Legal", "photos of alder", "xy"]
    folders = spark.createDataFrame([(n,) for n in names], "folder string")
    seeds = folders.filter("folder like '%alder%' or folder like '1 %'")
    links, members = FO.shared_words(folders, ["birch"])
    got = {tuple(r) for r in FO.related_through(seeds, links, members).collect()}
    assert got == {tuple(r) for r in FO.related_folders(seeds, folders, ["birch"]).collect()} and len(got) > 30
    assert members.agg(F.max(F.size("folders"))).first()[0] < 20


# ---- listing


def test_store_listing_is_planned_per_prefix(spark, tmp_path):
    from foliospark.sources import listing

    want = {}
    for i in range(30):
        f = tmp_path / f"p{i % 4}" / f"q{i % 3}" / f"f {i}.txt"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x" * i)
        want[f"p{i % 4}/q{i % 3}/f {i}.txt"] = i
    (tmp_path / "top.txt").write_text("abc")
    (tmp_path / "_marker").write_text("")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        rows = listing.list_store(spark, root)
        assert {r["path"]: r["size_bytes"] for r in rows.collect()} == want | {"top.txt": 3}
        assert rows.rdd.getNumPartitions() == 5
    assert all(r["uri"].startswith(f"file://{tmp_path}/") for r in rows.collect())
    assert listing.list_store(spark, str(tmp_path / "absent")).count() == 0


def test_store_listing_stream_resumes_at_its_cursor(spark, tmp_path):
    from foliospark.sources import listing

    root, out = tmp_path / "store", str(tmp_path / "out")
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.txt").write_text("1")

    def run():
        query = (
            listing.stream_store(spark, str(root), 0).writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/check").trigger(once=True).start()
        )
        query.awaitTermination()
        return sorted(r["path"] for r in spark.read.parquet(f"{out}/rows").collect())

    assert run() == ["a/1.txt"]
    (root / "b").mkdir()
    (root / "b" / "2.txt").write_text("2")
    assert run() == ["a/1.txt", "b/2.txt"] and run() == ["a/1.txt", "b/2.txt"]


# ---- larger tables


def test_joins_of_files_broadcast_neither_side(spark, tmp_path):
    # Small on disk, so that a plan made from sizes of files would broadcast it.
    spark.range(1000).selectExpr("concat('store://corpus/a/b c/', id % 3, '.pdf') as uri", "concat('a/b c/', id % 3, '.pdf') as path",
                                 "concat(id % 3, '.pdf') as name", "'deed' as doc_type").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    wanted = files.selectExpr("split(path, '/')[1] as folder").distinct()
    for df in (FO.with_doc_type(files.drop("doc_type"), files), FO.enumerate_folders(files, wanted)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert FO.enumerate_folders(files, wanted).count() == 1000


def test_a_load_shuffles_its_lines_once(spark, tmp_path):
    item = '{"label":"deed","bucket":"contract","status":"found"}'
    lines = [event_line(str(i), f"2024-0{1 + i % 6}-05", [item, item]) for i in range(60)]
    good = L.split_lines(L.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))[0]
    dealt = W.by_month(good)
    assert sorted(r.line for r in dealt.select("line").collect()) == sorted(lines)
    # What is shuffled holds the text and its time, not the parsed object beside it.
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RebalancePartitions"):].splitlines()[1].strip()
    assert "v#" not in below.split("AS _month")[0]
    root = str(tmp_path)
    W.load(spark, good, root)
    parts = spark.read.parquet(f"{root}/open_items")
    assert parts.count() == 120 and len(parts.inputFiles()) <= 6


def test_a_load_reads_an_object_once_for_all_tables(spark, tmp_path, monkeypatch):
    item = '{"label":"deed","bucket":"contract","status":"found"}'
    lines = [event_line(str(i), f"2024-0{1 + i % 6}-05", [item]) for i in range(30)]
    good = L.split_lines(L.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")))[0]
    written, cut = [], W.cut
    monkeypatch.setattr(W, "cut", lambda df: written.append(df.schema.simpleString()) or cut(df))
    W.load(spark, good, f"{tmp_path}/a")
    # What is written between a line and its tables are their values, not the parsed object, which each table would search again.
    assert written and not any("variant" in schema for schema in written)
    # Lines that came already are found by their ids before anything is read out of them.
    shapes, shaped = [], W.rows.shaped
    monkeypatch.setattr(W.rows, "shaped", lambda df, *how: shapes.append(df.count()) or shaped(df, *how))
    again = spark.createDataFrame([(x,) for x in lines[:29]] + [(lines[29].replace("found", "needs_review"),)], "value string")
    W.load(spark, L.split_lines(L.parse_lines(again))[0], f"{tmp_path}/a", only_changed=True)
    assert shapes == [1] and sorted(r.status for r in W.current(spark, f"{tmp_path}/a", "open_items").collect()) == ["found"] * 29 + ["needs_review"]


def test_lines_dealt_before_they_are_parsed_give_the_same_tables(spark, tmp_path):
    odd = ['{"generated_at": 5}', '{"x":"\\"generated_at\\":\\"2024-01"}', "not json", "", '  {"generated_at" : " 2024-02-03T00:00:00Z "}']
    items = ['{"label":"deed","bucket":"contract","status":"found"}']
    lines = spark.createDataFrame([(x,) for x in odd + [event_line(str(i), f"2024-0{1 + i % 6}-05", items) for i in range(20)]], "value string")
    dealt = W.dealt_lines(lines)
    assert sorted(r.value for r in dealt.collect()) == sorted(r.value for r in lines.collect()) and dealt.columns == ["value"]
    good = L.split_lines(L.parse_lines(dealt))[0]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "parse" in plan[: plan.index("RebalancePartitions")] and "parse" not in plan[plan.index("RebalancePartitions"):]
    W.load(spark, L.split_lines(L.parse_lines(lines))[0], f"{tmp_path}/a")
    W.load(spark, good, f"{tmp_path}/b", dealt=True)
    for name in ("events", "open_items"):
        a, b = (sorted(str(r) for r in W.current(spark, f"{tmp_path}/{x}", name).drop("load", "loaded_at").collect()) for x in "ab")
        assert a == b


def test_values_of_another_kind_are_empty_by_themselves(spark):
    line = ('{"generated_at":"2024-01-02","folder_name":7,"file_count_total":"12","file_count_in_dossier":"many","show_open_items":"No",'
            '"observations":["a",null," ",3],"key_facts":[5,{"label":"L","value":1.50,"sources":"s"},{"label":" ","sources":["s",null]}],"timeline":{},'
            '"structured_fields":{"contract_status":"signed","inspection_status":{"value":true},"x":{"value":{"a":1}}}}')
    good = W.rows.with_event_id(L.split_lines(L.parse_lines(spark.createDataFrame([(line,)], "value string")))[0])
    row = ER.event_rows(good).first()
    assert (row.folder_key, row.file_count_total, row.file_count_in_dossier, row.show_open_items) == ("7", 12, None, False)
    assert row.observations == ["a", "3"] and row.timeline == [] and (row.contract_status, row.inspection_status) == (None, "true")
    assert [tuple(f) for f in row.key_facts] == [("L", "1.5", None, []), (None, None, None, ["s"])]
    assert {(r.field_name, r.field_value) for r in ER.field_rows(good).collect()} == {("inspection_status", "true"), ("x", '{"a":1}')}


def test_steps_of_a_key_are_found_by_halving(spark):
    for values, limits in (([None, 1, 2, 3, 5, 9], [2, 3, 7]), (["", "a", None, "b", "é"], ["a", "b"]), ([None, 4], [])):
        df = spark.createDataFrame([(v,) for v in values], f"k {'string' if '' in values else 'int'}")
        got = {r.k: r.s for r in df.select("k", W.bind(F.col("k"), W._step(limits, lambda n: 10 * n)).alias("s")).collect()}
        assert got == {v: 0 if v is None else 10 * sum(x <= v for x in limits) for v in values}
    # A row costs as many comparisons as a step has bits, not one for each limit.
    rows = spark.range(500).selectExpr("cast(id as int) as a", "date_add(date'2024-01-01', cast(id % 90 as int)) as event_date")
    plan = rows.select(W.z_value(rows, ["event_date", "a"]).alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan
