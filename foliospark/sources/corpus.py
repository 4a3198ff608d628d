"""Corpus scans, sidecars, manifests, sync plans and text extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.classify import doc_type_from_name
from ..functions.names import doc_id, doc_sha1, extract_date, extract_property, repair_title, suffix
from ..functions.text import bind, computed, first_hit, nonempty, strip
from ..functions.values import get, is_object, truthy_at
from ..session import cut


def scan_corpus(spark: SparkSession, root: str, glob: str | None = None, prefix: str = "") -> DataFrame:
    """Listing of the files below ``root``, or below ``root/prefix``, with paths from ``root``.

    Contents are never read: only the path, time and length columns of the
    binary source are selected. The driver lists the folders; for a very large
    store pass an inventory table of (uri, size_bytes, updated) to ``listing``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # A prefix may end inside a name: its last whole folder is listed.
    folder = prefix.lstrip("/").rpartition("/")[0]
    files = reader.load(f"{root.rstrip('/')}/{folder}".rstrip("/"))
    return listing(files.select(F.col("path").alias("uri"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("updated")), root, prefix)


def _qualified(uri: Column) -> Column:
    """A uri with its scheme; local paths get ``file:`` and one leading slash, as the engine lists them."""
    bare = F.regexp_replace(uri, "^file:/*", "/")
    return F.when(bare.startswith("/"), F.concat(F.lit("file:"), F.regexp_replace(bare, "^/+", "/"))).otherwise(bare)


def listing(files: DataFrame, root: str, prefix: str = "") -> DataFrame:
    """Corpus columns of a (uri, size_bytes, updated) inventory; directory markers dropped.

    ``path`` is what follows ``root``; a uri outside of it fails the query. Only
    paths that start with ``prefix`` stay. ``content_type`` follows from the
    suffix, where the inventory has no such column.
    """
    base = _qualified(F.lit(root.rstrip("/") + "/"))
    uri = _qualified(F.col("uri"))
    outside = F.raise_error(F.concat(F.lit(f"not below {root}: "), F.col("uri")))
    rows = (
        files.filter(~F.col("uri").endswith("/"))
        .withColumn("path", F.when(uri.startswith(base), F.substr(uri, F.length(base) + 1)).otherwise(outside))
        .filter(F.col("path").startswith(prefix.lstrip("/")))
        .withColumn("name", F.substring_index("uri", "/", -1))
        .withColumn("ext", suffix(F.col("name")))
    )
    if "content_type" in files.columns:
        return rows
    known = first_hit([(F.col("ext") == e, F.lit(t)) for e, t in rules.MIME_TYPES], F.lit(rules.DEFAULT_MIME))
    return rows.withColumn("content_type", known)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(uri, doc_type) of sidecar files, each holding one JSON object; other values dropped.

    A file is read in ranges by many tasks, cut at every comma. Whether a cut
    lies inside a string, and how deep inside other values, follows from the
    quotes and brackets of all pieces before it: these are summed per range,
    carried from range to range, and then within each range. Pieces between
    two cuts outside any string or inner value make up one entry.
    """
    pieces = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    )
    bare = F.regexp_replace("value", r"\\.", "")
    pieces = pieces.withColumn("quotes", (F.regexp_count(bare, F.lit('"')) % 2).cast("int"))
    state = cut(_carried(pieces, "quotes").withColumn("inside", F.pmod("before_quotes", F.lit(2))).drop("before_quotes", "quotes"))
    # Outside of strings only brackets change the depth; the file's own braces keep every entry at 1.
    plain = F.regexp_replace(F.regexp_replace(F.concat(F.when(F.col("inside") == 1, '"').otherwise(""), bare), r'"[^"]*"', ""), r'"[^"]*$', "")
    state = state.withColumn("depth", (F.regexp_count(plain, F.lit(r"[{\[]")) - F.regexp_count(plain, F.lit(r"[}\]]"))).cast("int"))
    state = _carried(state, "depth").withColumn("starts", (F.col("inside") == 0) & (F.col("before_depth") <= 1))
    state = cut(state.select("file", "block", "at", "value", F.col("starts").cast("int").alias("starts")))
    numbered = _carried(state, "starts").withColumn("entry", F.col("before_starts") + F.col("starts"))
    whole = numbered.groupBy("file", "entry").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), ",")
    # Of an entry, its pair alone: the file's own braces stand at the first and behind the last.
    pair = F.regexp_replace(F.regexp_replace(text, r"^\s*\{", ""), r"\}\s*$", "")
    kept = F.when(F.col("last") & text.rlike(r"\}\s*$"), pair).otherwise(F.regexp_replace(text, r"^\s*\{", ""))
    last = F.col("entry") == F.max("entry").over(Window.partitionBy("file"))
    return sidecar_rows(whole.withColumn("last", last).select(F.concat(F.lit("{"), kept, F.lit("}")).alias("value")))


def _carried(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``before_<column>``, the sum of ``column`` over all rows of the file before: per range, then inside ranges."""
    ranges = cut(rows.groupBy("file", "block").agg(F.sum(column).alias("s")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("file", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.join(base, ["file", "block"]).withColumn(f"before_{column}", F.col("_base") + F.coalesce(F.sum(column).over(inner), F.lit(0)))
    return run.drop("_base")


def sidecar_rows(objects: DataFrame, column: str = "value") -> DataFrame:
    entry = F.col("entry")
    return (
        objects.select(F.explode(get(F.try_parse_json(column), "$", "map<string,variant>")).alias("uri", "entry"))
        .filter(F.schema_of_variant(entry) == "STRING")
        .select("uri", get(entry, "$", "string").alias("doc_type"))
    )


# -- manifests --------------------------------------------------------------


def _inner(v: Column, path: str) -> Column:
    """Nested object that may itself be a JSON string."""
    parsed = F.coalesce(F.try_parse_json(get(v, path, "string")), get(v, path, "variant"))
    return F.when(is_object(parsed), parsed)


def _record(v: Column) -> Column:
    """Struct of what a manifest record says, from its parsed line."""

    def body(r: Column) -> Column:
        v, sd, jd = r["v"], r["sd"], r["jd"]
        has_sd, has_jd = truthy_at(v, "$.structData"), truthy_at(v, "$.jsonData")
        envelope = (
            F.when(has_sd & has_jd, "both").when(has_sd, "structData_only").when(has_jd, "jsonData_only").otherwise("neither")
        )
        text = lambda o, path: nonempty(get(o, path, "string"))
        content = (
            F.when(text(v, "$.content.rawBytes").isNotNull(), "extracted")
            .when(text(v, "$.content.uri").isNotNull(), "passthrough").otherwise("pointer")
        )
        stored = text(sd, "$.source_uri")
        uri = F.coalesce(text(v, "$.content.uri"), text(sd, "$.gcs_uri"), F.when(stored.contains("://"), stored), F.lit(""))
        filled = F.coalesce(F.size(get(sd, "$", "map<string,variant>")), F.lit(0)) > 0
        return F.struct(
            get(v, "$.id", "string").alias("id"), envelope.alias("envelope"), content.alias("content_class"),
            F.when(filled, sd).otherwise(jd).alias("data"),
            F.regexp_extract(uri, r"^[a-z0-9]+://[^/]+/(.+)\z", 1).alias("path"),
        )

    parts = F.struct(v.alias("v"), _inner(v, "$.structData").alias("sd"), _inner(v, "$.jsonData").alias("jd"))
    return bind(parts, body)


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """Manifest records of either envelope with their struct data, path and kinds."""
    # Behind a generator both filters stay here; pushed down they would read every line a second time, in the scan's tasks.
    stripped = computed(lines.select(F.col(column).alias("_raw")), line=strip(F.col("_raw"))).select("line").filter("line <> ''")
    record = bind(F.try_parse_json("line"), lambda v: F.when(v.isNotNull(), _record(v)))
    return computed(stripped, r=record).filter("r is not null").select("r.*", "line")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def id_prefix(doc: Column, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(doc, "_"), 1, n), "_")


def build_manifest(corpus: DataFrame, tags: Column) -> DataFrame:
    """Records of the classified files; ``tags`` is a tag struct, NULL for the rest."""
    t = F.col("_tags")
    classified = corpus.withColumn("_tags", tags).filter(t.isNotNull())
    data = F.struct(
        *[t[f].alias(f) for f in ("property", "category", "doc_type", "subpath", "filename")],
        F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss+00:00").alias("updated"),
        F.col("uri").alias("source_uri"), t["filename"].alias("title"),
    )
    return classified.select(
        doc_sha1(F.col("uri")).alias("id"), data.alias("structData"),
        F.struct(F.coalesce("content_type", F.lit("application/octet-stream")).alias("mimeType"), F.col("uri")).alias("content"),
    )


def write_manifest(records: DataFrame, path: str) -> None:
    records.select(F.to_json(F.struct("id", "structData", "content")).alias("value")).write.mode("overwrite").text(path)


def path_fields(path: Column, title: Column, prefix: str = "mirror", scope: str = "", month_year: int = 2023) -> dict[str, Column]:
    """Fields that follow from a path alone."""
    name = F.substring_index(path, "/", -1)
    prop, kind, date = extract_property(path, scope, prefix), doc_type_from_name(name), extract_date(name, month_year)
    return {"property": prop, "document_type": kind, "doc_date": nonempty(date), "title": repair_title(F.coalesce(title, name), prop, kind)}


def id_paths(corpus: DataFrame) -> DataFrame:
    """(id, path): the first path of every document id."""
    return corpus.groupBy(doc_id(F.col("path")).alias("id")).agg(F.min("path").alias("id_path"))


def refresh_manifest(manifest: DataFrame, corpus: DataFrame, **kw) -> DataFrame:
    """Recompute path fields of parsed records; a specific stored type stays.

    Records without a path are looked up by id; records without either keep
    what they have. Adds ``status``: added, changed, unchanged or no_path.
    """
    found = manifest.join(id_paths(corpus), "id", "left").withColumn("path", F.coalesce(nonempty(F.col("path")), F.col("id_path")))
    old = {k: get(F.col("data"), f"$.{k}", "string") for k in ("property", "document_type", "doc_type", "doc_date", "title")}
    staged = found.withColumns({f"old_{k}": c for k, c in old.items()})
    new = path_fields(F.col("path"), F.col("old_title"), **kw)
    specific = lambda c: F.when((c != "") & (c != rules.DEFAULT_TYPE), c)
    known = F.col("path").isNotNull()
    out = staged.withColumns(
        {
            "property": F.when(known, new["property"]).otherwise(F.col("old_property")),
            "document_type": F.when(known, F.coalesce(specific(F.col("old_document_type")), new["document_type"])).otherwise(F.col("old_document_type")),
            "doc_date": F.when(known, F.coalesce(new["doc_date"], F.col("old_doc_date"))).otherwise(F.col("old_doc_date")),
            "title": F.when(known, new["title"]).otherwise(F.col("old_title")),
        }
    )
    same = F.lit(True)
    before = F.lit(False)
    for k in ("property", "document_type", "doc_date", "title"):
        same = same & F.col(k).eqNullSafe(F.col(f"old_{k}"))
        before = before | F.col(f"old_{k}").isNotNull()
    status = F.when(~known, "no_path").when(same, "unchanged").when(~before, "added").otherwise("changed")
    return out.withColumn("status", status).drop("id_path", "old_doc_type", *[f"old_{k}" for k in ("property", "document_type", "doc_date", "title")])


def reclassify(corpus: DataFrame, sidecar: DataFrame, classify: Callable[[Column], Column] = doc_type_from_name,
               protected: Sequence[str] = rules.PROTECTED_TAGS) -> DataFrame:
    """New sidecar: names classified afresh, protected tags kept."""
    joined = corpus.select("uri", "name").join(sidecar.select("uri", F.col("doc_type").alias("_old")), "uri", "left")
    kept = F.when(F.col("_old").isin(*protected), F.col("_old")) if protected else F.lit(None).cast("string")
    return joined.select("uri", F.coalesce(kept, classify(F.col("name"))).alias("doc_type"))


# -- sync planning ----------------------------------------------------------


def plan_sync(source: DataFrame, mirrored: DataFrame, force: bool = False, allowed: Sequence[str] = rules.SYNC_EXTS) -> DataFrame:
    """Outcome per source file: skipped_ext, skipped_same or uploaded.

    ``source`` has ``path, source_mtime``; ``mirrored`` the stored times.
    """
    stored = mirrored.select("path", F.col("source_mtime").alias("_stored"))
    same = F.lit(not force) & F.coalesce(F.col("_stored") == F.col("source_mtime"), F.lit(False))
    return (
        source.join(stored, "path", "left")
        .withColumn("outcome", F.when(~suffix(F.substring_index("path", "/", -1)).isin(*allowed), "skipped_ext").when(same, "skipped_same").otherwise("uploaded"))
        .drop("_stored")
    )


def sync_stats(plan: DataFrame, by: str = "source", size: str = "size_bytes") -> DataFrame:
    is_ = lambda o: F.col("outcome") == o
    return plan.groupBy(by).agg(
        F.count("*").alias("walked"), F.count_if(is_("uploaded")).alias("uploaded"),
        F.count_if(is_("skipped_same")).alias("skipped_same"), F.count_if(is_("skipped_ext")).alias("skipped_ext"),
        F.count_if(is_("error")).alias("errors"),
        F.coalesce(F.sum(F.when(is_("uploaded"), F.col(size))), F.lit(0)).alias("bytes"),
    )


def merge_stats(stats: DataFrame) -> DataFrame:
    return stats.agg(*[F.sum(c).alias(c) for c in ("walked", "uploaded", "skipped_same", "skipped_ext", "errors", "bytes")])


def resume(todo: DataFrame, done: DataFrame, on: str = "blob_name") -> DataFrame:
    """Work items that an earlier output does not hold yet."""
    return todo.join(done.select(on).distinct(), on, "left_anti")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def mirror_path(parent: Column, name: Column, prefix: str = "mirror") -> Column:
    """Path in the mirror of a source item's parent path and name."""
    inner = F.regexp_replace(F.regexp_replace(parent, r"(?s)^.*root:", ""), r"^/+|/+\z", "")
    return F.concat_ws("/", F.lit(prefix), nonempty(inner), name)


def message_path(subject: Column, sent: Column, message_id: Column, slug_chars: int = 40, id_chars: int | None = None) -> Column:
    """``YYYY-MM/<slug of the subject>_<id>``; undated messages go to ``unknown``.

    The whole id ends the path, so no two messages share one; ``id_chars``
    cuts it where paths must be as short as those of an older mirror.
    """
    short = message_id if id_chars is None else F.substring(message_id, 1, id_chars)
    slug = F.substring(F.lower(F.regexp_replace(F.regexp_replace(subject, r"[^a-zA-Z0-9]+", "-"), r"^-+|-+\z", "")), 1, slug_chars)
    month = F.coalesce(F.date_format(sent, "yyyy-MM"), F.lit("unknown"))
    return F.concat(month, F.lit("/"), F.coalesce(nonempty(slug), F.substring(message_id, 1, 12)), F.lit("_"), short)


# -- documents from rows and tables -----------------------------------------


def rows_to_docs(df: DataFrame, row_id: str, cols: Sequence[str], path_base: str = "mirror/Properties/_csv/table") -> DataFrame:
    """Each row as a small text document, one ``Column: value`` line per value."""
    lines = [F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in cols]
    return df.select(
        F.concat(F.lit(f"{path_base}/"), F.col(row_id).cast("string"), F.lit(".txt")).alias("path"),
        F.concat_ws("\n", *lines).alias("text"),
    )


def table_rows_to_docs(tables: DataFrame, min_rows: int = rules.TABLE_MIN_ROWS, min_cols: int = rules.TABLE_MIN_COLS) -> DataFrame:
    """Rows of extracted tables as documents.

    ``tables`` has ``source, page, table_idx, rows ARRAY<ARRAY<STRING>>``; the
    first row is the header. Small tables and empty rows are dropped.
    """
    clean = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    headers = F.transform(
        F.get("rows", F.lit(0)), lambda h, i: F.coalesce(nonempty(clean(h)), F.concat(F.lit("col_"), i.cast("string")))
    )
    big = tables.filter(F.size("rows") >= min_rows + 1).withColumn("headers", headers).filter(F.size("headers") >= min_cols)
    body = big.select("source", "page", "table_idx", "headers", F.posexplode("rows").alias("row_idx", "cells")).filter("row_idx > 0")
    cells = body.withColumn("cells", F.transform(F.slice("cells", 1, F.size("headers")), clean)).filter(F.exists("cells", lambda c: c != ""))
    # A repeated header keeps the place of its first column and the value of its last.
    names = F.array_distinct(F.slice("headers", 1, F.size("cells")))
    value_of = lambda name: F.element_at(
        F.filter(F.arrays_zip(F.slice("headers", 1, F.size("cells")).alias("h"), F.col("cells").alias("c")), lambda p: p["h"] == name), -1
    )["c"]
    pairs = F.filter(
        F.transform(names, lambda n: F.struct(n.alias("k"), value_of(n).alias("v"))),
        lambda p: (p["v"] != "") & ~p["k"].startswith("_"),
    )
    table = F.concat(F.lit("t"), (F.col("table_idx") + 1).cast("string"))
    seed = F.concat_ws("_", "source", table, F.col("row_idx").cast("string"))
    text = F.concat(F.lit("["), F.col("source"), F.lit("] "), F.array_join(F.transform(pairs, lambda p: F.concat_ws(": ", p["k"], p["v"])), " | "))
    return cells.select(
        F.concat(F.lit("tbl_"), F.substring(F.md5(seed), 1, 16)).alias("id"),
        "source", "page", table.alias("table"), "row_idx", text.alias("text"),
    )


# -- text extraction --------------------------------------------------------

Decoder = Callable[[bytes, str], str]


def plain_text(content: Column, ext: Column) -> Column:
    """Text of plain and HTML files; NULL for formats that need a decoder."""
    raw = F.make_valid_utf8(content.cast("string"))
    return F.when(ext.isin(*rules.HTML_EXTS), F.regexp_replace(raw, r"<[^>]+>", " ")).when(ext.isin(*rules.TEXT_EXTS), raw)


def extract_text(files: DataFrame, decoders: dict[str, Decoder] | None = None, limit: int | None = None) -> DataFrame:
    """Add ``text`` and ``error`` to (path, content) rows, whole texts unless ``limit`` cuts them.

    Plain and HTML files are decoded by the engine, a file without a decoder
    has an empty text and an error. Only files of a suffix in ``decoders`` go
    to Python, in Arrow batches, in a second scan of the files.
    """
    ext = F.col("ext")
    known = F.coalesce(ext.isin(*rules.TEXT_EXTS, *rules.HTML_EXTS), F.lit(False))
    typed = files.withColumn("ext", suffix(F.substring_index("path", "/", -1)))
    table = {k: v for k, v in (decoders or {}).items() if k not in {*rules.TEXT_EXTS, *rules.HTML_EXTS}}
    coded = F.coalesce(ext.isin(*table), F.lit(False)) if table else F.lit(False)
    done = typed.filter(~coded).withColumn("text", F.when(known, plain_text(F.col("content"), ext)).otherwise("")).withColumn(
        "error", F.when(~known, "no decoder")
    ).drop("content")
    if table:

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, errors = [], []
                for content, kind in zip(pdf["content"], pdf["ext"]):
                    text, error = "", None
                    try:
                        text = table[kind](content, kind)
                    except Exception as exc:  # a broken file must not fail the job
                        error = f"{type(exc).__name__}: {exc}"
                    texts.append(text)
                    errors.append(error)
                yield pdf.drop(columns="content").assign(text=texts, error=errors)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.schema.fields)
        done = done.unionByName(typed.filter(coded).mapInPandas(decode, fields))
    return done if limit is None else done.withColumn("text", F.substring("text", 1, limit))


def cache_path(path: Column) -> Column:
    return F.concat(F.lit("ocr-cache/"), path, F.lit(".txt"))


def with_cached_text(corpus: DataFrame, cache: DataFrame) -> DataFrame:
    """Add cached text where it is not older than its file (``cache``: path, updated, text)."""
    c = cache.select(F.col("path").alias("_cache"), F.col("updated").alias("_cached_at"), F.col("text").alias("_text"))
    joined = corpus.withColumn("_cache", cache_path(F.col("path"))).join(c, "_cache", "left")
    fresh = F.col("_cached_at").isNotNull() & ~F.coalesce(F.col("updated") > F.col("_cached_at"), F.lit(False))
    return joined.withColumn("cached_text", F.when(fresh, F.col("_text"))).drop("_cache", "_cached_at", "_text")

