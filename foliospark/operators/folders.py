"""Folders: enumeration, inventories, checklists, dossiers, photo pointers.

A corpus has ``uri, path, name, size_bytes, updated``; ``path`` is relative to
the store. Folder names match on their normalised form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.classify import bucket_of, doc_type_or_name, predicted_purpose_from, purpose_from
from ..functions.names import distinctive, doc_id, normalize_name, path_folders, path_parts, suffix
from ..functions.text import computed, ends_with_any, explode_once, strip, words
from ..session import apart


def folder_set(corpus: DataFrame, prefix: str = "mirror/") -> DataFrame:
    """Distinct folder names anywhere below the prefix; files of one folder share its path, which is taken apart once."""
    file = F.substring_index("path", "/", -1)
    above = corpus.select(F.left("path", F.length("path") - F.length(file)).alias("path")).distinct()
    return explode_once(above, path_folders(F.col("path"), prefix), "folder").select("folder").distinct()


def folder_word_counts(folders: DataFrame) -> DataFrame:
    """Occurrences of each word over all folder names."""
    return (
        folders.select(F.explode(words(normalize_name(F.col("folder")))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def with_doc_type(corpus: DataFrame, sidecar: DataFrame | None) -> DataFrame:
    """Add ``doc_type``: the stored one where there is one, else by file name."""
    if sidecar is None:
        return corpus.withColumn("doc_type", doc_type_or_name(F.lit(None).cast("string"), F.col("name")))
    joined = corpus.join(apart(sidecar.select("uri", F.col("doc_type").alias("_stored"))), "uri", "left")
    return joined.withColumn("doc_type", doc_type_or_name(F.col("_stored"), F.col("name"))).drop("_stored")


def folder_hits(corpus: DataFrame, extensions: Sequence[str] | None = rules.SEARCHABLE_EXTS + rules.MARKER_EXTS) -> DataFrame:
    """One row per (file, normalised folder on its path), with the subfolder below it.

    Extensions are filtered first. Repeats of a folder along one path are
    removed inside the row, so the first position wins without a shuffle.
    """
    files = corpus if extensions is None else corpus.filter(ends_with_any(F.lower("name"), extensions))
    parts = F.split(F.col("path"), "/")
    norms = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), normalize_name)
    spread = computed(files, _norms=norms, _parts=parts)
    hits = F.transform(
        F.col("_norms"),
        lambda n, i: F.struct(n.alias("folder_norm"), i.alias("pos"), (F.array_position(F.col("_norms"), n) == i + 1).alias("first")),
    )
    kept = F.filter(hits, lambda h: (h["folder_norm"] != "") & h["first"])
    below = F.when(F.col("h.pos") + 1 < F.size("_parts") - 1, F.get(F.col("_parts"), F.col("h.pos") + 1)).otherwise("")
    return (
        explode_once(spread, kept, "h")
        .withColumn("subfolder", below)
        .withColumn("folder_norm", F.col("h.folder_norm"))
        .withColumn("is_marker", ends_with_any(F.lower("name"), rules.MARKER_EXTS))
        .drop("_norms", "_parts", "h")
    )


def enumerate_folders(corpus: DataFrame, folders: DataFrame, **kw) -> DataFrame:
    """Files below each wanted folder: one join on the normalised name."""
    wanted = folders.withColumn("folder_norm", normalize_name(F.col("folder"))).filter("folder_norm <> ''")
    return folder_hits(corpus, **kw).join(apart(wanted), "folder_norm").drop("folder_norm")


def related_folders(seeds: DataFrame, folders: DataFrame, noise: Sequence[str] = rules.CATEGORY_NOISE_WORDS) -> DataFrame:
    """Other folders sharing a distinctive word with a seed folder."""
    seed_words = seeds.select("folder").distinct().select(
        "folder", F.explode(distinctive(normalize_name(F.col("folder")), noise)).alias("word")
    )
    other_words = folders.select(
        F.col("folder").alias("related"), F.explode(F.array_distinct(words(normalize_name(F.col("folder"))))).alias("word")
    )
    return seed_words.join(other_words, "word").filter("related <> folder").select("folder", "related").distinct()


#: Most folders, about, in one block of a word's members.
MEMBERS = 1000


def shared_words(folders: DataFrame, noise: Sequence[str] = rules.CATEGORY_NOISE_WORDS) -> tuple[DataFrame, DataFrame]:
    """Related folders without a row for every pair: links and members.

    ``links (folder, word, others)``: the distinctive words of a folder that
    ``others`` more folders have. ``members (word, block, folders)``: the
    folders of each such word, in blocks of bounded size. Both grow with the
    words of the folders; ``related_through`` reads the pairs of some folders.
    """
    norm = normalize_name(F.col("folder"))
    held = folders.select("folder").distinct().select("folder", F.explode(F.array_distinct(words(norm))).alias("word"))
    telling = folders.select("folder").distinct().select("folder", F.explode(distinctive(norm, noise)).alias("word"))
    sizes = held.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")
    used = sizes.join(telling.select("word").distinct(), "word", "left_semi")
    blocks = F.ceil(F.col("n") / MEMBERS)
    members = (
        held.join(used, "word").withColumn("block", F.pmod(F.xxhash64("folder"), blocks).cast("int"))
        .groupBy("word", "block").agg(F.array_sort(F.collect_list("folder")).alias("folders"))
    )
    links = telling.join(used, "word").select("folder", "word", (F.col("n") - 1).alias("others"))
    return links, members


def related_through(seeds: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``related_folders`` for some seed folders, read from ``shared_words``."""
    mine = seeds.select("folder").distinct().join(links, "folder").select("folder", "word")
    found = mine.join(members, "word").select("folder", F.explode("folders").alias("related"))
    return found.filter("related <> folder").distinct()


def top_names(files: DataFrame, group: Sequence[str], n: int, order: Sequence[str] = ("name",), value: str = "name") -> DataFrame:
    """First ``n`` names per group as an array; the limit also runs map-side."""
    w = Window.partitionBy(*group).orderBy(*order)
    return (
        files.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= n)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("v")))).alias("_s"))
        .select(*group, F.transform("_s", lambda s: s["v"]).alias("samples"))
    )


def folder_inventory(files: DataFrame, folder: str = "folder", cap: int = 500, samples: int = 3) -> DataFrame:
    """Per folder: files, capped display, files per bucket, sample names, purpose by buckets.

    ``files`` has one row per (folder, file) with ``name, path, bucket``. Counts
    are whole; only the display text is capped.
    """
    per_bucket = files.groupBy(folder, "bucket").agg(F.count("*").alias("n"))
    counts = per_bucket.groupBy(folder).agg(
        F.sum("n").alias("file_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("buckets"),
    )
    return (
        counts.join(top_names(files, [folder], samples, ("path",)), folder, "left")
        .withColumn("file_count_display", F.when(F.col("file_count") > cap, f"{cap}+").otherwise(F.col("file_count").cast("string")))
        .withColumn("predicted_purpose", predicted_purpose_from(F.map_keys("buckets")))
    )


def folder_purpose(items: DataFrame, folder: str = "folder", admin_extra: Sequence[str] = ()) -> DataFrame:
    """Purpose per folder from item rows (``bucket``, ``is_marker``).

    The set holds bucket names, a fixed short list.
    """
    return (
        items.groupBy(folder)
        .agg(F.collect_set("bucket").alias("buckets"), F.bool_or("is_marker").alias("has_marker"))
        .withColumn("folder_purpose", purpose_from(F.col("buckets"), F.col("has_marker"), F.col(folder), admin_extra))
    )


def checklist_table(spark: SparkSession, checklists=rules.CHECKLISTS) -> DataFrame:
    """Checklist lines as rows: a fixed table of a dozen lines."""
    rows = [
        (name, purpose, i, label, bucket, list(strict) if strict else None)
        for name, purpose, lines in checklists
        for i, (label, bucket, strict) in enumerate(lines)
    ]
    return spark.createDataFrame(
        rows, "checklist_name string, folder_purpose string, ord int, label string, bucket string, strict array<string>"
    )


def checklist_name(purpose: Column, checklists=rules.CHECKLISTS) -> Column:
    out = F.lit(None).cast("string")
    for name, wanted, _ in checklists:
        out = F.when(purpose == wanted, name).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def open_items(purposes: DataFrame, items: DataFrame, checklist: DataFrame, folder: str = "folder") -> DataFrame:
    """Checklist lines per folder: found, needs_review or not_found.

    Items are first counted per (folder, bucket, type), so what meets the
    checklist is a handful of rows per folder. Folders of unknown purpose have
    no checklist and no lines.
    """
    counted = items.groupBy(folder, "bucket", F.lower(F.coalesce("doc_type", F.lit(""))).alias("doc_type")).agg(
        F.count("*").alias("n")
    )
    lines = purposes.select(folder, "folder_purpose").join(F.broadcast(checklist), "folder_purpose")
    strict_hit = F.col("strict").isNull() | F.array_contains("strict", F.col("doc_type"))
    return (
        lines.join(counted, [folder, "bucket"], "left")
        .groupBy(folder, "folder_purpose", "checklist_name", "ord", "label", "bucket")
        .agg(
            F.coalesce(F.sum(F.when(strict_hit, F.col("n"))), F.lit(0)).alias("strict_count"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"),
        )
        .withColumn(
            "status",
            F.when(F.col("total_count") == 0, "not_found").when(F.col("strict_count") > 0, "found").otherwise("needs_review"),
        )
    )


def tier_budget(rank: Column, tiers=rules.DOSSIER_TIERS) -> Column:
    """Characters of text kept for a file's rank."""
    out, last = None, 0
    for count, chars in tiers:
        last += count
        out = F.when(rank <= last, chars) if out is None else out.when(rank <= last, chars)
    return out.otherwise(0)


def dossier(ranked: DataFrame, texts: DataFrame | None, folder: str = "folder", order: Sequence[Column] = (),
            tiers=rules.DOSSIER_TIERS) -> DataFrame:
    """Top files per folder with tiered excerpts.

    Files are ranked and limited before their text is joined, and the text is
    cut to its budget; marker files carry none.
    """
    limit = sum(count for count, _ in tiers)
    w = Window.partitionBy(folder).orderBy(*order)
    top = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    top = top.withColumn("char_budget", tier_budget(F.col("rank"), tiers))
    if texts is not None:
        top = top.join(texts.select("uri", "text"), "uri", "left")
    else:
        top = top.withColumn("text", F.lit(None).cast("string"))
    body = F.when(~F.col("is_marker"), F.coalesce("text", F.lit(""))).otherwise("")
    return (
        top.withColumn("full_text_len", F.length(body))
        .withColumn("snippet", F.substring(body, F.lit(1), F.col("char_budget")))
        .withColumn("snippet_chars", F.length("snippet"))
        .withColumn("has_text", strip(F.col("snippet")) != "")
        .drop("text")
    )


def subfolder_groups(files: DataFrame, folder: str = "folder", samples: int = 3) -> DataFrame:
    """Files per subfolder with its first names."""
    keys = [folder, "subfolder"]
    counts = files.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.join(top_names(files, keys, samples, ("name", "uri")), keys)


def extension_counts(corpus: DataFrame, folders: DataFrame) -> DataFrame:
    """Files per folder and suffix, for every kind of file."""
    hits = enumerate_folders(corpus, folders, extensions=None)
    ext = suffix(F.col("name"))
    return hits.groupBy("folder", F.when(ext == "", "(no-ext)").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))


def photo_group(parent: Column, scope: str = "") -> Column:
    """Folder pair a photo is filed under: two levels below the scope, else the last two."""
    parts = path_parts(parent)
    size = F.size(parts)
    scope_parts = [p for p in scope.split("/") if p.strip()]
    if scope_parts:
        n = len(scope_parts)
        inside = F.slice(parts, 1, n) == F.array(*[F.lit(p) for p in scope_parts])
        parts = F.when(inside, F.slice(parts, n + 1, F.greatest(size, F.lit(0)))).otherwise(parts)
        pair = F.slice(parts, 1, 2)
    else:
        pair = F.slice(parts, F.when(size >= 2, size - 1).otherwise(1), 2)
    return F.when(F.size(pair) == 0, "Unknown").otherwise(F.array_join(pair, "/"))


def photo_pointers(photos: DataFrame, scope: str = "", name: str = "name", parent: str = "parent",
                   link_base: str = "") -> DataFrame:
    """One pointer document per photo folder, with its count."""
    only = photos.filter(ends_with_any(F.lower(name), rules.PHOTO_EXTS))
    key = F.col("prop_key")
    prop = F.substring_index(key, "/", 1)
    sub = F.when(key.contains("/"), F.substring_index(key, "/", -1)).otherwise("photos")
    link = F.concat_ws("/", *([F.lit(link_base)] if link_base else []), *([F.lit(scope)] if scope else []), F.col("property"), sub)
    return (
        only.groupBy(photo_group(F.col(parent), scope).alias("prop_key"))
        .agg(F.count("*").alias("photo_count"))
        .withColumn("property", prop)
        .withColumn("url", link)
        .withColumn("doc_id", doc_id(F.concat(F.lit("photo_pointer_"), key)))
        .withColumn("title", F.concat(F.col("property"), F.lit(" — Photos ("), F.col("photo_count"), F.lit(" images)")))
        .withColumn("document_type", F.lit("photo_index"))
    )


def photo_index(pointers: DataFrame, position: str = "prop_key") -> DataFrame:
    """Largest pointer per property; among equals the later one."""
    return (
        pointers.filter("property <> '' and url <> ''")
        .groupBy("property")
        .agg(F.max_by(F.struct("url", "photo_count", "title"), F.struct("photo_count", position)).alias("p"))
        .select("property", "p.*")
    )


def inventory_items(hits: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """Folder files with their type and display bucket."""
    typed = with_doc_type(hits, sidecar)
    return typed.withColumn("bucket", bucket_of(F.col("doc_type"), F.col("name")))
