"""Path, name and id functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .text import contains_any, ends_with_any, first_hit, nonempty, rx, string_array, strip, words


def base_name(path: Column) -> Column:
    """Last component of a path."""
    return F.substring_index(F.regexp_replace(path, r"(/+\.)*/*\z", ""), "/", -1)


def stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def suffix(name: Column) -> Column:
    """Lower-cased last suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def last_dot_ext(name: Column) -> Column:
    """Lower-cased text after the last dot, with the dot; '' without one."""
    return F.when(name.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def normalize_name(name: Column) -> Column:
    """Lower-cased words of a name: last component, short suffix off, the rest blanks."""
    base = F.regexp_replace(F.lower(base_name(name)), r"(?s)\.[\p{L}\p{N}]{1,5}\z", "")
    return F.trim(F.regexp_replace(base, r"[^a-z0-9]+", " "))


def normalize_title(name: Column) -> Column:
    """Title form: stem with blanks, ``_``, ``-`` and ``.`` collapsed; other marks stay."""
    return strip(F.regexp_replace(stem(F.lower(base_name(name))), rx(r"[\s_\-.]+"), " "))


def strip_filler(norm: Column, stop: Sequence[str] = rules.QUERY_STOP_WORDS) -> Column:
    stop_words = string_array(stop)
    return F.array_join(F.filter(words(norm), lambda w: ~F.array_contains(stop_words, w)), " ")


def core_query(norm: Column) -> Column:
    """Filler-free query, or the query itself when nothing else is left."""
    return F.coalesce(nonempty(strip_filler(norm)), norm)


def is_distinctive(word: Column) -> Column:
    return word.rlike(r"\d") | (F.length(word) >= 4)


def distinctive(norm: Column, noise: Sequence[str] = rules.CATEGORY_NOISE_WORDS) -> Column:
    """Distinct words that carry a digit or four letters and are not noise."""
    noise_words = string_array(noise)
    return F.array_distinct(
        F.filter(words(norm), lambda w: is_distinctive(w) & ~F.array_contains(noise_words, w))
    )


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def _drop_lead(parts: Column, lead: Sequence[str]) -> Column:
    if not lead:
        return parts
    n = len(lead)
    same = F.slice(parts, 1, n) == string_array(list(lead))
    return F.when(same, F.slice(parts, n + 1, F.size(parts))).otherwise(parts)


def extract_property(path: Column, scope: str = "", prefix: str = "mirror") -> Column:
    """Grouping folder: first part below prefix and scope, '' for files directly there."""
    parts = path_parts(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = _drop_lead(parts, [prefix])
    parts = _drop_lead(parts, [p for p in scope.strip("/").split("/") if p.strip()])
    return F.when(F.size(parts) >= 2, F.get(parts, F.lit(0))).otherwise("")


def path_folders(path: Column, prefix: str = "mirror/") -> Column:
    """Folder names above the file, below the prefix where the path has it; no blank and dot names."""
    lead = prefix.strip("/") + "/"
    below = path if lead == "/" else F.when(path.startswith(lead), F.substr(path, F.lit(len(lead) + 1))).otherwise(path)
    parts = F.split(below, "/")
    inner = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(F.transform(inner, strip), lambda s: (s != "") & ~s.startswith("."))


def ext_flags(name: Column) -> Column:
    """Struct of searchable / marker / enumerable flags."""
    low = F.lower(name)
    searchable, marker = ends_with_any(low, rules.SEARCHABLE_EXTS), ends_with_any(low, rules.MARKER_EXTS)
    return F.struct(
        searchable.alias("searchable"), marker.alias("marker"), (searchable | marker).alias("enumerable")
    )


def extract_date(name: Column, month_year: int = 2023) -> Column:
    """``YYYY-MM-DD`` leading the name, else ``<month_year>-MM`` for a month word, else ''.

    Days are checked against 1-31 only and months may sit inside longer words.
    """
    digits = F.regexp_extract(stem(name), r"^([0-9]{8})", 1)
    y, m, d = F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)
    valid = (
        (digits != "") & y.between("2015", "2030") & m.between("01", "12") & d.between("01", "31")
    )
    low = F.lower(name)
    months = [(low.contains(mon), F.lit(f"{month_year}-{i:02d}")) for i, mon in enumerate(rules.MONTHS, 1)]
    return F.when(valid, F.concat_ws("-", y, m, d)).otherwise(first_hit(months, F.lit("")))


def doc_id(path: Column) -> Column:
    """Id-safe form of a path, at most 128 characters."""
    clean = F.regexp_replace(F.regexp_replace(path, r"[^a-zA-Z0-9_]", "_"), r"_+", "_")
    return F.substring(F.regexp_replace(clean, r"^_|_\z", ""), 1, 128)


def with_unique_doc_id(df: DataFrame, path: str = "path", out: str = "doc_id") -> DataFrame:
    """Add ids unique per path.

    The smallest path of an id keeps it plain; the others get a hash suffix.
    Holders come from a map-side combined minimum, so a hot id (deep folders
    cut at 128 characters) never lands in one sort; ids without a second path
    are not joined back at all.
    """
    base = df.withColumn(out, doc_id(F.col(path)))
    holders = (
        base.groupBy(out)
        .agg(F.min(path).alias("_first"), F.max(path).alias("_last"))
        .filter("_first <> _last")
        .select(F.col(out), "_first")
    )
    tagged = F.concat_ws("_", F.substring(F.col(out), 1, 120), F.substring(F.sha1(F.col(path)), 1, 7))
    return (
        base.join(holders, out, "left")
        .withColumn(out, F.when(F.col(path) != F.col("_first"), tagged).otherwise(F.col(out)))
        .drop("_first")
    )


def doc_sha1(uri: Column) -> Column:
    return F.sha1(uri)


def display_type(doc_type: Column) -> Column:
    return F.initcap(F.replace(doc_type, F.lit("_"), F.lit(" ")))


def repair_title(title: Column, prop: Column, doc_type: Column) -> Column:
    """Readable title for names that are bare scan numbers."""
    return F.when(
        stem(title).rlike(rx(r"^\d{17,}")), F.concat(prop, F.lit(" — "), display_type(doc_type))
    ).otherwise(title)


def _title_case(word: Column) -> Column:
    apart = F.regexp_replace(F.lower(word), r"([.'])", "$1 ")
    return F.replace(F.initcap(apart), F.lit(" "), F.lit(""))


def extract_context(text: Column) -> Column:
    """Address mention (number and up to five words) or job id in free text."""
    word = r"[A-Za-z][a-zA-Z.']+"
    mention = rx(rf"\b(\d{{1,5}})\s+({word}(?:\s+{word}){{0,4}})\b")
    number, tail = F.regexp_extract(text, mention, 1), F.regexp_extract(text, mention, 2)
    parts = F.split(tail, rx(r"\s+"))
    stop = string_array(rules.CONTEXT_STOP_WORDS)
    kept = F.array_max(
        F.transform(parts, lambda w, i: F.when(F.array_contains(stop, F.lower(w)), 0).otherwise(i + 1))
    )
    address = F.when(
        (number != "") & (kept > 0),
        F.concat(number, F.lit(" "), F.array_join(F.transform(F.slice(parts, 1, kept), _title_case), " ")),
    )
    job = F.upper(F.regexp_extract(text, rx(r"\bJOB[-_]\d{4}[-_]\d{2,4}\b", True), 0))
    return F.coalesce(address, nonempty(job))


def name_pattern(name: Column) -> Column:
    """Name with its dates, years, numbers and hashes replaced by marks."""
    out = F.lower(name)
    for pattern, mark in rules.NAME_PATTERN_STEPS:
        out = F.regexp_replace(out, "(?U)" + pattern, mark)
    return out


def normalize_address(text: Column) -> Column:
    bare = F.regexp_replace(strip(F.lower(text)), rx(rules.STREET_PATTERN), "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def category_name(folder: Column) -> Column:
    return F.regexp_replace(folder, r"^\d{1,3}-", "")


def source_uri(content_uri: Column, link: Column, struct_uri: Column, derived_uri: Column) -> Column:
    """First non-empty of the four places a source address may sit."""
    return F.coalesce(*[nonempty(c) for c in (content_uri, link, struct_uri, derived_uri)], F.lit(""))


def snippet_text(snippets: Column, count: int = 3, chars: int = 600) -> Column:
    """An excerpt: the first ``count`` snippets without tags, joined and cut at ``chars`` characters."""
    plain = F.transform(F.slice(snippets, 1, count), lambda s: strip(F.regexp_replace(s, r"<[^>]+>", "")))
    return F.substring(F.array_join(F.filter(plain, lambda s: s != ""), " ... "), 1, chars)


def is_admin(name: Column, extra: Sequence[str] = ()) -> Column:
    return name.rlike(rx("|".join([rules.ADMIN_NAME, *extra]), True))


def is_claim(name: Column) -> Column:
    return name.rlike(rx(rules.CLAIM_NAME, True))


def is_list_query(query: Column) -> Column:
    return contains_any(F.lower(query), rules.LIST_PHRASES)
