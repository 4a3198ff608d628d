"""Rule-driven classifiers over columns. Rule tables come in as arguments."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .names import base_name, category_name, is_admin, is_claim, is_list_query, stem
from .text import any_of, bind, contains_any, ends_with_any, first_hit, lookup, nonempty, rx, string_array, strip

TAG_FIELDS = ("property", "category", "doc_type", "subpath", "filename")


def _tags(*values: Column) -> Column:
    return F.struct(*[v.alias(n) for v, n in zip(values, TAG_FIELDS)])


def classify_strict(
    path: Column, categories: dict[str, str], prefix: str = "mirror", properties_folder: str = "Properties"
) -> Column:
    """Tags from ``<prefix>/<properties>/<property>/<category>/...``; NULL off that layout."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    size = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    doc_type = lookup(categories, F.coalesce(at(3), F.lit("")))
    fits = (
        ~path.startswith("/") & (size >= 5) & (at(0) == prefix) & (at(1) == properties_folder)
        & doc_type.isNotNull()
    )
    subpath = F.array_join(F.slice(parts, 5, F.greatest(size - 5, F.lit(0))), "/")
    return F.when(
        fits, _tags(at(2), category_name(at(3)), doc_type, subpath, F.try_element_at(parts, F.lit(-1)))
    )


def classify_heuristic(path: Column, rule_list: Sequence[dict], default_property: str | None = None) -> Column:
    """Tags of the first rule whose pattern is found in the file name.

    Rules are ``{"pattern", "doc_type", "property"}``; the last is optional.
    """
    name = base_name(path)
    hits = [(name.rlike(rx(r["pattern"], True)), r) for r in rule_list if r.get("pattern")]
    doc_type = first_hit([(h, F.lit(r.get("doc_type"))) for h, r in hits])
    prop = first_hit([(h, F.lit(r.get("property") or default_property)) for h, r in hits])
    return F.when(
        doc_type.isNotNull() & prop.isNotNull(), _tags(prop, F.initcap(doc_type), doc_type, F.lit(""), name)
    )


def classify_path(path: Column, categories: dict[str, str], rule_list: Sequence[dict],
                  default_property: str | None = None, prefix: str = "mirror",
                  properties_folder: str = "Properties") -> Column:
    """Strict tags, else heuristic ones."""
    return F.coalesce(
        classify_strict(path, categories, prefix, properties_folder),
        classify_heuristic(path, rule_list, default_property),
    )


# Characters that equal an ASCII letter when case is ignored.
_FOLD = ("ſıİK", "siik")
_RUN = re.compile(r"[a-z]+(?![a-z?*{])|[a-z]+(?=[a-z][?*{])", re.IGNORECASE)
_PLAIN = re.compile(r"[a-z0-9_ ]+", re.IGNORECASE)


def fold_case(text: Column) -> Column:
    return F.lower(F.translate(text, *_FOLD))


def alternatives(pattern: str) -> list[str]:
    """Parts of a pattern between its outermost bars."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def required_literal(pattern: str) -> str | None:
    """Longest run of letters that every match must contain; NULL below three letters.

    Only letters outside groups and classes count, and none that may be absent.
    """
    flat = re.sub(r"\\[a-zA-Z]", " ", pattern)
    flat = re.sub(r"\\.", " ", flat)
    flat = re.sub(r"\[[^\]]*\][*+?]?", " ", flat)
    while re.search(r"\([^()]*\)", flat):
        flat = re.sub(r"\([^()]*\)[?*+]?", " ", flat)
    runs = sorted(_RUN.findall(flat), key=len)
    return runs[-1].lower() if runs and len(runs[-1]) >= 3 else None


def found(text: Column, folded: Column, pattern: str) -> Column:
    """Whether the pattern occurs, case ignored.

    Substring tests on the folded text are far cheaper than expressions: plain
    words need nothing else, other patterns run only where their letters occur.
    """
    parts = alternatives(pattern)
    if all(_PLAIN.fullmatch(p) for p in parts):
        return contains_any(folded, [p.lower() for p in parts])
    literals = [required_literal(p) for p in parts]
    hit = text.rlike(rx(pattern, True))
    return contains_any(folded, sorted(set(literals))) & hit if all(literals) else hit


def doc_type_from_name(name: Column, rule_list=rules.NAME_TYPE_RULES, ext_rules=rules.NAME_TYPE_EXTS,
                       default: str = rules.DEFAULT_TYPE) -> Column:
    """Document type from a file name: ordered patterns on the stem, then suffixes."""
    low_stem = F.lower(stem(name))
    value = F.struct(low_stem.alias("s"), fold_case(stem(name)).alias("f"), F.lower(name).alias("n"))

    def body(v: Column) -> Column:
        cases = [(found(v["s"], v["f"], p), F.lit(t)) for p, t in rule_list]
        cases += [(v["n"].endswith(e), F.lit(t)) for e, t in ext_rules]
        return first_hit(cases, F.lit(default))

    return F.when(name.isNotNull(), bind(value, body))


def classify_text(text: Column, content_rules=rules.CONTENT_RULES, min_chars: int = 0,
                  weak_hits: int = rules.CONTENT_WEAK_HITS, prefer_strong: bool = False) -> Column:
    """Struct (doc_type, confidence, signals, source) of the body text.

    Types are tried in order; a type matches on its first strong pattern or on
    ``weak_hits`` distinct weak ones, so an earlier type's weak match beats a
    later type's strong one unless ``prefer_strong``. A caller who trusts only
    longer texts passes ``min_chars``, below which no type is given.
    """

    def verdict(doc_type, confidence, signals):
        return F.struct(
            F.lit(doc_type).alias("doc_type"), F.lit(confidence).alias("confidence"),
            signals.alias("signals"), F.lit("content").alias("source"),
        )

    nothing = F.expr(
        "named_struct('doc_type', cast(null as string), 'confidence', cast(null as string), "
        "'signals', cast(array() as array<string>), 'source', cast(null as string))"
    )

    def body(v: Column) -> Column:
        strong_cases, weak_cases, cases = [], [], []
        for doc_type, strong, weak in content_rules:
            first = [
                (found(v["t"], v["f"], p), verdict(doc_type, "strong", F.array(F.lit(f"strong:{p}")))) for p in strong
            ]
            tags = [F.when(found(v["t"], v["f"], p), F.lit(f"weak:{p}")) for p in weak]
            signals = F.array_compact(F.array(*tags)) if tags else string_array([])
            second = [(F.size(signals) >= weak_hits, verdict(doc_type, "weak", signals))]
            strong_cases += first
            weak_cases += second
            cases += first + second
        return first_hit(strong_cases + weak_cases if prefer_strong else cases, nothing)

    long = F.length(text) >= min_chars
    return F.when(long, bind(F.struct(text.alias("t"), fold_case(text).alias("f")), body)).otherwise(nothing)


def resolve_doc_type(name: Column, size_bytes: Column, content_type: Column, pointer_bytes: int | None = None) -> Column:
    """Stored type: content evidence, else the name.

    With ``pointer_bytes``, PDFs above that size are pointers, whatever they say.
    """
    typed = F.coalesce(content_type, doc_type_from_name(name))
    if pointer_bytes is None:
        return typed
    return F.when(F.lower(name).endswith(".pdf") & (size_bytes > pointer_bytes), F.lit(rules.LARGE_PDF_TYPE)).otherwise(typed)


def doc_type_or_name(stored: Column, name: Column) -> Column:
    """Stored type where there is one, else the file-name type."""
    return F.coalesce(nonempty(stored), doc_type_from_name(name))


def needs_ocr(path: Column, size_bytes: Column, scan_bytes: int = rules.SCAN_MIN_BYTES) -> Column:
    """Whether a file looks like a scan: a scanner's name, or a name of digits alone and more than ``scan_bytes``."""
    s = stem(F.substring_index(path, "/", -1))
    return s.rlike(rx(rules.SCAN_NAME, True)) | (
        (F.coalesce(size_bytes, F.lit(0)) > scan_bytes) & s.rlike(rx(r"^\d+$"))
    )


def extraction_tier(chars: Column, ocr: Column, cached: Column) -> Column:
    return (
        F.when(chars > 0, "tier1_extracted")
        .when(ocr & cached, "tier2_ocr_cached")
        .when(ocr, "tier2_ocr_live")
        .otherwise("tier3_passthrough")
    )


def chars_per_mb(chars: Column, size_bytes: Column) -> Column:
    mb = F.greatest(F.coalesce(size_bytes, F.lit(0)) / F.lit(1_000_000.0), F.lit(0.01))
    return F.floor(chars / mb)


def extraction_flag(chars: Column, size_bytes: Column, ocr: Column, tier: Column) -> Column:
    return (
        F.when((chars > 0) & (chars_per_mb(chars, size_bytes) < rules.THIN_CHARS_PER_MB), "thin_text_layer_accepted")
        .when(ocr & (chars > 0), "scan_pattern_but_tier1_succeeded")
        .when(tier == "tier2_ocr_live", "ocr_pending_first_run")
        .when(tier == "tier3_passthrough", "passthrough_check_filename")
        .otherwise("")
    )


def bucket_of(doc_type: Column, name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.coalesce(
        lookup(rules.TYPE_BUCKETS, F.lower(strip(F.coalesce(doc_type, F.lit(""))))),
        F.when(ends_with_any(low, rules.SHEET_EXTS), "spreadsheet")
        .when(ends_with_any(low, rules.IMAGE_EXTS), "photos")
        .otherwise("other"),
    )


def guess(name: Column, path: Column, guess_rules=rules.GUESS_RULES, ext_rules=rules.GUESS_EXT_RULES) -> Column:
    """Struct (bucket, doc_type, basis) for a file without a useful type."""

    def out(bucket, doc_type, basis):
        return F.struct(
            F.lit(bucket).alias("bucket"), F.lit(doc_type).alias("doc_type"), F.lit(basis).alias("basis")
        )

    none = F.expr(
        "named_struct('bucket', cast(null as string), 'doc_type', cast(null as string), 'basis', 'no_signal')"
    )

    def body(v: Column) -> Column:
        cases = [(v["h"].rlike(rx(p)), out(b, t, "filename_match")) for b, t, p in guess_rules]
        cases += [(v["n"].rlike(rx(p)), out(b, t, "extension")) for p, b, t in ext_rules]
        return first_hit(cases, none)

    return bind(F.struct(F.lower(F.concat_ws(" ", name, path)).alias("h"), F.lower(name).alias("n")), body)


def query_intent(query: Column, intent_rules=rules.QUERY_INTENT_RULES) -> Column:
    return bind(F.lower(query), lambda low: first_hit([(low.rlike(rx(p)), F.lit(t)) for p, t in intent_rules]))


def query_mode(query: Column) -> Column:
    low = F.lower(query)
    return (
        F.when(is_list_query(query), "list")
        .when(contains_any(low, rules.FACT_PHRASES), "fact")
        .otherwise("synthesis")
    )


def is_summary_query(query: Column) -> Column:
    return query.rlike(rx(any_of(rules.SUMMARY_PATTERNS), True))


def asks_open_items(query: Column) -> Column:
    return query.rlike(rx(any_of(rules.OPEN_ITEMS_PATTERNS), True))


def should_render_open_items(purpose: Column, query: Column) -> Column:
    return F.coalesce(asks_open_items(query), F.lit(False)) | (purpose == rules.CLAIM)


def purpose_from(buckets: Column, has_marker: Column, folder_name: Column, admin_extra: Sequence[str] = ()) -> Column:
    """Folder purpose from its present buckets, marker files and name."""
    name = F.coalesce(folder_name, F.lit(""))
    overlaps = lambda wanted: F.arrays_overlap(buckets, string_array(wanted))
    claim_name = is_claim(name)
    return (
        F.when(is_admin(name, admin_extra), rules.UNKNOWN)
        .when(overlaps(rules.CLAIM_BUCKETS), rules.CLAIM)
        .when(claim_name & (overlaps(rules.CLAIM_SUPPORT_BUCKETS) | has_marker), rules.CLAIM)
        .when(overlaps(rules.PROPERTY_BUCKETS) & ~claim_name, rules.PROPERTY)
        .otherwise(rules.UNKNOWN)
    )


def predicted_purpose_from(buckets: Column) -> Column:
    """The simpler rule: buckets only."""
    overlaps = lambda wanted: F.arrays_overlap(buckets, string_array(wanted))
    return (
        F.when(overlaps(rules.CLAIM_BUCKETS), rules.CLAIM)
        .when(overlaps(rules.PROPERTY_BUCKETS), rules.PROPERTY)
        .otherwise(rules.UNKNOWN)
    )


def evidence_grade(purpose: Column, folder_name: Column, key_facts: Column, items: Column, overview: Column) -> Column:
    """Grade of an event's evidence; ``items`` is the flat inventory array."""
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    names = F.flatten(F.transform(key_facts, lambda k: F.coalesce(k["sources"], string_array([]))))
    sources = F.array_distinct(F.filter(F.transform(names, strip), lambda s: s != ""))
    value = F.struct(
        F.coalesce(purpose, F.lit(rules.UNKNOWN)).alias("purpose"), F.coalesce(folder_name, F.lit("")).alias("name"),
        F.lower(F.coalesce(overview, F.lit(""))).alias("overview"), count(key_facts).alias("facts"),
        count(items).alias("total"), count(F.filter(items, lambda i: i["is_marker"])).alias("markers"),
        sources.alias("sources"), count(sources).alias("n_sources"),
        count(F.filter(sources, lambda s: ends_with_any(F.lower(s), rules.TEMPLATE_EXTS))).alias("forms"),
    )

    def body(v: Column) -> Column:
        empty = contains_any(v["overview"], rules.EMPTY_OVERVIEW_PHRASES)
        unknown = v["purpose"] == rules.UNKNOWN
        template = v["name"].rlike(rx(rules.TEMPLATE_NAME, True)) | (
            (v["forms"] * 2 >= v["n_sources"]) & (v["n_sources"] >= 3)
        )
        total, markers, facts = v["total"], v["markers"], v["facts"]
        return (
            F.when((total >= 5) & ((facts <= 1) | empty), "low-evidence")
            .when((total <= 3) | (markers == total) | ((total <= 4) & (total - markers <= 2)), "skeleton")
            .when(unknown & template, "template/admin")
            .when(unknown & (facts >= 2), "mixed/admin")
            .when(v["purpose"].isin(rules.CLAIM, rules.PROPERTY) & (facts >= 3) & (v["n_sources"] >= 1) & ~empty, "healthy")
            .otherwise("partial")
        )

    return bind(value, body)


def tag_warnings(tags: Column) -> Column:
    """Warnings of a tag struct: absent required tags and types off the list."""
    missing = [F.when(tags[t].isNull(), F.lit(f"missing required tag: {t}")) for t in rules.REQUIRED_TAGS]
    odd = F.when(
        tags["doc_type"].isNotNull() & ~tags["doc_type"].isin(*rules.VALID_TAG_TYPES),
        F.concat(F.lit("unknown doc_type: "), tags["doc_type"]),
    )
    return F.array_compact(F.array(*missing, odd))


def count_confidence(n: Column) -> Column:
    return F.when(n == 0, "none").when(n >= 5, "high").when(n >= 2, "medium").otherwise("low")


def excerpt_confidence(n: Column, direct: Column) -> Column:
    return F.when(n == 0, "none").when((n >= 5) & direct, "high").when(n >= 2, "medium").otherwise("low")


def is_placeholder(field: Column, value: Column, general=rules.PLACEHOLDERS,
                   by_field=rules.FIELD_PLACEHOLDERS) -> Column:
    """Whether a value is template filler for its field; NULL values are not."""
    text = strip(value)
    hit = text.rlike(rx(any_of(general), True))
    for name, patterns in by_field.items():
        hit = hit | ((field == name) & text.rlike(rx(any_of(patterns), True)))
    return F.coalesce(hit, F.lit(False))


def meta_filter(**wanted: str | None) -> Column:
    """AND of equalities; an absent or empty value does not filter."""
    cond = F.lit(True)
    for column, value in wanted.items():
        if value:
            cond = cond & (F.col(column) == value)
    return cond


def audit_filter(doc_type: Column, path: Column, tags: Sequence[str] = rules.AUDIT_TAGS,
                 folder: str | None = None) -> Column:
    """Files whose tag is in the audited set; ``(empty)`` stands for no tag."""
    wanted = [t.strip().lower() for t in tags if t.strip()]
    tag = F.coalesce(doc_type, F.lit(""))
    cond = F.when(tag == "", F.lit("(empty)" in wanted)).otherwise(F.lower(tag).isin(*wanted))
    return cond & F.lower(path).contains(folder.lower()) if folder else cond
