"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from foliospark import rules
from foliospark.functions import classify as C
from foliospark.functions import names as N
from foliospark.functions import templates as T
from foliospark.functions import values as V
from foliospark.functions.text import strip


@pytest.mark.parametrize("raw, want", [
    ("12-Alder-Ave.pdf", "12 alder ave"), ("a/b/Doe, Ann - Legal", "doe ann legal"),
    ("1. Gains & Costs (G&C'S) - Other", "1 gains costs g c s other"), ("", ""), ("x.", "x"), ("a.toolong", "a toolong"),
    ("dir/", "dir"), (".pdf", ""),
])
def test_normalize_name(one, raw, want):
    assert one(N.normalize_name, raw) == want


def test_normalize_title_keeps_other_marks(one):
    assert one(N.normalize_title, "x/ABC_Pipe-Invoice (2).pdf") == "abc pipe invoice (2)"


@pytest.mark.parametrize("name, want", [
    ("20240131120000000.pdf", "2024-01-31"), ("20240231.pdf", "2024-02-31"), ("20141231.pdf", ""),
    ("summary.pdf", "2023-03"), ("plain.pdf", ""), ("20241301-jun.pdf", "2023-06"),
])
def test_extract_date(one, name, want):
    assert one(lambda n: N.extract_date(n), name) == want


@pytest.mark.parametrize("text, want", [
    ("give me a summary on 27 alder drive please", "27 Alder Drive"), ("12 o'neil street docs", "12 O'Neil Street"),
    ("see job_2024-17", "JOB_2024-17"), ("7 summary please", None), ("nothing", None),
])
def test_extract_context(one, text, want):
    assert one(N.extract_context, text) == want


def test_strip_is_unicode(one):
    assert one(strip, "\u00a0 x\u2003\n") == "x"


@pytest.mark.parametrize("name, want", [
    ("x_encircle.pdf", "inspection_report"), ("a_estimate_b.pdf", "estimate"), ("estimated.pdf", "document"),
    ("110_FNMA 1004_1007_1.pdf", "appraisal"), ("21004x.pdf", "document"), ("P & L 2024.pdf", "pl_statement"),
    ("Q1_Numbers.XLSX", "spreadsheet"), ("20230614125527814.pdf", "scanned_document"), ("claim.pdf", "claim_documents"),
    ("reclaim.pdf", "document"), ("Pack_Out.pdf", "estimate"), ("ein letter.pdf", "tax_document"), ("mail.eml", "email"),
    ("Settlement Statement.pdf", "closing_statement"), ("DEED.pdf", "deed"), ("INVOİCE.pdf", "invoice"),
])
def test_type_from_name(one, name, want):
    assert one(C.doc_type_from_name, name) == want


PAD = "lorem " * 40


@pytest.mark.parametrize("text, kind, confidence, n", [
    (PAD + "Uniform Residential  Appraisal Report", "appraisal", "strong", 1),
    (PAD + "market value of the subject property", "appraisal", "weak", 2),
    (PAD + "market value only", None, None, 0),
    (PAD + "market value, subject property. Building Permit 12", "appraisal", "weak", 2),
    (PAD + "please hear. If we do not hear from you, legal action", "correspondence", "strong", 1),
    (PAD + "If we do not hear\nfrom you, legal action", None, None, 0),
    (PAD + "building\u00a0permit", "permit", "strong", 1),
    ("building permit", "permit", "strong", 1),
    (PAD + "O & P and depreciation", "estimate", "weak", 2),
])
def test_classify_text(one, text, kind, confidence, n):
    got = one(lambda t: C.classify_text(t), text)
    assert (got["doc_type"], got["confidence"], len(got["signals"])) == (kind, confidence, n)


def test_prefer_strong_beats_an_earlier_weak_match(one):
    text = PAD + "market value, subject property. Building Permit 12"
    assert one(lambda t: C.classify_text(t, prefer_strong=True), text)["doc_type"] == "permit"


def test_length_guard_is_exact(one):
    body = "building permit"
    assert one(lambda t: C.classify_text(t), body + "x" * (199 - len(body)))["doc_type"] is None
    assert one(lambda t: C.classify_text(t), body + " " + "x" * (199 - len(body)))["doc_type"] == "permit"


def test_literal_prefilter_never_hides_a_match(spark):
    """Each rule is found in a text made from its own letters, with and without the shortcut."""
    samples = ["actual cash value", "RCV total", "desk adjuster", "drying log", "x deed of trust", "net 30", "Comparables two",
               "appraiser's certification", "successors and assigns", "ACV", "with observations", "perils insured against"]
    patterns = [p for _, strong, weak in rules.CONTENT_RULES for p in strong + weak] + [p for p, _ in rules.NAME_TYPE_RULES]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    fast = [C.found(F.col("t"), C.fold_case(F.col("t")), p).alias(f"f{i}") for i, p in enumerate(patterns)]
    full = [F.col("t").rlike("(?iUd)" + p).alias(f"r{i}") for i, p in enumerate(patterns)]
    for row in df.select("t", *fast, *full).collect():
        for i, p in enumerate(patterns):
            assert row[f"f{i}"] == row[f"r{i}"], (row["t"], p)


@pytest.mark.parametrize("path, want", [
    ("mirror/Properties/12-Alder/04-Permits/sub/permit.pdf", ("12-Alder", "Permits", "permit", "sub", "permit.pdf")),
    ("mirror/Properties/12-Alder/99-Misc/a.pdf", None), ("mirror/flat_invoice.pdf", None),
    ("/mirror/Properties/12-Alder/04-Permits/a.pdf", None),
])
def test_strict_tags(one, path, want):
    got = one(lambda p: C.classify_strict(p, {"04-Permits": "permit"}), path)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("field, value, want", [
    ("appraised_value", "N/A", True), ("appraised_value", None, False), ("property_address", "Docusketch, HI 11111", True),
    ("property_address", "15 Alder Lane, Elmtown, NY 11743", False), ("claim_number", "1930", True), ("estimate_total", "1930", False),
    ("claim_number", " - ", True), ("property_address", "x" * 81, True),
])
def test_placeholder(one, field, value, want):
    assert one(lambda f, v: C.is_placeholder(f, v.cast("string")), field, value) is want


@pytest.mark.parametrize("raw, want", [
    ("2026-01-05T10:00:00Z", "2026-01-05 10:00:00"), ("2026-01-05T10:00:00.123Z", "2026-01-05 10:00:00.123"),
    ("2026-01-05T10:00:00+02:00", "2026-01-05 08:00:00"), ("2026-01-05T10:00:00+0200", "2026-01-05 08:00:00"),
    ("2026-01-05 10:00", "2026-01-05 10:00:00"), ("2026-01-05", "2026-01-05 00:00:00"), ("soon", None), ("", None),
    ("10:00:00", None), ("2026-13-05T10:00:00Z", None),
])
def test_parse_ts(one, raw, want):
    got = one(lambda t: V.parse_ts(t).cast("string"), raw)
    assert got == want


@pytest.mark.parametrize("answer, want", [
    ("The answer is: 12 Elm St.", ("12 Elm St", True)), ("It does not contain that", ("Not Available", False)), ("TEST 5", ("Not Available", False)),
    (None, ("Not Available", False)), ("Based on the documents, $5.", ("$5", True)),
    ("According to us. " + "The real one is forty two. " + "x" * 300, ("The real one is forty two", True)),
])
def test_clean_answer(one, answer, want):
    assert tuple(one(lambda a: T.clean_answer(a.cast("string")), answer)) == want


@pytest.mark.parametrize("n, direct, want", [(0, True, "none"), (1, True, "low"), (2, True, "medium"), (5, False, "medium"), (5, True, "high")])
def test_confidence(one, n, direct, want):
    assert one(C.excerpt_confidence, n, direct) == want
