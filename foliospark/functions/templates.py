"""Template placeholders and answer cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from .text import contains_any, first_hit, nonempty, rx, strip


def placeholders(text: Column) -> Column:
    """Distinct ``{{names}}`` in order of first appearance."""
    names = F.regexp_extract_all(text, F.lit(rx(r"\{\{(.+?)\}\}")), F.lit(1))
    return F.array_distinct(F.transform(names, strip))


def clean_answer(answer: Column, long_chars: int = 300, sentences_read: int = 3, short_chars: int = 50) -> Column:
    """Struct (text, valid): failures become a fixed phrase, answers above ``long_chars`` one sentence.

    That sentence is the first useful one among ``sentences_read``; below
    ``short_chars`` a closing full stop goes.
    """
    t = strip(answer)
    failed = contains_any(F.lower(t), rules.FAIL_PHRASES) | (t.contains("TEST") & (F.length(t) < 20))
    sentences = F.split(t, rx(r"(?<=[.!?])\s+"))
    useful = F.filter(
        F.transform(F.slice(sentences, 1, sentences_read), strip),
        lambda s: (F.length(s) > 10)
        & ~first_hit([(F.lower(s).startswith(p), F.lit(True)) for p in rules.PREAMBLE_STARTS], F.lit(False)),
    )
    one = F.coalesce(F.get(useful, F.lit(0)), F.get(sentences, F.lit(0)))
    out = F.when(F.length(t) > long_chars, one).otherwise(t)
    for pattern in rules.PREAMBLES:
        out = strip(F.regexp_replace(out, rx(pattern, True), ""))
    out = F.when((F.length(out) < short_chars) & out.endswith("."), strip(F.regexp_replace(out, r"\.\z", ""))).otherwise(out)
    valid = F.coalesce((t != "") & ~failed & (out != ""), F.lit(False))
    return F.struct(
        F.when(valid, out).otherwise(rules.NOT_AVAILABLE).alias("text"), valid.alias("valid")
    )


def placeholder_queries(names: DataFrame, query_map: DataFrame, name: str = "placeholder") -> DataFrame:
    """Question per placeholder: the mapped one, else the name with blanks."""
    return names.join(query_map, name, "left").withColumn(
        "query", F.coalesce(nonempty(F.col("query")), F.replace(F.col(name), F.lit("_"), F.lit(" ")))
    )


def fill_templates(templates: DataFrame, answers: DataFrame, key: str = "template_id",
                   text: str = "text", missing: str = rules.NOT_AVAILABLE) -> DataFrame:
    """Replace every placeholder by its template's answer, or by ``missing`` where it has none.

    Templates without placeholders skip the join. The answers of one template
    are as few as its placeholders, so folding them is a bounded group.
    """
    named = templates.withColumn("_names", placeholders(F.col(text)))
    pairs = (
        named.select(key, F.explode("_names").alias("placeholder"))
        .join(answers.select(key, "placeholder", "answer"), [key, "placeholder"])
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "answer"))).alias("_answers"))
    )
    pattern = rx(r"\{\{(.+?)\}\}")
    names = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), strip)
    answered = F.transform(names, lambda n: F.coalesce(F.try_element_at(F.col("_answers"), n), F.lit(missing)))
    # The text between the placeholders is one piece longer than the names.
    filled = F.zip_with(F.split(text, pattern, -1), answered, lambda p, a: F.concat(p, F.coalesce(a, F.lit(""))))
    return (
        named.join(pairs, key, "left")
        .withColumn("filled", F.array_join(filled, ""))
        .drop("_names", "_answers")
    )
