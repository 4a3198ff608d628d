"""Small text building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that counts as white space at the ends of a string.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str, ignore_case: bool = False) -> str:
    """Flags under which Java reads a Unicode pattern the way the rules were written."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def strip_long(column: str) -> Column:
    """``strip`` of a column of long strings, touched only where an end needs it."""
    c, space = F.col(column), F.lit(WHITE_SPACE)
    return F.when(space.contains(F.left(c, F.lit(1))) | space.contains(F.right(c, F.lit(1))), strip(c)).otherwise(c)


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    # Most values begin with a visible ASCII character, which needs no search.
    return F.when(F.ascii(c).between(33, 126) | c.rlike(r"(?U)\S"), c)


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def words(c: Column) -> Column:
    """Words of a normalised (single-blank) string; an empty string has none."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | c.endswith(s)
    return hit


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | c.contains(p)
    return hit


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a small literal table, NULL where the key is absent."""
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A long rule chain written straight into a projection repeats its input in
    every branch and makes generated methods too large to be compiled; as the
    body of a lambda it reads a bound value and stays out of generated code.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    Later filters and projections refer to the results; without this step the
    optimizer may copy an expensive expression, such as parsing a line, into
    each of them.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def explode_once(df: DataFrame, array: Column, *names: str) -> DataFrame:
    """Rows of an array or map that is computed once per input row.

    A plain ``explode`` also filters empty arrays, and that filter would compute
    an expensive array a second time.
    """
    return computed(df, _list=array).select(*df.columns, F.explode("_list").alias(*names))


def first_hit(cases: Sequence[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Value of the first true condition, in order."""
    out = None
    for cond, value in cases:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        return default if default is not None else F.lit(None)
    return out.otherwise(default) if default is not None else out
