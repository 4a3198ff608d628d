"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets, by keyed Feistel permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._registry import query, table

ROUNDS = 8
#: Default key for tests and the registered query; a deployment passes its own.
KEY = "change-me"
#: Days from 1900-01-01 to 2099-12-31 as a product of two numbers.
DAY0, SPANS, DAYS = "1900-01-01", 17, 4297

#: Up to 64 characters before the @; labels are counted, since the engine goes one call deeper for each repeat of
#: a group of varying length.
_EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,63}\.){1,30}\p{L}{2,}"
_IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_PHONE = r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|\+\d{10,15}"
_AWS = r"AKIA[A-Z0-9]{16}"
_NAMED = (
    r"(?i:passwords?|passwd|passphrase|pwd|secrets?|tokens?|(?:api|access|auth|private|secret)[_\- ]?key|secret[_\-]access[_\-]key)"
    r"[\"']?(?:\s{0,3}[=:]\s{0,3}|\s{1,3}is:?\s{1,3}(?=\S*\d))[\"']?"
)
#: The token behind a name, in any alphabet; a value of another kind there is treated as such.
_SECRET = (
    rf"{_NAMED}(?!(?:{_EMAIL}|{_IPV4}|{_DATE}|{_SSN}|{_PHONE})(?:[\s\"',;)]|\.?(?:\s|$)))"
    r"[A-Za-z0-9+/_.~\-=!#$%&*^@:?]{7,}[A-Za-z0-9+/=]"
)
_AMEX = r"\d{4}[ \-]\d{6}[ \-]\d{5}"
#: Groups end where a value of another kind begins.
_APART = rf"(?![ \-](?:{_EMAIL}|{_SECRET}|{_IPV4}|{_DATE}|{_SSN}|{_PHONE}|{_AMEX})(?![A-Za-z0-9]))"
#: Runs of groups of four may hold several numbers; :func:`_grouped` tells them apart.
_CARD = rf"\d{{13,19}}|{_AMEX}(?:-\d{{1,4}})?|\d{{4}}(?:{_APART}[ \-]\d{{4}}){{2,}}(?:{_APART}[ \-]\d{{1,4}})?"
_IBAN = rf"[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{11,30}}|(?:{_APART} [A-Z0-9]{{4}}){{2,}}(?:{_APART} [A-Z0-9]{{1,3}})?)"
#: One match is a value of one kind, set off from what may belong to it: dates and addresses from any sign that
#: numbers go on behind, numbers only from letters, digits and digits behind such a sign.
PATTERN = (
    rf"(?<![\p{{L}}\p{{N}}._%+\-]){_EMAIL}|(?<![A-Za-z0-9])(?:{_SECRET}|{_AWS}|{_IBAN})(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9.+\-/])(?:{_IPV4}|{_DATE})(?![A-Za-z0-9]|[.\-/]\d)"
    rf"|(?<![A-Za-z0-9+])(?<!\d[.\-/])(?:{_SSN}|{_PHONE})(?![A-Za-z0-9]|[.\-/]\d)"
    rf"|(?<![A-Za-z0-9+])(?<!\d[.\-/])(?:{_CARD})(?![A-Za-z0-9]|\.\d)"
)
#: What any value needs; most texts have none of these and are passed over quickly.
HINT = rf"[0-9@]|AKIA|{_NAMED}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """A keyed number below 2**60."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permute_pair(key: str, kind: str, left: Column, a, right: Column, b) -> Column:
    """A keyed permutation of pairs ``(left < a, right < b)``: rounds add a hash of one part to the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, F.pmod(acc["l"] + F.pmod(_hash(key, kind, i, acc["r"]), a), a)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + F.pmod(_hash(key, kind, i, acc["l"]), b), b)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of one length (2 to 34 digits)."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    part = lambda at, size: F.substr(digits, at, size).cast("long")
    pair = permute_pair(key, kind, part(F.lit(1), h), ten(h), part(h + 1, n - h), ten(n - h))
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), h, F.lit("0")), F.lpad(p["r"].cast("string"), n - h, F.lit("0"))))


_DIGIT, _UPPER, _LOWER, _HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def permute_chars(key: str, kind: str, text: Column, alphabets: tuple[str, ...] = (_DIGIT, _UPPER, _LOWER)) -> Column:
    """A keyed permutation of the strings of one shape: each character stays in its alphabet, others stay as they are."""

    def moved(half: Column, other: Column, i: Column) -> Column:
        def by(digest: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                out = c
                for letters in alphabets:
                    spot = F.position(c, F.lit(letters))
                    turned = F.pmod(spot - 1 + F.pmod(_hash(key, kind, i, at, digest), F.lit(len(letters))), F.lit(len(letters)))
                    out = F.when((c != "") & (spot > 0), F.substr(F.lit(letters), turned.cast("int") + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(half, ""), one), "")

        # The other half is hashed once, however many characters it moves.
        return _let(F.sha2(other, 256), by)

    def step(acc: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(
            F.when(even, moved(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(moved(acc["r"], acc["l"], i)).alias("r"),
        )

    h = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), h).alias("l"), F.substr(text, h + 1, F.length(text)).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda p: F.concat(p["l"], p["r"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fill(shape: Column, chars: Column, places: str = "[0-9]") -> Column:
    """``shape`` with its digits, or other characters of ``places``, replaced by ``chars`` in order."""
    count = lambda x: F.length(F.regexp_replace(x, places.replace("[", "[^"), ""))
    return F.array_join(
        F.transform(
            F.split(shape, ""),
            lambda c, i: F.when(c.rlike(places), F.substr(chars, count(F.substr(shape, F.lit(1), i + 1)), F.lit(1))).otherwise(c),
        ), "",
    )


def luhn_check(body: Column) -> Column:
    """The check digit that belongs behind a string of digits."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(body, F.length(body) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add) % 10, F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """Remainder of an account number whose letters stand for 10 to 35."""
    def add(acc: Column, c: Column) -> Column:
        v = F.position(c, F.lit(_DIGIT + _UPPER)) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _is_card(d: Column) -> Column:
    """Whether digits are a card number."""
    right = luhn_check(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1))
    return F.when(F.length(d).between(13, 19), right).otherwise(False)


def _card(key: str, m: Column) -> Column:
    def new(d: Column) -> Column:
        middle = permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2))
        return _let(F.concat(F.substr(d, F.lit(1), F.lit(1)), middle), lambda b: F.concat(b, luhn_check(b)))

    return _let(_digits(m), lambda d: _let(new(d), lambda n: _fill(m, n)))


def _phone(key: str, m: Column) -> Column:
    def kept(d: Column) -> Column:
        lead = F.length(d) - 10
        new = F.concat(F.substr(d, F.lit(1), lead), permute_digits(key, "phone", F.substr(d, lead + 1, F.lit(10))))
        return _let(new, lambda n: _fill(m, n))

    return _let(_digits(m), kept)


def _ipv4(key: str, m: Column) -> Column:
    def valid(o: Column) -> Column:
        pair = permute_pair(key, "ipv4", o[0] * 256 + o[1], 65536, o[2] * 256 + o[3], 65536)
        new = _let(
            pair, lambda p: F.concat_ws(
                ".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256).cast("long"), p[h] % 256)]
            ),
        )
        return F.when(F.forall(o, lambda x: x <= 255), new).otherwise(m)

    return _let(F.transform(F.split(m, "[.]"), lambda x: x.cast("long")), valid)


def _ssn(key: str, m: Column) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999: valid numbers stay valid."""
    area, group, serial = (F.split(m, "-")[i].cast("long") for i in range(3))
    rank = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = permute_pair(key, "ssn", rank, 898, (group - 1) * 9999 + serial - 1, 99 * 9999)

    def written(p: Column) -> Column:
        a = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
        parts = (a, 3), (F.floor(p["r"] / 9999) + 1, 2), (p["r"] % 9999 + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("long").cast("string"), n, F.lit("0")) for x, n in parts])

    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(good, _let(pair, written)).otherwise(m)


def _date(key: str, m: Column) -> Column:
    """Days from 1900 to 2099; slashes are day first, month first where only that is a date."""
    first = F.to_date(F.lit(DAY0))

    def moved(shape: str, otherwise: Column) -> Column:
        def new(n: Column) -> Column:
            pair = permute_pair(key, "date", F.floor(n / DAYS), SPANS, n % DAYS, DAYS)
            day = _let(pair, lambda p: F.date_format(F.date_add(first, (p["l"] * DAYS + p["r"]).cast("int")), shape))
            return F.when(n.between(0, SPANS * DAYS - 1), day).otherwise(otherwise)

        return _let(F.datediff(F.try_to_timestamp(m, F.lit(shape)).cast("date"), first), new)

    return F.when(m.contains("-"), moved("yyyy-MM-dd", m)).otherwise(moved("dd/MM/yyyy", moved("MM/dd/yyyy", m)))


def _is_iban(c: Column) -> Column:
    """Whether letters and digits are a bank account."""
    right = mod97(F.concat(F.substr(c, F.lit(5), F.length(c)), F.substring(c, 1, 4))) == 1
    return F.when(F.length(c).between(15, 34) & c.rlike("^[A-Z]{2}[0-9]{2}"), right).otherwise(False)


def _iban(key: str, m: Column) -> Column:
    def new(c: Column) -> Column:
        country = F.substring(c, 1, 2)
        return _let(
            permute_chars(key, "iban", F.substr(c, F.lit(5), F.length(c)), (_DIGIT, _UPPER)),
            lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, F.lit("0")), b),
        )

    return _let(_plain(m), lambda c: _let(new(c), lambda n: _fill(m, n, "[A-Z0-9]")))


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[ \\-]", "")


def _grouped(key: str, m: Column) -> Column:
    """Card numbers and bank accounts in a run of groups: from the left, at each group the longest that validates."""

    def joined(parts: Column, i: Column, n: Column) -> Column:
        return F.array_join(F.slice(parts, i + 1, n), "")

    def replaced(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            def good(n: Column) -> Column:
                return (i + n <= F.size(parts)) & _let(_plain(joined(parts, i, n)), lambda c: (
                    F.when(c.rlike("^[0-9]+$"), _is_card(c)).otherwise(_is_iban(c))))

            def put(n: Column) -> Column:
                text = joined(parts, i, F.coalesce(n, F.lit(1)))
                new = F.when(n.isNull(), text).when(text.rlike("^[0-9]"), _card(key, text)).otherwise(_iban(key, text))
                return F.struct(F.concat(acc["out"], new).alias("out"), (F.coalesce(n, F.lit(1)) - 1).alias("skip"))

            # An account has up to nine groups of four.
            longest = F.get(F.filter(F.sequence(F.lit(9), F.lit(1), F.lit(-1)), good), F.lit(0))
            return F.when(acc["skip"] > 0, F.struct(acc["out"].alias("out"), (acc["skip"] - 1).alias("skip"))).otherwise(
                _let(longest, put)
            )

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("skip"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts) - 1), start, step)["out"]

    return _let(F.regexp_extract_all(m, F.lit("[A-Z0-9]+[ \\-]?"), F.lit(0)), replaced)


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match of :data:`PATTERN`; values that do not validate stay as they are."""
    is_a = lambda pattern: m.rlike(f"^(?:{pattern})$")
    head = rf"^({_NAMED})(.+)$"
    value = F.regexp_extract(m, head, 2)
    return (
        F.when(is_a(_SECRET), F.concat(F.regexp_extract(m, head, 1), F.when(
            value.rlike("^[0-9a-f]+$"), permute_chars(key, "secret", value, (_HEX,))).otherwise(permute_chars(key, "secret", value))))
        .when(m.contains("@"), F.concat(
            permute_chars(key, "email", F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(is_a(_AWS), F.concat(F.lit("AKIA"), permute_chars(key, "aws", F.substr(m, F.lit(5), F.length(m)), (_DIGIT, _UPPER))))
        .when(is_a(_IPV4), _ipv4(key, m)).when(is_a(_DATE), _date(key, m)).when(is_a(_SSN), _ssn(key, m))
        .when(is_a(_PHONE), _phone(key, m)).when(is_a(f"{_CARD}|{_IBAN}"), _grouped(key, m)).otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text") -> DataFrame:
    """``docs`` with the personal values in ``column`` replaced; other columns and rows stay.

    Mail addresses (the part before the @), card numbers with a valid check
    digit, bank accounts (mod 97), both also in groups, valid social security numbers, IPv4
    addresses, phone numbers, dates from 1900 to 2099, access keys and secrets
    of eight and more characters behind their names become values of the same format. Each kind is permuted
    by a Feistel network under the key: equal values get equal pseudonyms in
    all documents, different ones of a format different ones, and check digits
    are valid again. Numbers that do not validate stay. Null and empty texts
    stay; repeated rows change alike. Only built-in expressions run, over
    whole texts; texts without a match pass through unchanged.
    """
    text = F.col(column)
    found = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: pseudonym(key, m))
    between = F.split(text, PATTERN, -1)
    filled = F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.withColumn(column, F.when(text.rlike(HINT) & text.rlike(PATTERN), filled).otherwise(text))


@query("op7_pseudonyms")
def op7_pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
