r"""Format-preserving pseudonyms for personal data. DataFrame and SQL functions only.

Numbers and dates that validate, addresses and secrets are found by one pattern and permuted within
their format by a keyed Feistel network, so equal values stay equal across documents and nothing
else of the text changes. A value is an array of digits, each with a radix of its own; the two
halves take turns in being shifted by a keyed hash of the other, which is a permutation for any radixes:

    card     13-19 digits, Luhn valid: digits after the first permuted, check digit made anew
             a run that fails is searched for valid cards beside other numbers, from group to group
    phone    +country and 10 digits, or a 10-digit number in groups: digits after the country code; where the groups
             have only blanks between them, if area and exchange begin with 2 to 9 and no number goes before
    ssn      three, two and four digits with hyphens that can be one (no area 000, 666 or 9xx, no group 00, no serial 0000)
    ip       four octets up to 255, radix 256 each
    email    letters and digits of the local part, each within its own kind
    date     ISO or day-first dates that exist, or with slashes month-first ones, 1800 to 2199: the day within those 400 years
    key      AKIA... and hexadecimal secrets of 32 and more digits, within their alphabet and case; where both
             cases are mixed, each character within its own kind. Long ones in even pieces of up to 128 digits.
             One character more than 128 times in a row is no secret.

Numbers that don't validate and impossible dates stay as they are. Null text stays null, empty text
empty. Rows are independent: equal rows give equal rows and an empty table an empty one. `clean_text` carries all columns
along, whatever their names; `pseudonymise` adds the counts, and replaces columns that have their names.
"""

from __future__ import annotations

import datetime
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the key is looked for; without it the queries take one that is public, so their pseudonyms hide nothing.
SETTING, PUBLIC_KEY = "spark.tessella.pii.key", "a key that every deployment sets for itself"
ROUNDS = 6
KINDS = ("card", "phone", "ssn", "ip", "email", "date", "key")

#: The shapes that are looked for. Every one starts at the beginning of a run, so none is tried within one.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}[/.]\d{2}[/.]\d{4})(?![/.-]?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{3}\)|\d{3})|\(\d{3}\)|\d{3}(?=[.-]))[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])(?<!\d )[2-9]\d\d [2-9]\d\d \d{4}(?!\d)(?! \d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "key": r"\bAKIA[A-Z0-9]{16}\b|\b[0-9a-fA-F]{32,}+\b",
}
PATTERN = "|".join(SHAPES.values())
#: Cards are the runs that validate, and in what is left, any groups of a chain of groups that do.
RUN = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
CHAIN = r"(?<![\d.-])(?=\d(?:[ -]?\d){12})\d++(?!-(?!\d))(?:[ -]\d++(?!-(?!\d)))*+(?![\d-])"
GROUPS = [rf"(?<!\d)(?=(\d(?:[ -]?\d){{{n - 1}}})(?!\d))" for n in range(19, 12, -1)]
#: Tried before other groups: one in ten of those validates by chance.
PRINTED = [r"(?<!\d)(?=(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d))"]
CARDS = (r"(?:(?<![\d.-])|(?<=\d[ -]))(?:", r")(?!\d)(?!-(?!\d))")
SSN = (898, 99, 9999)  # areas, groups and serials that exist
FIRST_DAY = "1800-01-01"
DAYS, DAY_RADIXES = 146_097, (339, 431)  # 400 years of the calendar; 339 * 431
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
FOUND = "struct<kind:string,text:string>"
PIECE = 128  # hexadecimal digits that are permuted together: work grows with the square


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a name that stands for value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _part(text: Column, at: Column | int, length: Column | int) -> Column:
    return F.substr(text, at if isinstance(at, Column) else F.lit(at), length if isinstance(length, Column) else F.lit(length))


def _div(a: Column, b: Column | int) -> Column:
    """The whole quotient."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def feistel(values: str, radixes: str, key: str, kind: str, rounds: int = ROUNDS) -> str:
    """SQL for the permuted digits. In a round, the digits of one half move by a hash of the other half."""
    shift = "cast(conv(substr(sha2(concat_ws('|', '{key}', '{kind}', r, other, i div 16), 256), 4 * (i % 16) + 1, 4), 16, 10) AS int)".format(key=key.replace("'", "''"), kind=kind)
    half = f"(i < size({values}) div 2) = (r % 2 = 0)"
    moved = f"transform(v, (x, i) -> CASE WHEN {half} THEN (x + {shift}) % ({radixes})[i] ELSE x END)"
    other = f"array_join(transform(filter(v, (x, i) -> NOT ({half})), x -> cast(x AS string)), ',')"
    return f"aggregate(sequence(0, {rounds - 1}), {values}, (v, r) -> transform(array({other}), other -> {moved})[0])"


def permuted(values: Column, radixes: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """`feistel` without SQL text, which Spark's parser remembers for good: what it keeps of these expressions as one text takes tens of MB of the driver."""
    half = lambda i, r: (i < _div(F.size(values), 2)) == (r % 2 == 0)

    def moved(v: Column, r: Column) -> Column:
        hashed = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r, other, _div(i, 16)), 256)
        shift = lambda i, other: F.conv(_part(hashed(i, other), i % 16 * 4 + 1, 4), 16, 10).cast("int")
        other = F.array_join(F.transform(F.filter(v, lambda x, i: ~half(i, r)), lambda x: x.cast("string")), ",")
        return _let(other, lambda o: F.transform(v, lambda x, i: F.when(half(i, r), (x + shift(i, o)) % radixes[i]).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), values, moved)


def _by_alphabet(value: Column, alphabet: Callable[[Column], Column], key: str, kind: str, fixed: Callable[[Column], Column] | None = None) -> Column:
    """Permutes a value's characters: alphabet gives a character's alphabet or '', fixed says which places stay."""
    own = (lambda c, i: alphabet(c)) if fixed is None else (lambda c, i: F.when(fixed(i), "").otherwise(alphabet(c)))
    cells = F.transform(F.split(value, ""), lambda c, i: F.struct(c.alias("c"), own(c, i).alias("a")))

    def new(cs: Column) -> Column:
        # the places that move, their digits and radixes; then each place takes its new digit, or keeps its character
        places = F.filter(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: cs[i]["a"] != "")
        digits = lambda q: F.transform(q, lambda i: F.position(cs[i]["c"], cs[i]["a"]) - 1)
        radixes = lambda q: F.transform(q, lambda i: F.length(cs[i]["a"]))
        put = lambda q, n: F.transform(cs, lambda x, i: F.when(x["a"] == "", x["c"]).otherwise(_part(x["a"], n[F.array_position(q, i).cast("int") - 1] + 1, 1)))
        return _let(places, lambda q: _let(digits(q), lambda ds: _let(radixes(q), lambda rs: _let(permuted(ds, rs, key, kind), lambda n: put(q, n)))))

    return _let(cells, lambda cs: F.when(F.exists(cs, lambda x: x["a"] != ""), F.array_join(new(cs), "")).otherwise(value))


def _luhn(digits: Column) -> Column:
    """The weighted sum of a string of digits, the last of which counts once."""
    weighed = lambda i: _part(digits, i, 1).cast("int") * ((F.length(digits) - i) % 2 + 1)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: _let(weighed(i), lambda d: s + _div(d, 10).cast("int") + d % 10))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _cards(text: Column) -> Column:
    """A text's cards as they are written, longer ones first."""
    valid = lambda found: F.filter(found, lambda x: _let(_digits(x), lambda y: _luhn(y) % 10 == 0))

    def more(cards: Column, shapes: list[str], then: Callable[[Column], Column]) -> Column:
        """then of the cards, and those of these shapes in what they leave."""
        left = F.when(F.size(cards) == 0, F.array(text)).otherwise(F.split(text, _either(cards)))
        chains = F.flatten(F.transform(left, lambda part: F.regexp_extract_all(part, F.lit(CHAIN), 0)))
        parts = lambda chains: [F.flatten(F.transform(chains, lambda x: F.regexp_extract_all(x, F.lit(g), 1))) for g in shapes]
        both = _let(chains, lambda c: F.when(F.size(c) == 0, cards).otherwise(F.concat(cards, valid(F.array_distinct(F.concat(*parts(c)))))))
        return _let(both, then)

    runs = valid(F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), 0)))
    every = _let(runs, lambda r: more(r, PRINTED, lambda printed: more(printed, GROUPS, lambda cards: cards)))
    return F.when(text.rlike(CHAIN) | text.rlike(RUN), F.array_sort(every, lambda a, b: F.length(b) - F.length(a))).otherwise(F.array().cast("array<string>"))


def _either(cards: Column) -> Column:
    return F.concat(F.lit(CARDS[0]), F.array_join(cards, "|"), F.lit(CARDS[1]))


def _pseudonym(m: Column, key: str) -> Column:
    """(kind, text) of a match; the kind is null if it doesn't validate."""
    is_digit = lambda c: c.rlike("^[0-9]$")
    classes = lambda c: F.when(is_digit(c), DIGITS).when(c.rlike("^[a-z]$"), LOWER).when(c.rlike("^[A-Z]$"), UPPER).otherwise("")
    only_digits = lambda c: F.when(is_digit(c), DIGITS).otherwise("")
    # a card's digits are dealt back into its groups
    payload = lambda d: F.concat(_part(d, 1, 1), _by_alphabet(_part(d, 2, F.length(d) - 2), only_digits, key, "card"))
    whole = lambda d: _let(payload(d), lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
    grouped = lambda e: F.transform(F.split(m, ""), lambda c, i: F.when(is_digit(c), _part(e, F.length(_digits(_part(m, 1, i + 1))), 1)).otherwise(c))
    card = _let(_digits(m), lambda d: _let(whole(d), lambda e: F.array_join(grouped(e), "")))
    country = F.length(F.regexp_extract(m, r"^\+\d{1,3}?(?=[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}$)", 0))
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    iso, first = m.rlike(r"^\d{4}-"), F.lit(datetime.date.fromisoformat(FIRST_DAY))
    day_first = F.try_to_date(F.translate(m, "/", "."), "dd.MM.yyyy")
    day = F.when(iso, F.try_to_date(m, "yyyy-MM-dd")).otherwise(F.coalesce(day_first, F.try_to_date(m, "MM/dd/yyyy")))
    number = F.datediff(day, first)
    moved = _let(permuted(F.array(_div(number, DAY_RADIXES[1]).cast("int"), number % DAY_RADIXES[1]), F.array(*map(F.lit, DAY_RADIXES)), key, "date"), lambda t: F.date_add(first, t[0] * DAY_RADIXES[1] + t[1]))
    as_written = F.call_function("date_format", moved, F.concat(F.lit("dd"), _part(m, 3, 1), F.lit("MM"), _part(m, 6, 1), F.lit("yyyy")))
    date = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).when(day_first.isNull(), F.date_format(moved, "MM/dd/yyyy")).otherwise(as_written)
    area = _part(m, 1, 3).cast("int")
    possible = area.between(1, 899) & (area != 666) & (_part(m, 5, 2) != "00") & (_part(m, 8, 4) != "0000")
    parts = F.array(area - F.when(area < 666, 1).otherwise(2), _part(m, 5, 2).cast("int") - 1, _part(m, 8, 4).cast("int") - 1)
    padded = lambda n, width: F.lpad(n.cast("string"), width, "0")
    ssn = _let(permuted(parts, F.array(*map(F.lit, SSN)), key, "ssn"), lambda n: F.concat(padded(n[0] + F.when(n[0] < 665, 1).otherwise(2), 3), F.lit("-"), padded(n[1] + 1, 2), F.lit("-"), padded(n[2] + 1, 4)))
    # the same secret in capitals has the same pseudonym in capitals
    alphabet = lambda c: F.when(~m.rlike("[A-F]"), HEX).when(~m.rlike("[a-f]"), HEX.upper()).when(is_digit(c), DIGITS).when(c.rlike("^[a-f]$"), "abcdef").otherwise("ABCDEF")
    at = lambda j, n: _div(j * F.length(m), n)
    piece = lambda j, n: _part(m, at(j, n).cast("int") + 1, (at(j + 1, n) - at(j, n)).cast("int"))
    pieces = F.ceil(F.length(m) / PIECE).cast("int")
    secret = _let(pieces, lambda n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda j: _let(piece(j, n), lambda h: _by_alphabet(h, alphabet, key, "hex"))), ""))
    pair = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    none = pair(None, m).cast(FOUND)
    email = _let(F.substring_index(m, "@", 1), lambda name: F.concat(_by_alphabet(name, classes, key, "email"), F.substr(m, F.length(name) + 1)))
    one_character = (F.length(m) > 128) & (F.length(F.replace(m, _part(m, 1, 1), F.lit(""))) == 0)
    return (
        F.when(m.contains("@"), pair("email", email))
        .when(m.rlike("^AKIA"), pair("key", _by_alphabet(m, lambda c: F.lit(UPPER + DIGITS), key, "AKIA", lambda i: i < 4)))
        .when(m.rlike("^[0-9a-fA-F]{32,}$"), F.when(one_character, none).otherwise(pair("key", secret)))
        .when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.when(F.exists(octets, lambda x: x > 255), none).otherwise(pair("ip", F.array_join(permuted(octets, F.array(*[F.lit(256)] * 4), key, "ip"), "."))))
        .when(m.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[/.]\d\d[/.]\d{4})$"), F.when(F.coalesce(number.between(0, DAYS - 1), F.lit(False)), pair("date", date)).otherwise(none))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(possible, pair("ssn", ssn)).otherwise(none))
        .when(m.rlike(r"^(\+|\()|^\d{3}[.-]\d{3}[ .-]?\d{4}$|^\d{3} \d{3} \d{4}$"), pair("phone", _by_alphabet(m, only_digits, key, "phone", lambda i: i < country)))
        .when(_let(_digits(m), lambda d: _luhn(d) % 10 == 0), pair("card", card))
        .otherwise(none)
    )


def session_key(spark: SparkSession) -> str:
    """The key that the session has in SETTING; without one the public key, which is for trials, and a warning."""
    key = spark.conf.get(SETTING, None)
    if not key:
        warnings.warn(f"{SETTING} is not set: pseudonyms are made with a public key and hide nothing", stacklevel=3)
    return key or PUBLIC_KEY


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, n_pii, and n_<kind> for each of KINDS. key: by default the session's."""
    key = session_key(docs.sparkSession) if key is None else key
    pattern = "__pattern"
    taken = {"n_pii", *(f"n_{k}" for k in KINDS)}
    out = docs.select(*[F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns)], F.col(f"`{column}`").cast("string").alias("__text"))
    out = out.withColumn("__cards", _cards(F.col("__text")))
    out = out.withColumn(pattern, F.when(F.size("__cards") > 0, F.concat(F.lit(PATTERN + "|"), _either(F.col("__cards")))).otherwise(PATTERN))
    out = out.withColumn("__found", F.coalesce(F.regexp_extract_all("__text", F.col(pattern), 0), F.array()))
    out = out.withColumn("__new", F.when(F.size("__found") == 0, F.array().cast(f"array<{FOUND}>")).otherwise(F.transform("__found", lambda m: _pseudonym(m, key))))
    text = F.when(F.size("__new") == 0, F.col("__text")).otherwise(F.array_join(F.zip_with(F.split("__text", F.col(pattern)), "__new", lambda s, r: F.concat(s, F.coalesce(r["text"], F.lit("")))), ""))
    count = lambda of: F.size(F.filter("__new", of)).cast("long")
    kinds = {k: count(lambda x: x["kind"] == k) for k in KINDS}  # noqa: B023
    own = [(text if c == column else F.col(f"__own_{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in taken]
    return out.select(*own, *[v.alias(f"n_{k}") for k, v in kinds.items()], count(lambda x: x["kind"].isNotNull()).alias("n_pii"))


def clean_text(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs, all columns as they were but for the text."""
    hidden = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else f"__in_{i}") for i, c in enumerate(docs.columns)])
    out = pseudonymise(hidden, key)
    return out.select(*[F.col(h).alias(c) for c, h in zip(docs.columns, hidden.columns, strict=True)])
