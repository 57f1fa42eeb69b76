r"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame operations only.

Values are found by one pattern, validated, and permuted within their own format, so a value has the
same pseudonym in every document, two values never share one, and the text around them stays as it is:

- ``card``: 13 to 19 digits (also in groups joined by one blank or hyphen) with a valid Luhn digit.  The
  digits before the last are permuted and the Luhn digit is worked out anew; grouping stays.  In a run of
  groups each unbroken number and each group of four with the groups that make a card's usual forms
  (``_CARD``) is tried first, from the left; then what is left is tried as the longest run of groups.
- ``phone``: an international number: +1 and ten digits, or + and another country code with two to four
  groups of digits, 8 to 15 in all; blanks, hyphens, dots or brackets between.  The digits after the country
  code (1, or two digits) are permuted.
- ``ssn``: ddd-dd-dddd with an area of 001 to 899 but 666, a group from 01 and a serial from 0001.  It stays so.
- ``ip``: four numbers of 0 to 255 without leading zeros, joined by dots; a port or a path may follow.  The 32 bits are permuted.
- ``date``: yyyy-mm-dd, dd.mm.yyyy or dd/mm/yyyy that the calendar has, from
  1900-01-01 to 2099-12-31; T and a time, or a path, may follow.  The day's number is permuted among the 73,049
  days; the form stays.

A number of ``n`` digits is split into two halves; ``ROUNDS`` times one half is moved, modulo its size, by
a keyed hash of the other half, of the round, and of the kind and length.  Domains that are no power of ten are
split into factors, so the result is always inside the domain and no cycle walking is needed.  The
permutation is undone with the same key (``undo``).  It finds the values again by the same rules; where two
candidates for a card overlap ('1234 4785 3805 9239 1139'), the one that was no card can have a valid Luhn digit
by chance once the other is changed, and ``undo`` then takes the wrong one.

Cases: a null text stays null and has no values; an empty text has none.  What fails validation is left
alone.  Rows that repeat stay rows; a null doc_id stays null.  Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31: 17 * 4297.
DAY_0, DAYS, DAY_PARTS = "1900-01-01", 73_049, (17, 4297)

_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_])(?<![\p{N}][.\-/:])", r"(?![\p{L}\p{N}_])(?![.\-/:]?\p{N})"
_FORMS = {
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\p{N}_])(?!(?![Tt]\d)\p{L})(?![.\-]\p{N})",
    "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}_])(?![.\-]\p{N})",
    "ssn": rf"\d{{3}}-\d{{2}}-\d{{4}}{_EDGE_R}",
}
_OTHERS = "|".join(_FORMS.values())
#: Digits and groups of digits up to the next value of another form, with what follows them (at most two characters).
_RUN = rf"(?=\d(?:[ \-]?\d){{12}})\d++(?:(?: (?!{_OTHERS})|-)\d++)*+(?:[.\-/:]?[\p{{L}}\p{{N}}_])?"
#: The usual forms of a card inside such a run, and any other grouping.
_CARD = (
    r"(?<![\p{L}\p{N}_])(?:\d{13,19}|\d{4}(?<sep>[ \-])(?:\d{4}\k<sep>\d{4}\k<sep>\d{4}|\d{4}\k<sep>\d{5}|\d{5}\k<sep>\d{6}|\d{6}\k<sep>\d{4,5}))"
    r"(?![\p{L}\p{N}_])(?!\.\p{N})"
)
_GROUPS = rf"{_EDGE_L}\d(?:[ \-]?\d){{12,18}}{_EDGE_R}"
#: Characters that one usual form and its right edge can have, and more.
_REACH = 32
_PHONE = (
    r"(?<![\p{L}\p{N}_+])\+(?:1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}|(?!1[ .\-(\d])\d{2,3}(?:[ .\-]?\(?\d{2,5}\)?){2,4})(?![\p{L}\p{N}_])"
)
PATTERN = f"(?=[+0-9])(?:{_PHONE}|{_EDGE_L}(?:{_OTHERS}|{_RUN}))"  # the first look spares most places the rest


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, last_is_check: bool) -> Column:
    """Sum of the digits, every second one doubled; the check digit itself isn't doubled."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)
    doubled = (n - F.lit(0 if last_is_check else 1)) % 2

    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 != doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), one)


def feistel(a: Column, b: Column, high: Column, low: Column, kind: str, key: Column, tweak: Column, undo: bool = False) -> Column:
    """A permutation of the pairs (a below high, b below low): a and b are moved in turns."""
    sign = F.lit(-1 if undo else 1).cast("long")

    def word(t: Column, half: Column) -> Column:
        text = F.concat_ws(":", key, F.lit(kind), tweak.cast("string"), t.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, t: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(t % 2 == 0, F.struct(F.pmod(a + sign * (word(t, b) % high), high).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), F.pmod(b + sign * (word(t, a) % low), low).alias("b"))
        )

    turns = range(ROUNDS)[::-1] if undo else range(ROUNDS)
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(t) for t in turns]), start, turn)


def _number(digits: Column, kind: str, key: Column, undo: bool) -> Column:
    """A string of 2 to 18 digits, permuted among the strings of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    a, b = F.substring(digits, F.lit(1), left).try_cast("long"), F.substring(digits, left + 1, right).try_cast("long")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    done = feistel(a, b, power(left), power(right), kind, key, n, undo)
    return _let(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), right, F.lit("0"))))


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, one after another, by ``digits``."""
    signs = F.split(form, "")

    def put(acc: Column, sign: Column) -> Column:
        is_digit = sign.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(sign)).alias("s"),
            (acc["k"] + F.when(is_digit, 1).otherwise(0)).alias("k"),
        )

    return F.aggregate(signs, F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), put)["s"]


def _date_parts(v: Column) -> Column:
    iso = v.rlike(r"^\d{4}-")
    return F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(
        F.try_to_date(F.regexp_replace(v, "[./]", "-"), "dd-MM-yyyy")
    )


def _is_card(v: Column) -> Column:
    return _let(_digits(v), lambda d: F.when(F.length(d).between(13, 19), _luhn_sum(d, True) % 10 == 0).otherwise(False))


def kind_of(v: Column) -> Column:
    """The kind of a matched value that is valid, else null."""
    is_ip = v.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")  # 010.0.0.1 would share its pseudonym with 10.0.0.1
    is_ssn = v.rlike(r"^\d{3}-\d{2}-\d{4}$")
    is_date = v.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\2\d{4})$")
    octets = reduce(lambda a, b: a & b, [F.split_part(v, F.lit("."), F.lit(k)).try_cast("int") <= 255 for k in (1, 2, 3, 4)])
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(k)) for k in (1, 2, 3))
    first = F.lit(DAY_0).cast("date")
    return (
        F.when(v.startswith("+"), _let(F.length(_digits(v)), lambda n: F.when(n.between(8, 15), "phone")))
        .when(is_ip, F.when(octets, "ip"))
        .when(is_ssn, F.when((area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000"), "ssn"))
        .when(is_date, F.when(_date_parts(v).between(first, F.date_add(first, DAYS - 1)), "date"))
        .otherwise(F.when(_is_card(v), "card"))
    )


def _part(v: Column, kind: Column) -> Column:
    return F.struct(v.alias("v"), kind.cast("string").alias("kind"))


def _usual_cards(run: Column) -> Column:
    """The run cut into parts (v, kind): valid cards of a usual form, from the left, and what is between."""

    def step(acc: Column, piece: Column) -> Column:
        form = F.regexp_extract(F.substring(run, acc["at"], F.lit(_REACH)), f"^{_CARD}", 0)
        card = _let(form, lambda c: F.when((acc["skip"] == 0) & _is_card(c), c).otherwise(""))

        def taken(c: Column) -> Column:
            n, eaten = F.length(piece), F.greatest(acc["skip"], F.length(c))
            rest = F.substring(piece, eaten + 1, n)
            return F.struct(
                F.when(c != "", F.concat(acc["parts"], F.array(_part(acc["open"], F.lit(None)), _part(c, F.lit("card"))))).otherwise(acc["parts"]).alias("parts"),
                F.when(c != "", rest).otherwise(F.concat(acc["open"], rest)).alias("open"),
                F.greatest(eaten - n, F.lit(0)).alias("skip"),
                (acc["at"] + n).alias("at"),
            )

        return _let(card, taken)

    none = F.array().cast("array<struct<v:string,kind:string>>")
    start = F.struct(none.alias("parts"), F.lit("").alias("open"), F.lit(0).alias("skip"), F.lit(1).alias("at"))
    return F.aggregate(F.split(run, f"(?={_CARD})", -1), start, step, lambda acc: F.concat(acc["parts"], F.array(_part(acc["open"], F.lit(None)))))


def _other_cards(text: Column) -> Column:
    """Text without usual cards cut into parts (v, kind) by the longest runs of groups."""
    none = F.lit(None)
    found = F.regexp_extract_all(text, F.lit(_GROUPS), F.lit(0))
    kinds = lambda v: F.array(_part(v, F.when(_is_card(v), "card")))
    pairs = lambda r, k: _let(F.get(found, k), lambda v: F.when(v.isNull(), F.array(_part(r, none))).otherwise(F.concat(F.array(_part(r, none)), kinds(v))))
    return F.flatten(F.transform(F.split(text, _GROUPS, -1), pairs))


def parts_of(v: Column) -> Column:
    """A match as parts (v, kind), in order: itself, or a run of digits with the cards that are in it."""
    itself = v.startswith("+") | v.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\d{3}-\d{2}-\d{4}|\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$")
    run = F.flatten(F.transform(_usual_cards(v), lambda p: F.when(p["kind"].isNull(), _other_cards(p["v"])).otherwise(F.array(_part(p["v"], p["kind"])))))
    return F.when(itself, F.array(_part(v, kind_of(v)))).otherwise(run)


def _card(v: Column, key: Column, undo: bool) -> Column:
    def checked(body: Column) -> Column:
        check = (F.lit(10) - _luhn_sum(body, False) % 10) % 10
        return _let(F.concat(body, check.cast("string")), lambda d: _refill(v, d))

    body = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)
    return _let(_digits(v), lambda d: _let(body(d), lambda b: _let(_number(b, "card", key, undo), checked)))


def _phone(v: Column, key: Column, undo: bool) -> Column:
    def moved(d: Column) -> Column:
        code = F.when(d.startswith("1"), 1).otherwise(2)
        rest = F.substring(d, code + 1, F.length(d))
        new = _let(rest, lambda r: _number(r, "phone", key, undo))
        return _let(F.concat(F.substring(d, F.lit(1), code), new), lambda x: _refill(v, x))

    return _let(_digits(v), moved)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _ip(v: Column, key: Column, undo: bool) -> Column:
    octet = [F.split_part(v, F.lit("."), F.lit(k)).try_cast("long") for k in (1, 2, 3, 4)]
    new = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], _long(1 << 16), _long(1 << 16), "ip", key, F.lit(0), undo)
    return _let(new, lambda x: F.concat_ws(".", *[F.shiftright(x[h], s).bitwiseAND(255).cast("string") for h in "ab" for s in (8, 0)]))


def _ssn(v: Column, key: Column, undo: bool) -> Column:
    part = [F.split_part(v, F.lit("-"), F.lit(k)).try_cast("long") for k in (1, 2, 3)]
    area = F.when(part[0] > 666, part[0] - 2).otherwise(part[0] - 1)
    new = feistel(area * 99 + part[1] - 1, part[2] - 1, _long(898 * 99), _long(9999), "ssn", key, F.lit(0), undo)

    def written(x: Column) -> Column:
        place = F.floor(x["a"] / 99).cast("long")
        return F.format_string("%03d-%02d-%04d", F.when(place >= 665, place + 2).otherwise(place + 1), x["a"] % 99 + 1, x["b"] + 1)

    return _let(new, written)


def _date(v: Column, key: Column, undo: bool) -> Column:
    first = F.lit(DAY_0).cast("date")
    high, low = DAY_PARTS[1], DAY_PARTS[0]
    moved = lambda day: feistel(F.floor(day / low), day % low, _long(high), _long(low), "date", key, F.lit(0), undo)

    def written(x: Column) -> Column:
        form = lambda f: F.date_format(F.date_add(first, (x["a"] * low + x["b"]).cast("int")), f)
        return F.when(v.rlike(r"^\d{4}-"), form("yyyy-MM-dd")).when(v.contains("."), form("dd.MM.yyyy")).otherwise(form("dd/MM/yyyy"))

    return _let(F.datediff(_date_parts(v), first), lambda day: _let(moved(day), written))


def pseudonym(v: Column, kind: Column, key: Column, undo: bool = False) -> Column:
    """The pseudonym of a matched value of that kind, or the value itself where it has none."""
    makers = {"card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date}
    out = F.when(kind.isNull(), v)
    for name, make in makers.items():
        out = out.when(kind == name, make(v, key, undo))
    return F.coalesce(out, v)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """doc_id, n_values, kinds (array of kinds found, in order), text with pseudonyms: one row for each row.

    Plans, and so the UI and the event log, name the subquery that has the key, and don't show the key.
    """
    secret = docs.sparkSession.sql("SELECT * FROM VALUES (:key) AS t(key)", {"key": key})
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), secret.scalar().alias("secret"))
    some = rows.withColumn("found", F.when(F.col("text").rlike(r"\d.{0,3}\d"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    none = F.col("found").isNull() | (F.size("found") == 0)
    some = some.withColumn("rest", F.when(~none, F.split("text", PATTERN, -1)))
    new = lambda p: F.struct(p["kind"].alias("kind"), pseudonym(p["v"], p["kind"], F.col("secret"), undo).alias("new"))
    made = F.transform("found", lambda v: F.transform(parts_of(v), new))
    some = some.withColumn("made", F.when(~none, made))
    kinds = F.filter(F.transform(F.flatten("made"), lambda m: m["kind"]), lambda k: k.isNotNull())
    both = F.transform("rest", lambda r, k: F.concat(r, F.coalesce(F.array_join(F.get(F.col("made"), k)["new"], ""), F.lit(""))))
    joined = F.array_join(both, "")
    return some.select(
        "doc_id",
        F.when(none, F.lit(0)).otherwise(F.size(kinds)).cast("long").alias("n_values"),
        F.when(none, F.array().cast("array<string>")).otherwise(kinds).alias("kinds"),
        F.when(none, F.col("text")).otherwise(joined).alias("text"),
    )
