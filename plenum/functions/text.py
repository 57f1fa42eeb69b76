"""Parsing and folding of the record's strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents and what they fold to.
ACCENTS = "áàâäãåéèêëíìîïóòôöőõúùûüűñçßýÿ"
FOLDED = "aaaaaaeeeeiiiioooooouuuuuncsyy"

# Fixed value: titles before a name.
HONORIFIC = r"(?i)^(?:dr\.|prof\.|ifj\.|id\.|özv\.|dr\s)\s*"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), ACCENTS, FOLDED)


def tokens(c: Column, least: int = 3) -> Column:
    """Folded runs of letters and digits of at least so many characters."""
    return F.regexp_extract_all(fold(c), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))


def words(c: Column) -> Column:
    """Lower-cased words for verbatim comparison; what stands in round brackets is left out."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "), F.lit("[a-záéíóöőúüű0-9]+"), F.lit(0))


def whole_number(c: Column) -> Column:
    """An integer written with blanks or no-break spaces; anything else is null."""
    return F.regexp_replace(c, "[  ]", "").try_cast("int")


def dotted_date(c: Column) -> Column:
    """yyyy.MM.dd with or without a final dot."""
    return F.try_to_date(F.regexp_extract(c, r"^\s*(\d{4}\.\d{2}\.\d{2})\.?\s*$", 1), "yyyy.MM.dd")


def duration_seconds(c: Column) -> Column:
    """M:SS or H:MM:SS; empty fields at either end are dropped, anything else unreadable gives null."""
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*:\s*", ":"), r"^[\s:]+", ""), r"[\s:]+$", "")
    parts = F.transform(F.split(trimmed, ":"), lambda x: x.try_cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(c.contains(":") & trimmed.rlike("^[0-9]+(:[0-9]+)*$"), total)


def honorific_stripped(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), HONORIFIC, ""))


def motion_number(c: Column) -> dict[str, Column]:
    """'T/71' (in any case) is motion 71 of type T; '56/4' amendment 4 of 56; other text has neither, and no text no kind."""
    raw = F.trim(c)
    typed, amendment = r"^([A-Za-zÁÉÍÓÖŐÚÜŰáéíóöőúüű]+)/(\d+)$", r"^(\d+)/(\d+)$"
    is_typed, is_amendment = raw.rlike(typed), raw.rlike(amendment)
    return {
        "kind": F.when(c.isNull() | (c == ""), None).when(is_typed, "motion").when(is_amendment, "amendment").otherwise("other"),
        "prefix": F.when(is_typed, F.upper(F.regexp_extract(raw, typed, 1))),
        "number": F.when(is_typed, F.regexp_extract(raw, typed, 2).try_cast("int")).when(is_amendment, F.regexp_extract(raw, amendment, 1).try_cast("int")),
        "part": F.when(is_amendment, F.regexp_extract(raw, amendment, 2).try_cast("int")),
    }


def split_event(event: Column, numbers: Column) -> dict[str, Column]:
    """The stage before an agenda item's first motion number and the subject after it."""
    first = F.trim(F.split_part(F.coalesce(numbers, F.lit("")), F.lit(" · "), F.lit(1)))
    at = F.when(first != "", F.instr(event, first)).otherwise(0)
    blank = lambda c: F.when(c != "", c)
    after = F.substring(event, at + F.length(first), F.length(event))
    edges = "[ –—\\-:,]+"
    return {
        "stage": F.when(at > 0, blank(F.trim(F.substring(event, F.lit(1), at - 1)))),
        "subject": F.when(at > 0, blank(F.regexp_replace(F.regexp_replace(after, f"^{edges}", ""), f"{edges}$", ""))).otherwise(blank(F.trim(event))),
    }


def term_of(day: Column) -> Column:
    """The term of a day: the last one that began on or before it."""
    out = F.lit(None).cast("int")
    for number, began in TERMS:
        out = F.when(day >= F.lit(began).cast("date"), number).otherwise(out)
    return out


def collation_key(c: Column, locale: str = "hu") -> Column:
    """A sort key for tables: cells that begin with a number come first, by it; the rest by the locale's alphabet; null as empty."""
    cell = F.trim(F.coalesce(c, F.lit("")))
    number = F.regexp_extract(cell, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")
    return F.struct(F.isnull(number).alias("wordy"), number.alias("number"), F.collate(F.when(number.isNull(), cell).otherwise(""), locale).alias("letters"))


def term_of_label(c: Column) -> Column:
    """The number of a printed term ("2022-2026"): the one of 1990 is 34, each four years have the next; null without a year, or before."""
    year = F.regexp_extract(F.trim(c), r"^(\d{4})", 1).try_cast("int")
    return F.when(year >= 1990, F.floor((year - 1990) / 4).cast("int") + 34)


def mandate_kind(constituency: Column) -> Column:
    """What a seat was won by, from the text of its constituency."""
    low = F.lower(F.coalesce(constituency, F.lit("")))
    district = low.contains("oevk") | low.contains("választókerület")
    return F.when(low.contains("országos lista"), "lista").when(district, "egyeni").when(low.contains("nemzetiségi"), "nemzetisegi").otherwise("other")


def seats_of(day: Column) -> Column:
    """The seats of the House on a day: 386 until the House of 2014 met, 199 since."""
    return F.when(day < F.lit("2014-05-06").cast("date"), 386).otherwise(199)


def mandate_of_record(constituency: Column) -> dict[str, Column]:
    """What a past mandate was won by, from a record's constituency: 'Fejér 3. OEVK' is a district, anything else a list's label."""
    district = r"^(.*?)\s+(\d+)\.\s*OEVK$"
    known = constituency.isNotNull() & (constituency != "")
    own = known & constituency.rlike(district)
    return {
        "mandate": F.when(own, "egyeni").when(known, "lista"), "county": F.when(own, F.regexp_extract(constituency, district, 1)),
        "district": F.when(own, F.regexp_extract(constituency, district, 2).try_cast("int")), "list_label": F.when(known & ~own, constituency),
    }


# The months' names.
MONTHS = ["január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december"]
ENGLISH_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _month(day: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in names]), F.month(day))


def thousands(c: Column) -> Column:
    """A whole number with no-break spaces between thousands, the half rounded to even."""
    return F.translate(F.format_number(F.bround(c, 0).cast("long"), 0), ",", "\u00a0")


def hungarian_date(day: Column) -> Column:
    """'2026. július 21.'"""
    return F.concat(F.year(day).cast("string"), F.lit(". "), _month(day, MONTHS), F.lit(" "), F.dayofmonth(day).cast("string"), F.lit("."))


def english_date(day: Column) -> Column:
    """'21 July 2026'"""
    return F.concat_ws(" ", F.dayofmonth(day).cast("string"), _month(day, ENGLISH_MONTHS), F.year(day).cast("string"))


def day_on(n: Column) -> Column:
    """A day of a month with the ending of 'on', by vowel harmony: 1-jén, 2-án, 4-én, 20-án."""
    dark = (n == 2) | ((n % 10 == 0) & (n != 10)) | (n % 10).isin(3, 6, 8)
    return F.concat(n.cast("string"), F.when(n == 1, "-jén").when(dark, "-án").otherwise("-én"))


def date_on(day: Column) -> Column:
    """'2026. július 22-én'"""
    return F.concat(F.year(day).cast("string"), F.lit(". "), _month(day, MONTHS), F.lit(" "), day_on(F.dayofmonth(day)))


def date_until(day: Column) -> Column:
    """'2026. július 21-ig'"""
    n = F.dayofmonth(day)
    return F.concat(F.year(day).cast("string"), F.lit(". "), _month(day, MONTHS), F.lit(" "), F.when(n == 1, "1-jéig").otherwise(F.concat(n.cast("string"), F.lit("-ig"))))


# Terms and the day each began.
TERMS: list[tuple[int, str]] = [
    (34, "1990-05-02"), (35, "1994-06-28"), (36, "1998-06-18"), (37, "2002-05-15"), (38, "2006-05-16"),
    (39, "2010-05-14"), (40, "2014-05-06"), (41, "2018-05-08"), (42, "2022-05-02"), (43, "2026-05-09"),
]
