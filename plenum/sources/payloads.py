"""XML payloads to rows: reading, repair, and the adapters of votes, rolls, speeches, members and sitting days."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions import text
from plenum.operators.floor import INDEPENDENT

PROPERTY = "struct<_nev:string,_ertek:string,_href:string>"
MOTION = "struct<iromany:string,pont:string,cim:string,benyujto:struct<_nev:string,_VALUE:string>,ok:string>"
GROUP_ROW = "struct<_frakcio:string,igen_db:int,nem_db:int,tart_db:int,igtav_db:int,nemszav_db:int,osszesen:int>"
VOTE = (
    "struct<_idopont:string,tulajdonsagok:struct<tulajdonsag:array<" + PROPERTY + ">>,inditvanyok:struct<inditvany:array<" + MOTION + ">>,"
    "kepvcsop_szerint:struct<szavazat:array<" + GROUP_ROW + ">>,nev_szerint:struct<szavazat:array<struct<_kepviselo:string,_frakcio:string,_szavazat:string>>>>"
)
DAY = "struct<datum:string,ulnap:int,nap:string,ulszak:string,ulesjelleg:string,megjegyzes:string>"
SPEECH = "struct<sorszam:int,felszolalo:string,felsztip:string,kormbiz:string,felszkezdete:string,videoido:string>"

# How a roll call prints a position, and the code it stands for.
POSITIONS = {
    "Igen": "yes", "Nem": "no", "Tart.": "abstain", "Jelen, nem szav.": "present_not_voting", "Nem szav.": "not_voting",
    "Előre bejelentett hiányzó": "announced_absent", "Ig.távol": "excused",
}
OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


#: The characters that the upper 128 bytes are in Latin-1.
_HIGH = "".join(map(chr, range(0x80, 0x100)))


def _high(charset: str) -> str:
    """What the upper 128 bytes are in a charset of one byte a character."""
    return "".join(bytes([b]).decode(charset, "replace") for b in range(0x80, 0x100))


def read_payloads(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """(path, raw): the payload files below ``path``, decoded by their declared encoding, else by ``charset``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    declared = F.lower(F.regexp_extract(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), r"encoding=[\"']([^\"']+)[\"']", 1))
    latin = F.decode("content", "ISO-8859-1")
    raw = F.when(declared == "iso-8859-1", latin)
    for name in ("iso-8859-2", "windows-1250"):
        raw = raw.when(declared == name, F.translate(latin, _HIGH, _high(name)))
    return files.select("path", raw.otherwise(F.decode("content", charset)).alias("raw"))


_QUOTED = re.compile(r'((?:nev|ertek|kepviselo|szavazat|frakcio|cim)=")(.*?)("(?=\s+[\w:]+=|\s*/?>))', re.S)


@F.pandas_udf(T.StringType())
def repair_quotes(raw: pd.Series) -> pd.Series:
    """Quotes inside known attributes become entities; repaired text stays as it is."""

    def one(s: str | None) -> str | None:
        return None if s is None else _QUOTED.sub(lambda m: m.group(1) + m.group(2).replace('"', "&quot;") + m.group(3), s)

    return raw.map(one)


def repair_ampersands(raw: Column) -> Column:
    """A bare & becomes an entity; entities stay."""
    return F.regexp_replace(raw, r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)", "&amp;")


def parse(payloads: DataFrame, schema: str) -> DataFrame:
    """``doc`` parsed from ``raw``; only payloads that fail are repaired and parsed again; null where that fails too.

    What is parsed is a generated column: whatever is asked of it later, each payload is read once, and those that are fine go
    through the repair as nulls.
    """
    kind = f"struct<{schema},_corrupt_record:string>"
    options = {**OPTIONS, "columnNameOfCorruptRecord": "_corrupt_record"}
    first = payloads.select("*", F.explode_outer(F.array(F.from_xml("raw", kind, options))).alias("doc"))
    bad = F.col("doc._corrupt_record").isNotNull() | F.col("doc").isNull()
    again = first.withColumns({"__again": repair_quotes(F.when(bad, F.col("raw"))), "repaired": bad}).withColumnRenamed("doc", "__doc")
    again = again.select("*", F.explode_outer(F.array(F.from_xml(repair_ampersands(F.col("__again")), kind, options))).alias("__second"))
    doc = F.when(~F.col("repaired"), F.col("__doc")).when(F.col("__second._corrupt_record").isNull(), F.col("__second"))
    return again.select(*payloads.columns, F.explode_outer(F.array(doc)).alias("doc"), "repaired")


def properties(c: Column) -> Column:
    """A property list as a map; of equal names the last one holds."""
    named = F.filter(F.coalesce(c, F.array().cast(f"array<{PROPERTY}>")), lambda t: t["_nev"].isNotNull())
    last = F.filter(named, lambda t, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda u: u["_nev"] == t["_nev"]))
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["_nev"].alias("key"), t["_ertek"].alias("value"))))


def votes(payloads: DataFrame) -> DataFrame:
    """One row a vote payload: vote, on_date, slug, mode, kind, result, properties, motions, groups, roll."""
    doc = parse(payloads, f"szavazas:{VOTE}")
    v = F.coalesce(F.col("doc.szavazas"), F.lit(None))
    rows = doc.select("path", "repaired", v.alias("v")).filter("v is not null").withColumn("p", properties(F.col("v.tulajdonsagok.tulajdonsag")))
    at = F.try_to_timestamp(F.col("v._idopont"), F.lit("yyyy.MM.dd.HH:mm:ss"))
    mode = F.col("p")["Szavazási mód"]
    return rows.select(
        "path", "repaired", F.col("v._idopont").alias("vote"), at.cast("date").alias("on_date"), F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss").alias("slug"),
        mode.alias("mode"), F.when(mode.startswith("Jelenlét"), "quorum").otherwise("decision").alias("kind"), mode.contains("Titkos").alias("secret"),
        F.col("p")["Eredmény"].alias("result"), F.col("p").alias("properties"), F.col("v.inditvanyok.inditvany").alias("motions"),
        F.col("v.kepvcsop_szerint.szavazat").alias("groups"), F.col("v.nev_szerint.szavazat").alias("roll"),
    )


def roll_positions(rows: DataFrame) -> DataFrame:
    """(vote, label, grp, position): unseen labels stay visible; an empty group is the independents'."""
    known = F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv])
    each = rows.select("vote", F.explode("roll").alias("r"))
    grp = F.trim(F.coalesce(F.col("r._frakcio"), F.regexp_extract("r._kepviselo", r"\(([^()]*)\)\s*$", 1)))
    label = F.col("r._szavazat")
    return each.select("vote", F.col("r._kepviselo").alias("label"), F.when(grp == "", INDEPENDENT).otherwise(grp).alias("grp"), F.coalesce(F.try_element_at(known, label), F.concat(F.lit("unknown:"), label)).alias("position"))


def group_rows(rows: DataFrame) -> DataFrame:
    """(vote, grp, yes, no, abstain, excused, not_voting, total, is_total) of the source's own tallies."""
    each = rows.select("vote", F.explode("groups").alias("g"))
    name = F.trim(F.coalesce("g._frakcio", F.lit("")))
    cols = {"yes": "igen_db", "no": "nem_db", "abstain": "tart_db", "excused": "igtav_db", "not_voting": "nemszav_db", "total": "osszesen"}
    return each.select("vote", F.when(name == "", INDEPENDENT).otherwise(name).alias("grp"), *[F.col(f"g.{c}").alias(n) for n, c in cols.items()], name.startswith("Összesen").alias("is_total"))


def motions(rows: DataFrame) -> DataFrame:
    """(vote, motion, iromany, kind, prefix, number, part, title, outcome)."""
    each = rows.select("vote", F.posexplode("motions").alias("motion", "m")).withColumn("iromany", F.col("m.iromany"))
    return each.select("vote", "motion", "iromany", *[c.alias(n) for n, c in text.motion_number(F.col("iromany")).items()], F.col("m.cim").alias("title"), F.col("m.ok").alias("outcome"))


# Weekday names, Monday first.
WEEKDAYS = ["hétfő", "kedd", "szerda", "csütörtök", "péntek", "szombat", "vasárnap"]


def sitting_days(payloads: DataFrame) -> DataFrame:
    """(path, printed, weekday, ulnap, session, kind) of the lists of sitting days; weekday 0 is Monday."""
    doc = parse(payloads, f"ulesnap:array<{DAY}>")
    each = doc.select("path", F.explode("doc.ulesnap").alias("d"))
    weekday = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.lower(F.trim("d.nap"))) - 1
    return each.select("path", text.dotted_date(F.col("d.datum")).alias("printed"), F.when(weekday >= 0, weekday.cast("int")).alias("weekday"), F.col("d.ulnap").alias("ulnap"), F.col("d.ulszak").alias("session"), F.col("d.ulesjelleg").alias("kind"))


def speeches(payloads: DataFrame) -> DataFrame:
    """The running order of a day's list: (path, ord, seq, event, numbers, label, name, grp, kind, role, seconds)."""
    doc = parse(payloads, f"_ulesnap:int,_datum:string,esemeny:array<struct<_VALUE:string,felszolalas:array<{SPEECH}>>>")
    items = doc.select("path", F.posexplode("doc.esemeny").alias("item", "e"))
    rows = items.select("path", "item", F.trim("e._VALUE").alias("event"), F.posexplode("e.felszolalas").alias("n", "s"))
    found = F.array_distinct(F.regexp_extract_all("event", F.lit(r"[A-ZÁÉÍÓÖŐÚÜŰ]/\d+"), F.lit(0)))
    from pyspark.sql import Window as W

    ordinal = F.row_number().over(W.partitionBy("path").orderBy("item", "n"))
    label = F.col("s.felszolalo")
    grp = F.regexp_extract(label, r"\(([^()]*)\)\s*$", 1)
    return rows.select(
        "path", ordinal.alias("ord"), F.col("s.sorszam").alias("seq"), "event", F.when(F.size(found) > 0, F.array_join(found, " · ")).alias("numbers"), label.alias("label"),
        F.trim(F.regexp_replace(label, r"\s*\([^()]*\)\s*$", "")).alias("name"), F.when(grp != "", grp).alias("grp"), F.col("s.felsztip").alias("kind"),
        F.col("s.kormbiz").alias("role"), text.duration_seconds(F.col("s.videoido")).alias("seconds"),
    )


def paragraphs(html: Column) -> Column:
    """The non-empty paragraphs of an HTML text: tags out, five named entities back, blanks collapsed."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^<>]*)?>(.*?)</p>"), F.lit(1))

    def plain(p: Column) -> Column:
        p = F.regexp_replace(p, r"<[^<>]*>", "")
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            p = F.replace(p, F.lit(entity), F.lit(sign))
        return F.trim(F.regexp_replace(p, r"[ \t\n\r]+", " "))

    return F.filter(F.transform(found, plain), lambda p: p != "")
