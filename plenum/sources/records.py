"""Adapters of the record's other payloads: lists of members, a member's record, spokespersons, committees, bills.

Each gives rows with null for what a payload leaves out or leaves empty; a payload that can't be read even after repair
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plenum.functions import text
from plenum.sources.payloads import PROPERTY, parse, properties

# The sections of a member's record: the element around it, its items, and what their attributes become.
SECTIONS: dict[str, tuple[str, str, dict[str, str]]] = {
    "groups": ("kepvcsop-tagsagok", "tagsag", {"term": "ciklus", "grp": "kepvcsop", "since": "tol_datum date", "until": "ig_datum date"}),
    "elections": ("valasztasok", "valasztas", {"term": "ciklus", "elected_on": "megvalasztas_napja date", "constituency": "valasztokerulet", "since": "mandatum_kezdete date", "until": "mandatum_vege date"}),
    "motion_counts": ("inditvanyok", "stat", {"term": "ciklus", "own": "onallo_db int", "other": "nem_onallo_db int"}),
    "speech_counts": ("felszolalasok", "stat", {"term": "ciklus", "speeches": "felszolalas_db int", "technical": "technikai_db int"}),
    "committees": ("bizottsagi-tagsagok", "tagsag", {"committee": "bizottsag", "subcommittee": "albizottsag", "role": "tisztseg", "since": "tol date", "until": "ig date"}),
    "offices": ("tisztsegek", "tisztseg", {"office": "megnevezes", "since": "tol_datum date", "until": "ig_datum date"}),
    "schools": ("iskolak", "iskola", {"degree": "vegzettseg_kepzettseg", "institution": "intezmeny", "faculty": "kar", "year": "ev int"}),
    "languages": ("nyelvismeret", "nyelv", {"language": "nyelv", "level": "fok"}),
    "declarations": ("vagyonnyilatkozatok", "vagyonnyilatkozat", {"title": "cim", "url": "href", "as_of": "allapot_idopont date", "due": "beadasi_hatarido date", "filed": "beadva yes"}),
    "pay": ("javadalmazas", "javadalom", {"period": "idoszak", "gross": "brutto_tiszteletdij int", "constituency": "valasztokeruleti_potlek int", "housing": "lakhatasi_tamogatas int"}),
    "local_offices": ("egyeb-tagsagok", "tagsag", {"body": "testulet", "body_kind": "testulet_tipus", "office": "tisztseg", "since": "tol_datum", "until": "ig_datum"}),
}

MOST_LISTED = 999  # where a list gives no place


def blank(c: Column) -> Column:
    """A trimmed text, null if nothing is left."""
    return F.when(F.trim(c) != "", F.trim(c))


def _value(c: Column, kind: str) -> Column:
    if kind == "date":
        return text.dotted_date(c)
    if kind == "int":
        return text.whole_number(c)
    return F.coalesce(F.trim(c) == "igen", F.lit(False)) if kind == "yes" else blank(c)


def members(payloads: DataFrame) -> DataFrame:
    """The list of members: (path, member, name, grp, photo, county, district, mandate, ord).

    Who comes from the national list has no district; a seat with neither is "other".
    """
    doc = parse(payloads, "kepviselo:array<struct<_p_azon:string,_nev:string,_kepv_csop:string,_kep:string,_vmegye:string,_vkorzet:string,_sorszam:string>>")
    m = doc.select("path", F.explode("doc.kepviselo").alias("m")).select("path", "m.*")
    mandate = F.when(F.col("_vmegye") == "Országos lista", "lista").when(blank(F.col("_vkorzet")).isNotNull(), "egyeni").otherwise("other")
    return m.select(
        "path", F.col("_p_azon").alias("member"), F.col("_nev").alias("name"), F.col("_kepv_csop").alias("grp"), F.col("_kep").alias("photo"), blank(F.col("_vmegye")).alias("county"),
        text.whole_number(F.col("_vkorzet")).alias("district"), mandate.alias("mandate"), text.whole_number(F.col("_sorszam")).alias("ord"),
    )


def member_records(payloads: DataFrame) -> DataFrame:
    """A member's record: (path, name, photo, website, biography, highest_degree, seat) and an array for each of ``SECTIONS``.

    ``section`` makes a table of one of them.  An office without a name is left out.
    """
    fields = ["nev:string", "fenykep:string", "honlap:string", "oneletrajz:string", "ulohely:struct<_szektor:string,_sor:string,_szek:string>"]
    for outer, item, columns in SECTIONS.values():
        extra = "`legmagasabb-elismert`:string," if outer == "iskolak" else ""
        fields.append(f"`{outer}`:struct<{extra}{item}:array<struct<{','.join(f'_{a.split()[0]}:string' for a in columns.values())}>>>")
    doc = parse(payloads, ",".join(fields))
    rows = doc.filter("doc is not null")

    def tidy(name: str) -> Column:
        outer, item, columns = SECTIONS[name]

        def one(x: Column) -> Column:
            return F.struct(*[_value(x[f"_{a.split()[0]}"], (a.split() + ["text"])[1]).alias(c) for c, a in columns.items()])

        out = F.transform(F.coalesce(F.col(f"doc.`{outer}`.{item}"), F.array()), one)
        return F.filter(out, lambda x: x["office"].isNotNull()) if name == "offices" else out

    place = {"sector": "_szektor", "row": "_sor", "seat": "_szek"}
    seat = F.struct(*[text.whole_number(F.col(f"doc.ulohely.{a}")).alias(c) for c, a in place.items()])
    return rows.select(
        "path", F.col("doc.nev").alias("name"), blank(F.col("doc.fenykep")).alias("photo"), blank(F.col("doc.honlap")).alias("website"), blank(F.col("doc.oneletrajz")).alias("biography"),
        blank(F.col("doc.iskolak.`legmagasabb-elismert`")).alias("highest_degree"), F.when(F.col("doc.ulohely").isNotNull(), seat).alias("seat"), *[tidy(s).alias(s) for s in SECTIONS],
    )


def section(records: DataFrame, name: str) -> DataFrame:
    """One section of the records as rows: path, its place in the record, its columns."""
    return records.select("path", F.posexplode(name).alias("ord", "__s")).select("path", "ord", "__s.*")


def spokespersons(payloads: DataFrame) -> DataFrame:
    """(path, member, name, nationality, photo, ord, list_label, place); those without an id are left out, no number goes last."""
    doc = parse(payloads, "szoszolo:array<struct<_p_azon:string,_nev:string,_nemzetiseg:string,_kep:string,_sorszam:string,_lista:string>>")
    s = doc.select("path", F.explode("doc.szoszolo").alias("s")).select("path", "s.*").filter(blank(F.col("_p_azon")).isNotNull())
    out = s.select(
        "path", F.col("_p_azon").alias("member"), blank(F.col("_nev")).alias("name"), blank(F.col("_nemzetiseg")).alias("nationality"), blank(F.col("_kep")).alias("photo"),
        text.whole_number(F.col("_sorszam")).alias("ord"), blank(F.col("_lista")).alias("list_label"),
    )
    turn = W.partitionBy("path").orderBy(F.coalesce("ord", F.lit(MOST_LISTED)), F.coalesce("name", F.lit("")), "member")  # a list has a dozen
    return out.withColumn("place", F.row_number().over(turn))


_SUB = "albizottsagok:struct<albizottsag:array<struct<_id:string,_title:string,_nev:string>>>"
_PERSON = "struct<_p_azon:string,_nev:string,_frakcio:string>"


def _subcommittees(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array()), lambda a: F.struct(a["_id"].alias("id"), F.coalesce(a["_title"], a["_nev"]).alias("title")))


def committee_list(payloads: DataFrame) -> DataFrame:
    """(path, id, title, subcommittees)."""
    doc = parse(payloads, f"bizottsag:array<struct<_id:string,_title:string,{_SUB}>>")
    b = doc.select("path", F.explode("doc.bizottsag").alias("b"))
    return b.select("path", F.col("b._id").alias("id"), F.col("b._title").alias("title"), _subcommittees(F.col("b.albizottsagok.albizottsag")).alias("subcommittees"))


def committees(payloads: DataFrame) -> DataFrame:
    """(path, name, type, created, parent, email, phone, chair, vice_chairs, members, subcommittees, next_meeting, next_meeting_url)."""
    doc = parse(payloads, (
        "_nev:string,_tipus:string,_letrehozas:string,fobizottsag:struct<_id:string,_nev:string>,elerhetoseg:struct<_email:string,_telefon:string>,"
        f"elnok:{_PERSON},alelnokok:struct<alelnok:array<{_PERSON}>>,tagok:struct<tag:array<{_PERSON}>>,{_SUB},meghivo_datum:string,meghivo_URL:string"
    )).filter("doc is not null").select("path", "doc.*")

    def person(x: Column) -> Column:
        return F.struct(blank(x["_p_azon"]).alias("member"), blank(x["_nev"]).alias("name"), blank(x["_frakcio"]).alias("grp"))

    everyone = lambda c: F.transform(F.coalesce(F.col(c), F.array()), person)
    parent = F.struct(F.col("fobizottsag._id").alias("id"), blank(F.col("fobizottsag._nev")).alias("name"))
    return doc.select(
        "path", F.col("_nev").alias("name"), blank(F.col("_tipus")).alias("type"), text.dotted_date(F.col("_letrehozas")).alias("created"),
        F.when(blank(F.col("fobizottsag._id")).isNotNull(), parent).alias("parent"), blank(F.col("elerhetoseg._email")).alias("email"), blank(F.col("elerhetoseg._telefon")).alias("phone"),
        F.when(F.col("elnok").isNotNull(), person(F.col("elnok"))).alias("chair"), everyone("alelnokok.alelnok").alias("vice_chairs"), everyone("tagok.tag").alias("members"),
        _subcommittees(F.col("albizottsagok.albizottsag")).alias("subcommittees"), text.dotted_date(F.col("meghivo_datum")).alias("next_meeting"), blank(F.col("meghivo_URL")).alias("next_meeting_url"),
    )


def submitter_kind(names: Column) -> Column:
    """Who submits: the government, a committee, an officer of the House ("other"), else members; null without a name.

    A president with a group in brackets is a member; the president by age never is.
    """
    joined = F.lower(F.array_join(names, " "))
    officer = joined.contains("korelnök") | (joined.contains("elnök") & ~joined.contains("("))
    kind = F.when(joined.startswith("kormány") | joined.contains("miniszter"), "kormany").when(joined.contains("bizottság"), "bizottsag").when(officer, "other")
    return F.when(F.size(names) > 0, kind.otherwise("kepviselo"))


def submitters(ind: DataFrame, many: str = "benyujtok", one: str = "benyujto") -> DataFrame:
    """``ind`` with ``names`` and ``ids`` of a motion's submitters.

    ``many`` is a struct of an array ``benyujto`` of (text, _href), whose links carry the id of a member in escaped JSON; ``one`` is a
    single submitter (_nev), who comes last and has no id.  Names that are empty, and links without an id, are left out.
    """
    several = F.coalesce(F.col(f"{many}.benyujto"), F.array().cast("array<struct<text:string,_href:string>>"))
    names = F.filter(F.transform(several, lambda x: x["text"]), lambda x: F.coalesce(x, F.lit("")) != "")
    ids = F.filter(F.transform(several, lambda x: F.regexp_extract(F.coalesce(x["_href"], F.lit("")), "%22id%22%3A%22([^%]+)%22", 1)), lambda x: x != "")
    single = F.filter(F.array(F.col(f"{one}._nev")), lambda x: F.coalesce(x, F.lit("")) != "")
    return ind.withColumns({"names": F.concat(names, single), "ids": ids})


def hrefs(c: Column) -> Column:
    """A property list's links as a map; of equal names the last one with a link holds."""
    linked = F.filter(F.coalesce(c, F.array().cast(f"array<{PROPERTY}>")), lambda t: F.coalesce(t["_href"], F.lit("")) != "")
    return properties(F.transform(linked, lambda t: F.struct(t["_nev"].alias("_nev"), t["_href"].alias("_ertek"), t["_href"].alias("_href"))))


_EVENT = "struct<datum:string,leiras:string,kapcsolodik:string,megjegyzes:string,felszolalas:string>"
_VOTED = "struct<datum:string,ok:string,igen_db:string,nem_db:string,tart_db:string,eredmeny:string>"
_SEEN_BY = "struct<bizottsag:array<struct<nev:string,jogcim:string,jogszab:string>>>"


def bills(payloads: DataFrame) -> DataFrame:
    """One row a bill: its properties, submitters, promulgation, events, votes and committees, and what follows from them.

    ``law`` only for a bill of the main type with a date and a Roman number; ``final_vote`` is the last vote whose
    outcome is about the bill itself; days from submission to it and to promulgation.
    """
    doc = parse(payloads, (
        f"_szam:string,_izon:string,cim:string,tulajdonsagok:struct<tulajdonsag:array<{PROPERTY}>>,esemenyek:struct<esemeny:array<{_EVENT}>>,"
        f"szavazasok:struct<szavazas:array<{_VOTED}>>,targyalo_bizottsagok:{_SEEN_BY},targyalao_bizottsagok:{_SEEN_BY}"
    )).filter("doc is not null").select("path", "doc.*")
    listed = F.col("tulajdonsagok.tulajdonsag")
    rows = doc.withColumns({"p": properties(listed), "h": hrefs(listed), "voted": F.coalesce("szavazasok.szavazas", F.array())})
    p = lambda name: blank(F.col("p")[name])
    names = F.filter(F.transform(F.split(F.coalesce(p("Benyújtó(k)"), F.lit("")), ","), F.trim), lambda x: x != "")
    mode = p("Tárgyalási mód")
    own = F.filter("voted", lambda v: F.startswith(F.coalesce(v["ok"], F.lit("")), F.lit("önálló indítvány")) & v["datum"].isNotNull())
    rows = rows.withColumns({
        "submitted_on": text.dotted_date(p("Benyújtva")), "promulgated_on": text.dotted_date(p("Kihirdetés dátuma")), "law_number": p("Kihirdetés száma"),
        "main_type": p("Főtípus"), "submitters": names, "final_vote": F.try_element_at(own, F.lit(-1))["datum"],
    })
    is_law = (F.col("main_type") == "törvényjavaslat") & F.col("law_number").rlike("^[IVXLCDM]+$")
    seen_by = F.coalesce("targyalao_bizottsagok.bizottsag", "targyalo_bizottsagok.bizottsag", F.array())
    return rows.select(
        "path", F.col("_szam").alias("iromany"), F.col("_izon").alias("izon"), *[c.alias(n) for n, c in text.motion_number(F.col("_szam")).items()], blank(F.col("cim")).alias("title"),
        p("Típus").alias("type"), "main_type", p("Jelleg").alias("nature"), p("Állapot").alias("status"), mode.alias("procedure"),
        F.when(mode.contains("kivételes"), "kiveteles").when(mode.contains("sürgős"), "surgos").when(mode.isNotNull(), "normal").alias("procedure_kind"),
        "submitted_on", "promulgated_on", "law_number", p("MK száma").alias("gazette"),
        F.when(is_law & F.col("promulgated_on").isNotNull(), F.concat(F.year("promulgated_on").cast("string"), F.lit(". évi "), F.col("law_number"), F.lit(". törvény"))).alias("law"),
        "submitters", submitter_kind(F.col("submitters")).alias("submitter_kind"), p("Címzett").alias("addressee"), p("Megjegyzés").alias("note"),
        F.col("h")["Irományszöveg"].alias("text_href"), blank(F.element_at(F.split(F.col("h")["Benyújtó(k)"], "/"), -1)).alias("submitter_id"),
        F.transform(F.coalesce("esemenyek.esemeny", F.array()), lambda e: F.struct(
            text.dotted_date(e["datum"]).alias("day"), blank(e["leiras"]).alias("text"), blank(e["kapcsolodik"]).alias("related"), blank(e["megjegyzes"]).alias("remark"), blank(e["felszolalas"]).alias("speech"),
        )).alias("events"),
        F.transform("voted", lambda v: F.struct(
            v["datum"].alias("vote"), blank(v["ok"]).alias("outcome"), text.whole_number(v["igen_db"]).alias("yes"), text.whole_number(v["nem_db"]).alias("no"),
            text.whole_number(v["tart_db"]).alias("abstain"), blank(v["eredmeny"]).alias("result"),
        )).alias("votes"),
        F.transform(seen_by, lambda c: F.struct(c["nev"].alias("name"), blank(c["jogcim"]).alias("role"), blank(c["jogszab"]).alias("rule"))).alias("committees"),
        "final_vote", F.datediff(text.dotted_date(F.substring("final_vote", 1, 10)), "submitted_on").alias("days_to_final_vote"), F.datediff("promulgated_on", "submitted_on").alias("days_to_promulgation"),
    )


def event_speeches(bills: DataFrame, speeches: DataFrame) -> DataFrame:
    """A bill's events that name a speech as "sitting/number", with that speech: (iromany, event, ulnap, seq, ...) ."""
    each = bills.select("iromany", F.posexplode("events").alias("event", "e"))
    part = lambda n: F.regexp_extract("e.speech", r"^\s*(\d+)/(\d+)\s*$", n).try_cast("int")
    return each.select("iromany", "event", part(1).alias("ulnap"), part(2).alias("seq")).filter("seq is not null").join(speeches, ["ulnap", "seq"])
