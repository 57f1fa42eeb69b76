"""Majority rules as Column expressions: base, threshold, verdict, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven rules, in the order in which they are listed, with the base each is counted on.
RULES: dict[str, str] = {
    "egyszeru": "present",
    "abszolut": "seats",
    "ketharmad_jelenlevo": "present",
    "ketharmad_osszes": "seats",
    "negyotod_jelenlevo": "present",
    "negyotod_osszes": "seats",
    "relativ": "candidates",
}

# Phrases of a vote's stated mode, looked for in this order, and the rule each one states.
STATED: list[tuple[str, str]] = [
    ("a jelenlevők 2/3-ával", "ketharmad_jelenlevo"),
    ("az összes képviselő 2/3-ával", "ketharmad_osszes"),
    ("az összes képviselő felével", "abszolut"),
    ("a jelenlevők 4/5-ével", "negyotod_jelenlevo"),
    ("az összes képviselő 4/5-ével", "negyotod_osszes"),
    ("listás", "egyszeru"),
    ("titkos", "egyszeru"),
    ("egyszerű többség", "egyszeru"),
    ("abszolút többség", "abszolut"),
    ("jelen lévő képviselők kétharmada", "ketharmad_jelenlevo"),
    ("jelenlévő képviselők kétharmada", "ketharmad_jelenlevo"),
    ("országgyűlési képviselők kétharmada", "ketharmad_osszes"),
    ("összes képviselő kétharmada", "ketharmad_osszes"),
    ("jelen lévő képviselők négyötöde", "negyotod_jelenlevo"),
    ("minősített többség", "ketharmad_jelenlevo"),
]

# Patterns over kind, subject and title, looked for in this order, and the rule each one suggests.
SUGGESTED: list[tuple[str, str]] = [
    (r"házszabálytól (?:való )?eltérés", "negyotod_jelenlevo"),
    (r"alaptörvény[^,;]{0,40}módosít|módosít[^,;]{0,40}alaptörvény|alaptörvény[^,;]{0,20}elfogad", "ketharmad_osszes"),
    (r"alkotmánybír[áo]|kúria elnök|legfőbb ügyész|alapvető jogok biztos|állami számvevőszék elnök", "ketharmad_osszes"),
    (r"köztársasági elnök[^,;]{0,40}(?:választ|megválaszt)", "ketharmad_osszes"),
    (r"miniszterelnök[^,;]{0,40}(?:választ|megválaszt)|bizalmatlansági|bizalmi szavazás", "abszolut"),
    (r"kivételes eljárás", "abszolut"),
    (r"sürgős(?:ségi)? tárgyalás|sürgős tárgyalásb", "ketharmad_jelenlevo"),
    (r"sarkalatos|minősített többség|kétharmad|két ?harmad|2/3", "ketharmad_jelenlevo"),
    (r"házszabály[^,;]{0,30}(?:elfogad|módosít)", "ketharmad_jelenlevo"),
]


def _lookup(rule: Column, table: dict[str, Column]) -> Column:
    out = None
    for name, value in table.items():
        out = F.when(rule == name, value) if out is None else out.when(rule == name, value)
    return out


def base(rule: Column, present: Column, seats: Column) -> Column:
    """What a rule counts on; null for a plurality among candidates or an unknown rule."""
    kinds = {"present": present.cast("long"), "seats": seats.cast("long"), "candidates": F.lit(None).cast("long")}
    return _lookup(rule, {r: kinds[k] for r, k in RULES.items()})


def needed(rule: Column, n: Column) -> Column:
    """Votes that a rule needs on a base of n, in whole numbers."""
    n = n.cast("long")
    half = (n - n % 2) / 2 + 1
    thirds, fifths = 2 * n + 2, 4 * n + 4
    return (
        F.when(rule.isin("egyszeru", "abszolut"), half)
        .when(rule.isin("ketharmad_jelenlevo", "ketharmad_osszes"), (thirds - thirds % 3) / 3)
        .when(rule.isin("negyotod_jelenlevo", "negyotod_osszes"), (fifths - fifths % 5) / 5)
        .cast("long")
    )


def present_or_cast(present: Column, yes: Column, no: Column, abstain: Column) -> Column:
    """The stated number of those present, else the votes cast."""
    return F.coalesce(present.cast("long"), (yes + no + abstain).cast("long"))


def verdict(rule: Column, yes: Column, present: Column, seats: Column) -> dict[str, Column]:
    """base, needed, margin and passed; an empty base never passes, a plurality has no verdict."""
    n = base(rule, present, seats)
    need = needed(rule, n)
    return {"base": n, "needed": need, "margin": yes.cast("long") - need, "passed": (n > 0) & (yes >= need)}


def tally_error(yes: Column, no: Column, abstain: Column, present: Column, seats: Column) -> Column:
    """Why a tally can't be: null where it can."""
    cast = yes + no + abstain
    return (
        F.when(F.least(yes, no, abstain, F.coalesce(present, F.lit(0)), seats) < 0, "negative")
        .when(present < cast, "present below cast")
        .when((present > seats) | (cast > seats), "above seats")
    )


def agrees(computed: Column, recorded: Column) -> Column:
    """Null unless both sides are known."""
    return F.when(computed.isNotNull() & recorded.isNotNull(), computed == recorded)


def classify(stated: Column, kind: Column, subject: Column, title: Column) -> dict[str, Column]:
    """rule, source (payload, keyword or default) and evidence of a vote."""
    mode = F.lower(F.coalesce(stated, F.lit("")))
    by_mode = None
    for phrase, rule in STATED:
        hit = mode.contains(phrase)
        by_mode = F.when(hit, rule) if by_mode is None else by_mode.when(hit, rule)
    text = F.lower(F.concat_ws(" | ", *[F.when(c != "", c) for c in (kind, subject, title)]))
    by_word, evidence = None, None
    for pattern, rule in SUGGESTED:
        hit, found = text.rlike(pattern), F.regexp_extract(text, pattern, 0)
        by_word = F.when(hit, rule) if by_word is None else by_word.when(hit, rule)
        evidence = F.when(hit, found) if evidence is None else evidence.when(hit, found)
    return {
        "rule": F.coalesce(by_mode, by_word, F.lit("egyszeru")),
        "source": F.when(by_mode.isNotNull(), "payload").when(by_word.isNotNull(), "keyword").otherwise("default"),
        "evidence": F.when(by_mode.isNotNull(), stated).otherwise(F.coalesce(evidence, F.lit(""))),
    }
