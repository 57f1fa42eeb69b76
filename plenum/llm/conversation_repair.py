"""Repair of the structure of conversations: the cheapest edits that make the roles alternate.

Each conversation becomes a signature, one character a row: what its role begins with (s, u, a or other) and its first
fault (none, must go, truncated).  Millions of conversations share few signatures, so each distinct signature is solved
once; audits (strings of edits) are joined back and replayed on the rows.

A signature is solved by recursion over its halves, memoised on (piece, what follows): what follows a piece matters only
through four numbers, the cost of the rest from each state, less their minimum.  So pieces that many signatures share are
solved once, and the depth of the recursion is the logarithm of the length.

Texts never make a group in memory: flags and digests are worked out row by row, and both passes stream rows that Spark has
sorted by conversation and turn.  The first pass keeps one character a row and a digest of each distinct row of the
conversation at hand, the second only the row at hand, since the digest of a repaired conversation grows with it.  The join
is a sort-merge join on the signature, whose hot keys adaptive execution splits.

Cases: rows are ordered by turn (nulls first), rows of one turn by role, the
first 64 characters of the text and its SHA-256, so equal rows are neighbours; a null role or text is
one space; a null conv_id is a conversation of its own; a conversation without rows has an empty audit; an empty table gives
an empty result.  Only the four columns named are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
PRICES = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
#: States of what has been given so far: nothing, a system row, a user row, an assistant row.  After which edit a row of a
#: role may follow, and which role a rerole or an insertion has there.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: A row's character: the place of its role in "suao" and its fault, of 0 none, 1 blank, 2 duplicate, 3 truncated.
ROLES = "suao"
SYMBOLS = "abcdefghijklmnop"
#: What may stand at the end: nothing or an assistant row; a user row takes one insertion more.
END = ((0, ""), (6, "II"), (3, "I"), (0, ""))


def symbol(role: str, fault: int) -> str:
    first = role[:1]
    return SYMBOLS[ROLES.index(first if first and first in "sua" else "o") * 4 + fault]


@lru_cache(maxsize=100_000)
def _before(row: str, tail: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """For each state before ``row``: the least cost of it and what follows, its ASCII-least edits, and the state after."""
    role, fault = divmod(SYMBOLS.index(row), 4)
    options: list[list[tuple[int, str, int]]] = []
    for state in range(4):
        some = [(PRICES[DELETE] + tail[state], DELETE, state)]
        if fault not in (1, 2):
            more = TRUNCATED if fault == 3 else 0
            if state in FOLLOWS[ROLES[role]]:
                after = FOLLOWS[ROLES[role]][state]
                some.append((PRICES[KEEP] + more + tail[after], KEEP, after))
            some.append((PRICES[REROLE] + more + tail[NEXT[state]], REROLE, NEXT[state]))
        options.append(some)
    best = [min(x) for x in options]
    for _ in range(2):  # a third insertion in a row is back where one would have led
        best = [min(best[s], (PRICES[INSERT] + best[NEXT[s]][0], INSERT + best[NEXT[s]][1], best[NEXT[s]][2])) for s in range(4)]
    return tuple(x[0] for x in best), tuple((x[1], x[2]) for x in best)


@lru_cache(maxsize=20_000)
def _piece(piece: str, tail: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """(offset, costs less the offset, (edits, state after) from each state) of a piece before a tail."""
    if len(piece) == 1:
        costs, ways = _before(piece, tail)
        low = min(costs)
        return low, tuple(x - low for x in costs), ways
    middle = len(piece) // 2
    solve = _piece if len(piece) <= 128 else _piece.__wrapped__  # long pieces are rarely seen again
    right, between, later = solve(piece[middle:], tail)
    left, costs, sooner = solve(piece[:middle], between)
    return left + right, costs, tuple((edits + later[s][0], later[s][1]) for edits, s in sooner)


def solve(signature: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits; of equally cheap ones the ASCII-least audit."""
    if not signature:
        return 0, ""
    whole = _piece if len(signature) <= 128 else _piece.__wrapped__
    offset, costs, ways = whole(signature, tuple(x for x, _ in END))
    edits, state = ways[START]
    return offset + costs[START], edits + END[state][1]


def replay(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) for each row that stays or is new, in order."""
    edits, state = iter(audit), START
    for role, text in rows:
        for edit in edits:
            if edit == DELETE:
                break
            if edit == KEEP:
                state = FOLLOWS[role[:1]][state]
                yield edit, role, text
                break
            state = NEXT[state]
            yield edit, ROLE_OF[state], text if edit == REROLE else ""
            if edit == REROLE:
                break
    for edit in edits:
        state = NEXT[state]
        yield edit, ROLE_OF[state], ""


_SPACE = r"\x20\x09-\x0D"


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text): nulls of the last two are one space."""
    words = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text")))
    return rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), *words)


def _start() -> Column:
    """By this and then a digest are rows of one turn and role ordered: sorting need not carry whole texts."""
    return F.substring("text", 1, 64)


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv").sortWithinPartitions("conv", *order)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with the faults of a fixed draw: crc32 of ``conv:turn`` (a null is one space) modulo 20 tells which.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = _rows(rows, conv, turn, role, text).withColumn("fate", F.crc32(F.concat(word("conv"), F.lit(":"), word("turn"))) % 20)
    fate: Column = F.col("fate")
    return drawn.filter("fate <> 0").select(
        "conv", "turn",
        F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def signatures(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: DataFrame | None = None) -> DataFrame:
    """(conv, signature, gaps): one row a conversation of ``rows``, and of ``every`` (its conversations without rows too)."""
    full = _rows(rows, conv, turn, role, text)
    narrow = full.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("digest"),
        (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("open"),
        F.lit(True).alias("real"),
        _start().alias("start"),
    )
    if every is not None:
        ids = every.select(F.col(f"`{conv}`").cast("long").alias("conv")).distinct()
        narrow = narrow.unionByName(ids.withColumn("real", F.lit(False)), allowMissingColumns=True)
    narrow = _sorted(narrow, "turn", "role", "start", "digest").drop("start")
    schema = "conv long, signature string, gaps long"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, signs, seen, turns = None, [], set(), []

        def close() -> None:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((at[0], "".join(signs), gaps))

        for batch in batches:
            for c, t, who, digest, blank, open_, real in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if at is None or at[0] != c:
                    if at is not None:
                        close()
                    at, signs, seen, turns = (c,), [], set(), []
                if not real:
                    continue
                row = hashlib.blake2b(f"{digest}{who}".encode(errors="surrogatepass"), digest_size=16).digest()
                signs.append(symbol(who, 1 if blank else 2 if row in seen else 3 if open_ else 0))
                seen.add(row)
                if t is not None:
                    if not turns:
                        turns = [t, t, 1]
                    elif t != turns[1]:
                        turns = [turns[0], t, turns[2] + 1]
            if len(done) > 10_000:
                yield _batch(done, _SIGNED)
                done = []
        if at is not None:
            close()
        if done:
            yield _batch(done, _SIGNED)

    return narrow.select("conv", "turn", "role", "digest", "blank", "open", "real").mapInArrow(stream, schema)


_SIGNED = pa.schema([("conv", pa.int64()), ("signature", pa.string()), ("gaps", pa.int64())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")
_SOLVED = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _facts(signature: str) -> tuple:
    faults = [SYMBOLS.index(x) % 4 for x in signature]
    roles = "".join(ROLES[SYMBOLS.index(x) // 4] for x in signature)
    illegal = sum(roles[k : k + 2] not in ("su", "ua", "au") for k in range(len(roles) - 1))
    cost, audit = solve(signature)
    return signature, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit


def audits(signed: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): every distinct signature solved once and joined back."""
    parts = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch([_facts(x) for x in batch.column(0).to_pylist()], _SOLVED)

    schema = "signature string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    solved = signed.select("signature").distinct().repartition(parts).mapInArrow(each, schema)
    return signed.join(solved, "signature").select("conv", "gaps", *_COUNTS, "audit")


def _replayed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows below the audit of their conversation: (conv, turn, role, text, audit), the audit's row first with head true."""
    head = audited.select("conv", F.lit(True).alias("head"), *[c for c in audited.columns if c != "conv"])
    both = head.unionByName(rows.withColumn("head", F.lit(False)), allowMissingColumns=True)
    both = both.withColumns({"body": ~F.col("head"), "start": _start(), "digest": F.sha2("text", 256)})
    return _sorted(both, "body", "turn", "role", "start", "digest").drop("body", "start", "digest")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's head, and its rows one at a time; the rows have to be taken before the next head."""
    flow = (row for batch in batches for row in batch.to_pylist())
    ahead: list[dict] = []

    def body() -> Iterator[tuple[str, str]]:
        for row in flow:
            if row["head"]:
                ahead.append(row)
                return
            yield row["role"], row["text"]

    ahead.extend([row] if (row := next(flow, None)) else [])
    while ahead:
        yield ahead.pop(), body()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, edit, role, text): the rows of the repaired conversations, numbered from 0 in each."""
    full = _rows(rows, conv, turn, role, text)
    audited = audits(signatures(full, "conv", "turn", "role", "text")).select("conv", "audit")
    schema = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for head, body in _conversations(batches):
            for place, row in enumerate(replay(body, head["audit"])):
                done.append((head["conv"], place, *row))
                if len(done) >= 1000:
                    yield _batch(done, schema)
                    done = []
        if done:
            yield _batch(done, schema)

    return _replayed(full, audited).mapInArrow(stream, "conv long, place long, edit string, role string, text string")


def digests(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", every: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): one row a conversation."""
    full = _rows(rows, conv, turn, role, text)
    every = every if every is None else every.select(F.col(f"`{conv}`").alias("conv"))
    audited = audits(signatures(full, "conv", "turn", "role", "text", every))
    names = ["gaps", *_COUNTS, "audit"]
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in names[:-1]), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for head, body in _conversations(batches):
            digest = hashlib.sha256()
            for place, (_, who, words) in enumerate(replay(body, head["audit"])):
                digest.update(f"{chr(10) if place else ''}{who}:{words}".encode(errors="surrogatepass"))
            done.append((head["conv"], *(head[c] for c in names), digest.hexdigest()))
            if len(done) >= 10_000:
                yield _batch(done, schema)
                done = []
        if done:
            yield _batch(done, schema)

    out = "conv_id long, " + ", ".join(f"{c} long" for c in names[:-1]) + ", audit string, repaired_sha256 string"
    return _replayed(full, audited).mapInArrow(stream, out)
