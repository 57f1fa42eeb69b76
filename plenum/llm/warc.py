"""WARC derivatives: metadata and plain-text conversion records of response records.

A record is a row: record_id, record_type, target_uri, warc_date, headers (all its named fields, in order, also those
that repeat) and block (its bytes).  ``read_warc`` gets such rows from WARC files (plain, or gzip members), ``responses`` builds
them from a table of pages, ``derive`` makes for each response

- a ``metadata`` record (application/warc-fields) with the HTTP status, every HTTP header of the source,
  the source's digests, the title and the links in their order, and
- a ``conversion`` record (text/plain) with the text of an HTML or plain-text payload.

Both name the response in WARC-Refers-To, with its target URI and date, and carry their own block digest;
the conversion is also WARC-Concurrent-To the metadata record, so the three are linked.  Record ids
follow from the source's id and the kind, so a second run gives the same records.

Cases: a null block is empty; a block without a blank line is a payload without HTTP headers.  A digest that
the source states is kept as it is, even if wrong; one that it doesn't state is worked out.  A payload that is
no text (by its content type) gets a metadata record only.  Bytes that aren't in the charset that the source
names (else UTF-8) become the replacement character.  A null id gets an id from the block.  A null URI gives
no URI field.  Rows that repeat give repeated records.  An empty table gives none.  Damaged files give the records that
can be read (see ``parse``).  Chunked and compressed payloads are decoded for the text; digests are of what was sent.
Other columns are left out, but for those that ``derive`` is told to ``keep``; names of a record's there are a ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm.common import cut, small

RECORD = "record_id string, record_type string, target_uri string, warc_date string, headers array<struct<name:string,value:string>>, block binary"
DERIVED = RECORD + ", refers_to string, record binary"
_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()),
])
_ARROW_DERIVED = _ARROW.append(pa.field("refers_to", pa.string())).append(pa.field("record", pa.binary()))
_ARROW_PIECE = _ARROW.append(pa.field("file", pa.string())).append(pa.field("whole", pa.bool_()))
#: What ends a record when another one follows.
_BETWEEN = b"\r\n\r\nWARC/"
_SPACE = uuid.UUID("6f0f7c52-9f0e-5b53-8f5e-2f6f4f2f7a10")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _unpacked(raw: bytes) -> bytes:
    """The bytes of all gzip members; of a member that is cut off or damaged, what can be read before that."""
    out, at = [], raw
    while at[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(at))
        except zlib.error:
            break
        at = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(raw: bytes) -> Iterator[dict]:
    """The records of one WARC file.

    Names of fields are read in any case, fields that repeat or go on in a next line are kept.  A record without a length that
    can be read goes up to the next record; one that is cut off has the bytes that are there.
    """
    if raw[:2] == b"\x1f\x8b":
        raw = _unpacked(raw)
    at = 0
    while (start := raw.find(b"WARC/", at)) >= 0:
        end = raw.find(b"\r\n\r\n", start)
        if end < 0:
            return
        fields: list[tuple[str, str]] = []
        for line in raw[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if line[:1] in (" ", "\t") and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}".strip())
            elif colon:
                fields.append((name.strip(), value.strip()))
        first = {n.lower(): v for n, v in reversed(fields)}
        size = first.get("content-length", "")
        if size.isascii() and size.isdigit():
            stop = end + 4 + int(size)
        else:
            nxt = raw.find(b"\r\n\r\nWARC/", end + 4)
            stop = nxt if nxt >= 0 else len(raw)
        yield {
            "record_id": first.get("warc-record-id"), "record_type": (first.get("warc-type") or "").lower() or None, "target_uri": first.get("warc-target-uri"),
            "warc_date": first.get("warc-date"), "headers": fields, "block": raw[end + 4 : stop],
        }
        at = stop


def _piece(raw: bytes) -> Iterator[dict]:
    """The record that a piece of a file begins with, and whether it is whole: as long as it says, and all there is."""
    for record in parse(raw + b"\r\n\r\n"):
        first = {n.lower(): v for n, v in reversed(record["headers"])}
        size = first.get("content-length", "")
        stated = int(size) if size.isascii() and size.isdigit() else -1
        rest = raw[raw.find(b"\r\n\r\n") + 4 + max(0, stated) :] if stated >= 0 else b""
        yield _named(record) | {"whole": len(record["block"]) == stated and not rest.strip(b"\r\n")}
        return


def _named(record: dict) -> dict:
    return record | {"headers": [{"name": n, "value": v} for n, v in record["headers"]]}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files below ``path``, of any size.

    Files are cut where a record can begin (``_BETWEEN``), so a large plain file is read by many tasks and a compressed one by one
    task that streams.  Where a block has such bytes itself, its record lacks some: only files with such a record, or one that is cut off
    or has no length, are read again as wholes (they then must be below 2 GiB).  A damaged compressed file gives what can be read of it.
    """
    files = spark.read.option("lineSep", _BETWEEN.decode("latin-1")).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    # a string of this reader has the file's bytes, whatever they are
    pieces = files.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))

    def run(batches):
        for batch in batches:
            for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece"), strict=True):
                raw = piece.as_py()
                raw = raw if b"WARC/" in raw[: len(_BETWEEN) + 1] else b"WARC/" + raw
                yield pa.RecordBatch.from_pylist([x | {"file": file} for x in _piece(raw)], _ARROW_PIECE)

    read = cut(pieces.mapInArrow(run, RECORD + ", file string, whole boolean"), "warc")
    torn = cut(read.filter("not whole").select(F.col("file").alias("torn")).distinct(), "torn")
    n = torn.count()
    own = [f.name for f in _ARROW]
    if not n:
        return read.select(*own)

    def again(batches):
        for batch in batches:
            for raw in batch.column("content"):
                for record in parse(raw.as_py()):
                    yield pa.RecordBatch.from_pylist([_named(record)], _ARROW)

    side = small(torn, n)
    wholes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"), "content")
    wholes = wholes.join(side, F.col("file") == F.col("torn"), "left_semi").select("content").mapInArrow(again, RECORD)
    return read.join(side, F.col("file") == F.col("torn"), "left_anti").select(*own).unionByName(wholes)


def responses(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages, with the key column ``page_id``."""
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head.cast("binary"), body)
    key, uri = F.col(f"`{id_col}`").cast("long"), F.col(f"`{url_col}`").cast("string")
    name = F.sha2(F.concat_ws("\n", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(uri, F.lit("")), F.md5(body)), 256)
    fields = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        key.alias("page_id"),
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *fields), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        uri.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.array(F.struct(F.lit("Content-Type").alias("name"), F.lit("application/http; msgtype=response").alias("value"))).alias("headers"),
        block.alias("block"),
    )


# -- one response ------------------------------------------------------------------------------

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main"
    r"|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^<>]*>", re.I,
)
_TAG = re.compile(r"<[a-z/!?][^<>]*>", re.I)
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_HREF = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"<>]*)\"|'([^'<>]*)'|([^\s\"'<>]+))", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def text_of(page: str) -> str:
    """The visible text of a page, one line for each block, blanks collapsed."""
    page = _TITLE.sub("", _HIDDEN.sub("", page))
    page = html.unescape(_TAG.sub("", _BREAK.sub("\n", page.replace("\r", " ").replace("\n", " "))))
    return _LINES.sub("\n", _BLANKS.sub(" ", page)).strip()


def title_of(page: str) -> str:
    m = _TITLE.search(_HIDDEN.sub("", page))
    return " ".join(html.unescape(_TAG.sub("", m.group(1))).split()) if m else ""


def links_of(page: str) -> list[str]:
    return [html.unescape(next(x for x in m.groups() if x is not None)).strip() for m in _HREF.finditer(_HIDDEN.sub("", page))]


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    pairs = [(n.strip(), v.strip()) for n, c, v in (x.partition(":") for x in lines[1:]) if c]
    return lines[0], pairs, payload


def decoded(http: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content coding (chunks, gzip, deflate), as far as it can be read."""
    named = lambda name: " ".join(v.lower() for n, v in http if n.lower() == name)
    if "chunked" in named("transfer-encoding"):
        parts, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not size or size.strip(b"0123456789abcdefABCDEF"):
                parts.append(payload[at:])  # not in chunks, whatever the header says
                break
            if not int(size, 16):
                break
            parts.append(payload[end + 2 : end + 2 + int(size, 16)])
            at = end + 4 + int(size, 16)
        payload = b"".join(parts) or payload
    coding = named("content-encoding")
    if "gzip" in coding and payload[:2] == b"\x1f\x8b":
        return _unpacked(payload)
    if "deflate" in coding:
        for bits in (15, -15):
            try:
                return zlib.decompress(payload, bits)
            except zlib.error:
                pass
    return payload


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _record(kind: str, source: dict, content_type: str, block: bytes, more: list[tuple[str, str]]) -> dict:
    name = source["record_id"] or digest(source["block"] or b"")
    record_id = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {name}')}>"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id)]
    fields += [("WARC-Date", source["warc_date"])] if source["warc_date"] else []
    fields += [("WARC-Target-URI", _one_line(source["target_uri"]))] if source["target_uri"] else []
    if source["record_id"]:
        fields.append(("WARC-Refers-To", source["record_id"]))
        fields += [("WARC-Refers-To-Target-URI", _one_line(source["target_uri"]))] if source["target_uri"] else []
        fields += [("WARC-Refers-To-Date", source["warc_date"])] if source["warc_date"] else []
    fields += [*more, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields) + "\r\n"
    return {
        "record_id": record_id, "record_type": kind, "target_uri": source["target_uri"], "warc_date": source["warc_date"],
        "headers": fields, "block": block, "refers_to": source["record_id"], "record": head.encode() + block + b"\r\n\r\n",
    }


def derive_one(source: dict) -> list[dict]:
    """The metadata record of a response and, for text, its conversion record."""
    block = source["block"] or b""
    stated = [(h["name"], h["value"] or "") for h in source["headers"] or [] if h and h["name"]]
    digests = {n.lower(): v for n, v in reversed(stated)}
    status, http, payload = split_http(block)
    plain = decoded(http, payload)
    kinds = [v for n, v in http if n.lower() == "content-type"] or ["text/html"]
    is_html, is_text = "html" in kinds[0].lower(), kinds[0].lower().startswith("text/") or "html" in kinds[0].lower()
    found = _CHARSET.search(kinds[0])
    try:
        page = plain.decode(found.group(1) if found else "utf-8", "replace") if is_text else ""
    except LookupError:
        page = plain.decode("utf-8", "replace")
    lines = [("httpStatus", status)] if status else []
    lines += [(f"httpHeader-{n}", v) for n, v in http]
    lines.append(("sourceBlockDigest", digests.get("warc-block-digest") or digest(block)))
    lines.append(("sourcePayloadDigest", digests.get("warc-payload-digest") or digest(payload)))
    lines += [(f"sourceHeader-{n}", v) for n, v in stated if not n.lower().endswith("-digest")]
    if is_html:
        title = title_of(page)
        lines += [("title", title)] if title else []
        lines += [("outlink", f"{x} L a/@href") for x in links_of(page)]
    body = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in lines).encode()
    meta = _record("metadata", source, "application/warc-fields", body, [])
    if not is_text:
        return [meta]
    text = (text_of(page) if is_html else page).encode()
    more = [("WARC-Concurrent-To", meta["record_id"]), ("WARC-Payload-Digest", digest(text)), ("WARC-Source-Payload-Digest", dict(lines)["sourcePayloadDigest"])]
    return [meta, _record("conversion", source, "text/plain; charset=utf-8", text, more)]


def derive(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derivatives of the response records among ``records``; columns in ``keep`` are handed on."""
    kept = [f for f in records.schema if f.name in keep]
    own = [f.name for f in _ARROW]
    if clash := set(keep) & set(_ARROW_DERIVED.names):
        raise ValueError(f"columns to keep have names of a record's: {sorted(clash)}")
    picked = records.filter("record_type = 'response'").select(*own, *[f.name for f in kept])
    schema = DERIVED + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 128):
                part = batch.slice(k, 128)
                made, at = [], []
                for i, source in enumerate(part.select(own).to_pylist()):
                    new = derive_one(source)
                    made += map(_named, new)
                    at += [i] * len(new)
                out = pa.RecordBatch.from_pylist(made, _ARROW_DERIVED)
                rows = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *[part.column(f.name).take(rows) for f in kept]], [*_ARROW_DERIVED.names, *[f.name for f in kept]]
                )

    return picked.mapInArrow(run, schema)


def pages_to_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, content_length, block_digest, record."""
    made = derive(responses(pages, date), keep=("page_id",))
    return made.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri",
        F.octet_length("block").cast("long").alias("content_length"),
        F.get(F.filter("headers", lambda h: h["name"] == "WARC-Block-Digest"), F.lit(0))["value"].alias("block_digest"), "record",
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Write the ``record`` bytes to WARC files below ``path``, in any store: one file for each partition."""
    ends = b"\r\n\r\n".decode()
    body = F.substring("record", F.lit(1), F.octet_length("record") - len(ends)).cast("string")  # bytes stay as they are
    records.select(body.alias("value")).write.option("lineSep", ends).text(path)


def save(records: DataFrame, path: str) -> int:
    """Write the ``record`` bytes to one local WARC file, streaming partition by partition; for small exports."""
    n = 0
    with open(path, "wb") as f:
        for row in records.select("record").toLocalIterator():
            f.write(bytes(row.record))
            n += 1
    return n
