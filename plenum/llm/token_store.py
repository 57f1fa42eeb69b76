"""Token-id files: short zstandard frames with a shared dictionary and an offset index.

A store is a folder with three Parquet tables.

- ``dictionary``: one row (dict_hash, dictionary, width): the dictionary, trained on serialised id arrays,
  its sha256, and the bytes of a serialised id (2 or 4, little-endian unsigned).
- ``blocks``: rows (shard, start, n_tokens, first_id, last_id, dict_hash, doc_ids, counts, ends, frames).
  A block holds the frames of consecutive documents; each frame is one document's ids, compressed by
  itself.  ``ends`` is the index: document k lies in ``frames[ends[k - 1]:ends[k]]``.  ``start`` counts the
  ids of the blocks before it in the same shard.
- ``shards``: rows (shard, start): ids of all the shards before.

Reading one document prunes blocks by first_id and last_id, then decompresses one frame.  Shards are ranges
of doc_id, and documents ascend in each.  The files are written by Spark's committer, so a lost
executor leaves no half a shard and any store that Spark reaches will do.

Cases: a null text is empty.  A null doc_id comes before all others.  Rows that repeat a doc_id are
neighbours, in the order of their compressed frames.  An empty table gives a store without blocks.
A document of any length is one frame; a block is closed once it holds ``BLOCK`` bytes.
Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import pieces
from plenum.llm.common import documents

BLOCK = 1 << 20
#: The dictionary is trained on at most so many documents, and runs of at most so many ids, those with the smallest hashes.
TRAIN_DOCS, TRAIN_RUNS, TRAIN_IDS, DICTIONARY_BYTES = 500, 1500, 2048, 64 << 10
LEVEL = 3
#: Text of one shard, shards at most (beyond, they grow), and ranges of ids whose bytes are counted at a time.
SHARD_BYTES, SHARDS, CELLS = 16 << 20, 100_000, 100_000
FRAME = "doc_id long, shard int, n_tokens long, frame binary"
BLOCKS = (
    "shard int, start long, n_tokens long, first_id long, last_id long, dict_hash string, "
    "doc_ids array<long>, counts array<long>, ends array<long>, frames binary"
)


class WordEncoder:
    """A tokenizer file of the ``tokenizers`` library that normalises white space away."""

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if max(tok.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.width).tobytes()
        self.cache = pieces.PieceCache(
            lambda part: [np.array(e.ids, self.width).tobytes() for e in tok.encode_batch_fast(part, add_special_tokens=False)]
        )

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        return [x + self.end for x in self.cache.texts([pieces.words(t) for t in texts])]


@functools.lru_cache(maxsize=2)
def load(path: str, end_id: int | None) -> WordEncoder:
    return WordEncoder(path, end_id)


def _rows(batch: pa.RecordBatch, at_once: int = 512) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
    for k in range(0, len(ids), at_once):
        yield ids.slice(k, at_once).to_pylist(), texts.slice(k, at_once).to_pylist()


def train_dictionary(docs: DataFrame, path: str, end_id: int | None) -> bytes:
    """A dictionary from runs of ids of documents all over the table; empty where there is too little."""
    picked = docs.select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text").orderBy("h").limit(TRAIN_DOCS)

    def run(batches):
        enc = load(path, end_id)
        for batch in batches:
            for _, texts in _rows(batch):
                step = TRAIN_IDS * enc.width.itemsize
                runs = [x[i : i + step] for x in enc.encode_batch(texts) for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary())], ["run"])

    runs = picked.select("doc_id", "text").mapInArrow(run, "run binary").orderBy(F.xxhash64("run"), "run").limit(TRAIN_RUNS)
    samples = [bytes(r.run) for r in runs.collect()]
    if len(samples) < 8 or sum(map(len, samples)) < 1 << 12:
        return b""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def _shard_bounds(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Ranges of doc_id with about ``SHARD_BYTES`` of text each: the first id of each but the first, at most ``SHARDS`` - 1.

    Bytes are summed up by ranges of ids (``CELLS`` of equal width, a bounded number), and again inside cells that are too
    heavy, until no range is too heavy or has one id; so neither quantiles nor ids gather on the driver.
    """
    row = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()
    n_shards = min(SHARDS, max(1, -(-row.n // SHARD_BYTES)))
    if n_shards == 1 or row.a is None or row.a == row.z:
        return np.zeros(0, np.int64), 1
    most = row.n / n_shards
    cells: dict[tuple[int, int], int] = {}  # (first id, last id) -> bytes
    heavy = [(row.a, row.z)]
    while heavy:
        width = [max(1, -(-(z - a + 1) * len(heavy) // min(CELLS, 64 * n_shards))) for a, z in heavy]
        k = F.lit(None).cast("int")
        for i, (a, z) in enumerate(heavy):
            k = F.when(F.col("doc_id").between(a, z), i).otherwise(k)
        first, step = (F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("k") + 1) for xs in ([a for a, _ in heavy], width))
        found = docs.select("doc_id", F.octet_length("text").cast("long").alias("n"), k.alias("k")).filter("k is not null")
        found = found.groupBy("k", F.floor((F.col("doc_id").cast("decimal(20,0)") - first.cast("decimal(20,0)")) / step.cast("decimal(20,0)")).cast("long").alias("cell")).agg(F.sum("n").alias("n")).collect()  # CELLS + len(heavy) rows at most
        again = []
        for r in found:
            a = heavy[r.k][0] + r.cell * width[r.k]
            z = min(heavy[r.k][1], a + width[r.k] - 1)
            if r.n > 2 * most and z > a and len(again) < 200:
                again.append((a, z))
            else:
                cells[a, z] = r.n
        heavy = again
    bounds, held = [], 0
    for (a, _), n in sorted(cells.items()):
        if held and held + n > most:
            bounds.append(a)
            held = 0
        held += n
    return np.array(bounds, np.int64), len(bounds) + 1


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_store(
    docs: DataFrame, out: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text by the tokenizer file ``path``, append ``end_id`` and write the store ``out``."""
    spark = docs.sparkSession
    docs = documents(docs, id_col, text_col)
    dictionary = train_dictionary(docs, path, end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    shipped = spark.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most
    bounds, n_shards = _shard_bounds(docs)

    def frames(batches):
        enc = load(path, end_id)
        codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **_codec(shipped.value))
        for batch in batches:
            for ids, texts in _rows(batch):
                packed = enc.encode_batch(texts)
                shard = [0 if i is None else int(np.searchsorted(bounds, i, side="right")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(shard, pa.int32()),
                        pa.array([len(x) // enc.width.itemsize for x in packed], pa.int64()),
                        pa.array([codec.compress(x) for x in packed], pa.binary()),
                    ],
                    ["doc_id", "shard", "n_tokens", "frame"],
                )

    def blocks(batches):
        start, held, size, shard = 0, [], 0, -1

        def block():
            nonlocal start
            n = sum(x[1] for x in held)
            row = {
                "shard": shard, "start": start, "n_tokens": n, "first_id": held[0][0], "last_id": held[-1][0],
                "dict_hash": dict_hash, "doc_ids": [x[0] for x in held], "counts": [x[1] for x in held],
                "ends": np.cumsum([len(x[2]) for x in held]).tolist(), "frames": b"".join(x[2] for x in held),
            }
            start += n
            return pa.RecordBatch.from_pylist([row], _arrow(BLOCKS))

        for batch in batches:
            for doc_id, n, frame, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame", "shard")), strict=True):
                if at != shard:
                    if held:
                        yield block()
                    start, held, size, shard = 0, [], 0, at
                held.append((doc_id, n, frame))
                size += len(frame)
                if size >= BLOCK:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    ranged = docs.mapInArrow(frames, FRAME).repartitionById(n_shards, "shard").sortWithinPartitions("shard", "doc_id", "frame")
    ranged.mapInArrow(blocks, BLOCKS).write.parquet(f"{out}/blocks")
    width = load(path, end_id).width.itemsize
    spark.createDataFrame([(dict_hash, bytearray(dictionary), width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{out}/dictionary")
    sizes = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.min("first_id").alias("id"))
    at, shards = 0, []
    for r in sorted(sizes.collect(), key=lambda r: r.shard):  # one row a shard, SHARDS at most
        shards.append((r.shard, at))
        at += r.n
    spark.createDataFrame(shards, "shard int, start long").coalesce(1).write.parquet(f"{out}/shards")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def open_store(spark: SparkSession, out: str) -> tuple[DataFrame, str, bytes, int]:
    """The blocks with ``start`` counted over all shards, and the dictionary's hash, bytes and id width."""
    row = spark.read.parquet(f"{out}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary is not the one that the store was written with")
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    shards = spark.read.schema("shard int, start long").parquet(f"{out}/shards").withColumnRenamed("start", "before")
    whole = blocks.join(F.broadcast(shards), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")
    return whole, row.dict_hash, data, row.width


def _documents_of(batches, dict_hash: str, dictionary: bytes, wanted: set | None = None):
    codec = zstandard.ZstdDecompressor(**_codec(dictionary))
    for batch in batches:
        for row in batch.to_pylist():
            if row["dict_hash"] != dict_hash:
                raise ValueError("a block was written with another dictionary")
            at, low = row["start"], 0
            for doc_id, n, high in zip(row["doc_ids"], row["counts"], row["ends"], strict=True):
                if wanted is None or doc_id in wanted:
                    yield doc_id, at, codec.decompress(row["frames"][low:high])
                at, low = at + n, high


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) of every stored document."""
    whole, dict_hash, dictionary, width = open_store(spark, out)
    shipped = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, at, data in _documents_of([batch], dict_hash, shipped.value):
                ids = np.frombuffer(data, f"<u{width}")
                rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, out: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents: only blocks whose id range can hold one are read."""
    whole, dict_hash, dictionary, width = open_store(spark, out)
    hit = functools.reduce(lambda a, b: a | b, [(F.col("first_id") <= i) & (F.col("last_id") >= i) for i in doc_ids], F.lit(False))
    wanted, found = set(doc_ids), {}
    for row in whole.filter(hit).toLocalIterator():
        for doc_id, _, data in _documents_of([pa.RecordBatch.from_pylist([row.asDict()])], dict_hash, dictionary, wanted):
            found[doc_id] = np.frombuffer(data, f"<u{width}").tolist()
    return found
