"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

Encoding maps every byte of the text to a printable character, cuts the text by a pattern and merges
inside each match.  Ranks in the tiktoken format become the library's vocabulary and merges.
Decoding reverses the byte table: ids become bytes, and bytes become text only once all bytes of a
character are there (``StreamDecoder``), so characters that several ids share come out whole.

Cases: a null text is empty and has no ids.  A null doc_id stays null; rows that repeat stay rows.
Texts that hold special-token strings are ordinary text.  Very long texts are encoded whole, one at a time.
An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm import pieces
from plenum.llm.common import documents


class ByteBpe:
    """One vocabulary of ranks with the pattern that cuts texts before merging."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks = pieces.read_ranks(ranks_path)
        self.tokenizer = pieces.byte_tokenizer(self.ranks, pattern)
        chars = pieces.byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        size = max(self.ranks.values()) + 1
        self.table: list[bytes | None] = [None] * size
        for token, i in self.tokenizer.get_vocab().items():
            self.table[i] = bytes(back[c] for c in token)
        self.decimal = [b"%d," % i for i in range(size)]
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.cache = pieces.PieceCache(
            lambda part: [np.array(e.ids, self.width).tobytes() for e in self.tokenizer.encode_batch_fast(part)]
        )

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        packed = self.cache.texts([pieces.blanks_kept(t) if t else [] for t in texts])
        return [np.frombuffer(p, self.width) for p in packed]

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, byte after the last) for each token of the text, in UTF-8 bytes."""
        out, at = [], 0
        for i in self.encode_batch([text.encode()])[0].tolist():
            out.append((i, at, at := at + len(self.table[i])))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decimals(self, ids: Iterable[int]) -> bytes:
        """The ids in decimal, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids))[:-1]


class StreamDecoder:
    """Text of ids that arrive one after another; an unfinished character waits for its other bytes."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.utf8 = bpe, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.utf8.decode(self.bpe.decode(ids), last)


@functools.lru_cache(maxsize=2)
def load(ranks_path: str, pattern: str) -> ByteBpe:
    """The vocabulary, once a worker process."""
    return ByteBpe(ranks_path, pattern)


def _groups(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Row number and texts of runs of rows with about ``most`` bytes."""
    texts = batch.column("text").cast(pa.binary())
    at, run, size = 0, [], 0
    for k in range(len(texts)):
        t = texts[k].as_py()
        run.append(t)
        size += len(t)
        if size >= most:
            yield at, run
            at, run, size = k + 1, [], 0
    if run:
        yield at, run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for at, texts in _groups(batch):
                ids = bpe.encode_batch(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "ids"]
                )

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are not UTF-8 become the replacement character."""

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            texts = [None if x is None else StreamDecoder(bpe).feed(x, True) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded bytes); with
    ``place_col``, also position, from that column.  Rows stay in their order."""
    place = [] if place_col is None else ["position"]

    def run(batches):
        bpe = load(ranks_path, pattern)
        for batch in batches:
            for at, texts in _groups(batch):
                rows = [x.tolist() for x in bpe.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array([len(x) for x in rows], pa.int64()),
                        pa.array([hashlib.sha256(bpe.decimals(x)).hexdigest() for x in rows], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in rows], pa.string()),
                        *[batch.column(c).slice(at, len(texts)) for c in place],
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *place],
                )

    return documents(docs, id_col, text_col, place_col).mapInArrow(
        run, ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *[f"{c} long" for c in place]])
    )
