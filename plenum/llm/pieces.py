"""Tokenizers applied to texts piece by piece, with a cache of pieces.

Both tokenizers cut a text into pieces by a fixed pattern and merge inside a piece only.  A text is
therefore cut at places where that pattern always cuts, each new piece is encoded once by the
``tokenizers`` library and kept, as packed ids, in a cache of the worker process.  The cache holds at most
``CACHE`` pieces of at most ``LONGEST`` bytes; a full cache is emptied, so memory stays bounded.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

CACHE = 1_000_000
LONGEST = 64
#: Pieces that go to the library in one call.
BATCH = 4096

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class PieceCache:
    """piece (UTF-8) -> its ids, packed as little-endian unsigned 16- or 32-bit numbers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.known: dict[bytes, bytes] = {}
        self.encode = encode

    def texts(self, cut: list[list[bytes]]) -> list[bytes]:
        """The packed ids of each text, given as its list of pieces."""
        known = self.known
        new: set[bytes] = set()
        for pieces in cut:
            new.update(set(pieces).difference(known))  # known is a plain dict: one look-up a piece
        rest: dict[bytes, bytes] = {}
        if new:
            if len(known) + len(new) > CACHE:
                rest, known = known, {}
                self.known = known
            order = list(new)
            for i in range(0, len(order), BATCH):
                part = order[i : i + BATCH]
                for p, ids in zip(part, self.encode([p.decode() for p in part]), strict=True):
                    (known if len(p) <= LONGEST and len(known) < CACHE else rest)[p] = ids
        get = known.__getitem__ if not rest else lambda p: known[p] if p in known else rest[p]
        return [b"".join(map(get, pieces)) for pieces in cut]


# -- words: a tokenizer that drops white space -------------------------------------------------


_PLAIN = re.compile(rb"[A-Z]+(?![\x80-\xff])")
_STOP = re.compile(rb"(?<=[a-zA-Z])([.,])(?=\s)")


def words(raw: bytes) -> list[bytes]:
    """Cut at ASCII white space, and before a full stop or comma between a letter and white space.

    Such a tokenizer normalises white space and drops it; neither composition nor lower-casing reaches
    over it, and letters and punctuation are pieces of their own.  A-Z is lower-cased here, as the tokenizer
    would do, unless the text could then look like a special token.  The tokenizer composes first, and some
    letters compose with a mark only when they are small: in a text with marks of U+0300 to U+036F, which alone
    compose with A-Z, a letter before a character beyond ASCII is left to the tokenizer.
    """
    if b"<|" not in raw:
        marked = b"\xcc" in raw or b"\xcd" in raw  # first bytes of U+0300 to U+037F
        raw = _PLAIN.sub(lambda m: m[0].lower(), raw) if marked else raw.lower()
    return _STOP.sub(rb" \1", raw).split()


# -- byte-level BPE from ranks -----------------------------------------------------------------


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: Latin-1's printable ones stand for
    themselves, the others follow from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_tokenizer(ranks: dict[bytes, int], pattern: str | None):
    """A ``tokenizers.Tokenizer`` for the ranks; without a pattern each input is one piece.

    A merge is any cut of a token into two tokens, in the order of the merged token's rank: that is the
    rule "merge the neighbours whose concatenation has the lowest rank".
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_chars()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        cuts = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        cuts.sort(key=lambda c: (ranks[c[0]], ranks[c[1]]))
        merges += [(name[a], name[b]) for a, b in cuts]
    tok = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges, ignore_merges=True))
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    if pattern is None:
        tok.pre_tokenizer = level
    else:
        tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), level])
    return tok


#: White space other than a blank and a line feed, or what may be its first bytes.
_OTHER_BLANKS = [bytes([b]) for b in (0, 9, 11, 12, 13, 28, 29, 30, 31)] + [
    c.encode() for c in "\x85\xa0\u1680\u205f\u3000"
] + [b"\xe2\x80"]
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= [^\s\x1c-\x1f\x85])")


def blanks_kept(raw: bytes) -> list[bytes]:
    """Cut before each single blank and around each single line feed, where the pattern always cuts.

    A text with other white space, or with several of them in a row, is cut before single blanks only;
    the rest of its white space stays inside the pieces, for the library's own pattern.
    """
    pieces = raw.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0")
    if b" " in pieces or b"" in pieces or any(b in raw for b in _OTHER_BLANKS):
        return [p.encode() for p in _CUT.split(raw.decode()) if p]
    return pieces
