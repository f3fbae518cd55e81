"""Byte-level BPE: a sentencepiece model serialised straight from a rank file encodes the pre-tokens.

Method: every byte becomes one character, every entry of the rank file one piece whose score is its negative rank,
and the normaliser is the identity. Merging the best-scored pair first is then the same as merging the pair of
lowest rank first. A pre-token is encoded on its own; ids are the ranks. Decoding maps ids back to bytes.

Cases: null text is empty (no tokens, the digest of nothing); texts of any length are encoded whole; equal texts
give equal rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

#: Code point of byte 0 in the pieces; the 256 characters from here hold no white space.
FIRST = 0x100
#: Entries of each generation of the worker's two memories (pieces and pre-tokens with their ids): they are bounded, and
#: given back at a task's end.
CACHE = 120_000
#: Code points encoded at a time; a longer text is a slice of its own.
SLICE = 1_500_000
#: Longer pre-tokens are encoded but not remembered.
CACHE_LENGTH = 64


def load_ranks(path: str) -> list[bytes]:
    """The rank file's byte strings, by rank. On a cluster the file has this path on every machine."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for word, rank in pairs:
        out[int(rank)] = base64.b64decode(word)
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_UP)


_UP = {b: FIRST + b for b in range(256)}


def serialise(ranks: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece r is the entry of rank r, the unknown piece comes last."""
    parts = []
    for rank, word in enumerate(ranks):
        piece = _bytes_field(1, to_chars(word).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _int_field(3, 1)
        parts.append(_bytes_field(1, piece))
    unknown = _bytes_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _int_field(3, 2)
    parts.append(_bytes_field(1, unknown))
    trainer = _int_field(3, 2) + _int_field(4, len(ranks) + 1) + _int_field(40, len(ranks)) + b"".join(_int_field(k, -1) for k in (41, 42, 43))
    normaliser = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(parts) + _bytes_field(2, trainer) + _bytes_field(3, normaliser)


class Memory:
    """A bounded map of two generations: when the young one is full it becomes the old one, so frequent keys stay."""

    def __init__(self, most: int):
        self.young, self.old, self.most = {}, {}, most

    def put(self, items: dict) -> None:
        if len(self.young) + len(items) > self.most:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in items.items() if len(k) <= CACHE_LENGTH)
        if len(self.young) > self.most:
            self.old, self.young = {}, {}


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern.

    Texts are cut before each space that something other than white space follows. The known pattern always starts a
    pre-token there and none reaches across, so each piece is looked up, or else split by the pattern on its own. Under any
    other pattern texts are split whole.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.blank = regex.compile(r" (?:\s|$)").search
        self.cut = regex.compile(r" (?=\S)").split
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.single = {word: rank.to_bytes(4, "little") for rank, word in enumerate(self.ranks)}
        self.known = pattern == default_pattern()
        self.forget()

    def forget(self) -> None:
        """Empty the memories."""
        self.chunks, self.tokens = Memory(CACHE), Memory(CACHE)

    def _pre_tokens(self, parts: set) -> dict[str, bytes]:
        """Ids of these pre-tokens, by the sentencepiece model where they are not remembered."""
        tokens, out, new = self.tokens, {}, []
        young, old = tokens.young, tokens.old
        for p in parts:
            got = young.get(p) or old.get(p)
            if got is None:
                new.append(p)
            else:
                out[p] = got
        raw = [p.encode() for p in new]
        ids = self.pieces.encode([to_chars(r) for r in raw], num_threads=1) if new else []
        for p, r, x in zip(new, raw, ids, strict=True):
            out[p] = self.single.get(r) or struct.pack(f"<{len(x)}I", *x)
        tokens.put(out)
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; what isn't remembered is encoded together."""
        heads, rests = [], []
        for text in texts:
            if not self.known:
                head, rest = text or "", []
            else:
                head, *rest = self.cut(text) if self.blank(text or "") else (text or "").split(" ")
            heads.append(self.find(head))
            rests.append(rest)
        chunks = self.chunks
        wanted = set().union(*rests)
        found = {c: chunks.young[c] for c in wanted if c in chunks.young}
        found.update((c, chunks.old[c]) for c in wanted if c not in found and c in chunks.old)
        new = {c: self.find(" " + c) for c in wanted if c not in found}
        ids = self._pre_tokens({p for parts in new.values() for p in parts}.union(*heads))
        found.update((c, b"".join([ids[p] for p in parts])) for c, parts in new.items())
        chunks.put(found)
        return [b"".join([ids[p] for p in h]) + b"".join([found[c] for c in r]) for h, r in zip(heads, rests, strict=True)]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_ids(self, ids: bytes) -> bytes:
        """Inverse mapping by a table of ids."""
        import numpy as np

        ranks = self.ranks
        return b"".join([ranks[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_texts(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode it again.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``ids``, the ids as little-endian bytes and the
    decoded bytes. One pass, no shuffle; a worker holds one batch of texts and a bounded cache.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def worker():
        c = codec(path, pattern)

        def process(texts):
            for got in c.encode_many(texts):
                back = c.decode_ids(got)
                row = (len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(back).hexdigest())
                yield row + (got, back) if ids else row

        process.close = c.forget
        return process

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if ids else "")
    return map_texts(docs, id_col, text_col, fields, worker, SLICE)
