"""Media columns: bytes as FLAC (mono, 8 bits, blocks of 576 samples), written and read in numpy.

The encoder tries for every block a constant, fixed predictors of order 0 to 2, a linear predictor of order 2 and plain
samples, and Rice-codes the residuals. The decoder of these streams finds frames by sync code, header CRC-8 and frame number, verifies
each frame's CRC-16 and the stream's MD5, decodes Rice residuals, runs the predictors and hands out PCM blocks with
their sample and byte offsets. Both work on many blocks at once: step t handles sample t of every block. Streams of another
layout are read frame by frame (``flac_stream``), which also reads from a seek point on.

Cases: null text is empty; an empty payload is one block of filler bytes; texts of any length are stored whole, a run
of blocks at a time; equal texts give equal rows; an empty table gives an empty table; a damaged stream raises
``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, small_batches
from .flac_stream import pcm, read_blocks, read_info

BLOCK = 576
#: Blocks handled at once: the bound on memory (about 600 bytes a sample while bits are packed).
RUN = 4096
RATE = 8000
#: Frames between two points of the seek table.
SEEK_EVERY = 16
#: Precision and shift of the quantised linear predictor.
PRECISION, SHIFT = 9, 7


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out.append(c)
    return np.array(out, np.int64)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16).astype(np.uint16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of runs of ``data``. Leading zeros leave it 0, so the runs are aligned at their ends."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    most = int(lengths.max())
    ends = starts + lengths
    for back in range(most, 0, -1):
        at = ends - back
        byte = np.where(back <= lengths, data[np.maximum(at, 0)], 0)
        out = (out << np.uint16(8)) ^ _CRC16[(out >> np.uint16(8)) ^ byte]
    return out


@lru_cache(100_000)
def frame_header(number: int) -> bytes:
    """Sync, 576 samples, rate of the stream, mono, 8 bits, the frame number in UTF-8's manner, CRC-8."""
    if number < 0x80:
        coded = bytes([number])
    else:
        tail, width = [], 6
        while number >> width:
            tail.append(0x80 | number & 0x3F)
            number >>= 6
            width -= 1
        # The lead byte has a one for each byte of the code.
        coded = bytes([(0xFF << (width) & 0xFF) & ~(1 << width) & 0xFF | number, *reversed(tail)])
    head = b"\xff\xf8\x20\x02" + coded
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r >= 0, 2 * r, -2 * r - 1)


def _predict(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x, axis=1)
    return x


def _linear(x: np.ndarray):
    """Quantised coefficients of order 2 for each block, and residuals."""
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1) + 1, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    a = np.stack([(r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    limit = (1 << (PRECISION - 1)) - 1
    q = np.clip(np.rint(np.nan_to_num(a) * (1 << SHIFT)), -limit, limit).astype(np.int32)
    guess = (q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> SHIFT
    return q, x[:, 2:] - guess


def _encode_run(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of the blocks ``x`` (signed samples) with these frame numbers."""
    n = len(x)
    constant = (x == x[:, :1]).all(1)
    choices = [(_zigzag(_predict(x, o)), 8 * o) for o in range(3)]
    coefs, residual = _linear(x)
    choices.append((_zigzag(residual), 16 + 9 + 2 * PRECISION))
    bits, params = [], []
    for u, extra in choices:
        mean = u.mean(1)
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.69 + 0.5, 1))), 0, 14).astype(np.int32)
        bits.append((u >> k[:, None]).sum(1) + u.shape[1] * (1 + k) + extra + 10)
        params.append(k)
    best = np.argmin(np.stack(bits), 0)
    total = np.take_along_axis(np.stack(bits), best[None], 0)[0] + 8
    plain = ~constant & (total >= 8 * (BLOCK + 1))
    out: list[bytes | None] = [None] * n
    for i in np.flatnonzero(constant):
        out[i] = bytes([0, x[i, 0] & 255])
    for i in np.flatnonzero(plain):
        out[i] = b"\x02" + x[i].astype(np.int8).tobytes()
    for c, (u, _) in enumerate(choices):
        who = np.flatnonzero(~constant & ~plain & (best == c))
        if not len(who):
            continue
        order = BLOCK - u.shape[1]
        u, k = u[who].astype(np.int32), params[c][who]
        q = u >> k[:, None]
        size = q + 1 + k[:, None]
        lead = 8 * (1 + order) + (9 + 2 * PRECISION if c == 3 else 0) + 10
        total = lead + size.sum(1)
        room = (total + 7) // 8
        first = np.concatenate(([0], np.cumsum(room)[:-1])) * 8
        bit = np.zeros(int(room.sum()) * 8, np.uint8)

        def put(at, value, width, bit=bit):
            for j in range(width):
                bit[at + j] = value >> (width - 1 - j) & 1

        put(first, np.full(len(who), (0b001000 | order) << 1 if c < 3 else (0b100000 | order - 1) << 1), 8)
        at = first + 8
        for j in range(order):
            put(at, x[who, j] & 255, 8)
            at = at + 8
        if c == 3:
            put(at, np.full(len(who), PRECISION - 1), 4)
            put(at + 4, np.full(len(who), SHIFT), 5)
            put(at + 9, coefs[who, 0] & ((1 << PRECISION) - 1), PRECISION)
            put(at + 9 + PRECISION, coefs[who, 1] & ((1 << PRECISION) - 1), PRECISION)
            at = at + 9 + 2 * PRECISION
        put(at + 6, k, 4)
        at = at + 10
        end = at[:, None] + np.cumsum(size, 1)
        for value in np.unique(k):
            some = np.flatnonzero(k == value)
            low_end = end[some].ravel()
            bit[low_end - 1 - value] = 1
            low = u[some].ravel()
            for j in range(value):
                bit[low_end - 1 - j] = low >> j & 1
        packed = np.packbits(bit).tobytes()
        begin = first // 8
        for i, b, r in zip(who.tolist(), begin.tolist(), room.tolist(), strict=True):
            out[i] = packed[b : b + r]
    frames = [frame_header(k) + body for k, body in zip(numbers, out, strict=True)]
    lengths = np.array([len(f) for f in frames], np.int64)
    sums = crc16(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return [f + int(s).to_bytes(2, "big") for f, s in zip(frames, sums, strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (whole blocks of bytes; sample = byte - 128)."""
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    counts = [len(p) // BLOCK for p in payloads]
    numbers = [k for c in counts for k in range(c)]
    frames: list[bytes] = []
    for at in range(0, len(data), RUN):
        frames += _encode_run(data[at : at + RUN].astype(np.int32) - 128, numbers[at : at + RUN])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[at : at + c]
        at += c
        sizes = [len(f) for f in own]
        pcm = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        points = b"".join(struct.pack(">QQH", k * BLOCK, int(offsets[k]), BLOCK) for k in range(0, c, SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + b"".join(own))
    return out


class OtherLayout(ValueError):
    """A sound stream that this module did not write."""


def _split(stream: bytes) -> tuple[int, bytes, list[int], list[int]]:
    """(samples, MD5, offsets of frames, header lengths); the last offset is the end."""
    info = read_info(stream)
    if (info.block, info.channels, info.depth, info.rate) != (BLOCK, 1, 8, RATE) or info.samples % BLOCK:
        raise OtherLayout
    at = info.start
    starts, heads, find = [], [], at
    for number in range(info.samples // BLOCK):
        head = frame_header(number)
        # The next frame is where its own header stands, which carries its number and CRC-8.
        where = stream.find(head, find)
        if where < 0:
            raise ValueError(f"frame {number} is missing")
        starts.append(where)
        heads.append(len(head))
        find = where + len(head) + 2
    return info.samples, info.md5, [*starts, len(stream)], heads


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a big-endian number."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out |= padded[j : j + len(data)] << np.uint64(56 - 8 * j)
    return out


class _Bits:
    """Reads at many places of one byte array at once."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.window, self.at = _windows(data), at.astype(np.int64)

    def peek(self):
        return self.window[self.at >> 3] << (self.at & 7).astype(np.uint64)

    def unsigned(self, width: int) -> np.ndarray:
        v = (self.peek() >> np.uint64(64 - width)).astype(np.int64)
        self.at += width
        return v

    def signed(self, width: int) -> np.ndarray:
        v = self.unsigned(width)
        return v - ((v >> (width - 1)) << width)

    def rice(self, k: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """One Rice code each; ``shift`` is 63 - k as unsigned."""
        v = self.peek()
        zeros = 1075 - ((v >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
        long = zeros + k > 55
        if long.any():
            zeros, v = zeros.copy(), v.copy()
            for i in np.flatnonzero(long):
                at, q = int(self.at[i]), 0
                while not int(self.window[at >> 3]) << (at & 7) >> 63 & 1:
                    at, q = at + 1, q + 1
                zeros[i] = q
                self.at[i] = at
                v[i] = (int(self.window[at >> 3]) << (at & 7)) & ((1 << 64) - 1)
            skip = np.where(long, 0, zeros)
        else:
            skip = zeros
        rest = (v << skip.astype(np.uint64)) << np.uint64(1)
        low = np.where(k > 0, (rest >> np.uint64(1)) >> shift, 0).astype(np.int64)
        self.at += skip + 1 + k
        return zeros << k | low


def _decode_run(data: np.ndarray, starts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Samples of the frames that begin at ``starts``; their headers are ``heads`` bytes."""
    out = np.empty((BLOCK, len(starts)), np.int32)
    kinds = data[starts + heads] >> 1
    for kind in np.unique(kinds):
        who = np.flatnonzero(kinds == kind)
        first = starts[who] + heads[who] + 1
        if kind == 0:
            out[:, who] = data[first].view(np.int8)
            continue
        if kind == 1:
            out[:, who] = data[first + np.arange(BLOCK)[:, None]].view(np.int8)
            continue
        if 8 <= kind <= 12:
            order, coefs = int(kind) - 8, None
        elif kind >= 32:
            order = int(kind) - 31
        else:
            raise ValueError("reserved subframe type")
        bits = _Bits(data, first * 8)
        x = np.empty((BLOCK, len(who)), np.int64)
        for t in range(order):
            x[t] = bits.signed(8)
        if kind >= 32:
            precision = np.unique(bits.unsigned(4)) + 1
            shift = np.unique(bits.signed(5))
            if len(precision) > 1 or len(shift) > 1 or shift[0] < 0:
                raise OtherLayout
            coefs = [bits.signed(int(precision[0])) for _ in range(order)]
        method, parts = bits.unsigned(2), bits.unsigned(4)
        if (method > 1).any() or len(np.unique(parts)) > 1 or len(np.unique(method)) > 1:
            raise OtherLayout
        each, width = BLOCK >> int(parts[0]), 4 + int(method[0])
        for t in range(order, BLOCK):
            if t == order or t % each == 0:
                k = bits.unsigned(width)
                if (k == (1 << width) - 1).any():
                    raise OtherLayout
                shift_low = (63 - k).astype(np.uint64)
            u = bits.rice(k, shift_low)
            x[t] = u >> 1 ^ -(u & 1)
        if coefs is not None:
            s = int(shift[0])
            for t in range(order, BLOCK):
                x[t] += sum(c * x[t - 1 - j] for j, c in enumerate(coefs)) >> s
        else:
            # Undo the differences: the warm-up samples give the first difference of each order.
            seeds = [x[:order].copy()]
            for _ in range(order):
                seeds.append(np.diff(seeds[-1], axis=0))
            r = x[order:]
            for level in range(order - 1, -1, -1):
                r = np.cumsum(np.concatenate((seeds[level][order - 1 - level :][:1], r)), axis=0)[1:]
            x[order:] = r
        out[:, who] = x
    return out.T


def decode_many(streams: list[bytes], *, offsets: bool = False):
    """The payload bytes of each stream, checked against frame checksums and MD5; with ``offsets`` also frame offsets."""
    parsed = [_split(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    empty = np.zeros(0, np.int64)
    starts = np.concatenate([empty, *[np.array(p[2][:-1], np.int64) + b for p, b in zip(parsed, base, strict=False)]])
    ends = np.concatenate([empty, *[np.array(p[2][1:], np.int64) + b for p, b in zip(parsed, base, strict=False)]])
    heads = np.concatenate([empty, *[np.array(p[3], np.int64) for p in parsed]])
    pcm = []
    for at in range(0, len(starts), RUN):
        s, e, h = starts[at : at + RUN], ends[at : at + RUN], heads[at : at + RUN]
        part = data[s[0] : e[-1]]
        want = part[e - s[0] - 2].astype(np.uint16) << np.uint16(8) | part[e - s[0] - 1]
        if (crc16(part, s - s[0], e - s - 2) != want).any():
            raise ValueError("a frame's checksum is wrong")
        pcm.append(_decode_run(part, s - s[0], h).astype(np.int8))
    every = np.concatenate(pcm).reshape(-1) if pcm else np.zeros(0, np.int8)
    out, at = [], 0
    for samples, md5, frames, _ in parsed:
        own = every[at : at + samples]
        at += samples
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise ValueError("the stream's MD5 is wrong")
        payload = (own.view(np.uint8) ^ 128).tobytes()
        out.append((payload, frames) if offsets else payload)
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def feature(payload: bytes) -> str:
    """Samples, sum, energy and sign changes of the PCM, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"{len(x)}:{int(x.sum())}:{int((x * x).sum())}:{changes}"


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Store each text as FLAC, read it back and describe it; with ``media`` also the stream itself.

    ``n_blocks`` and ``blocks_sha256`` tell the blocks' places: pairs of first sample and byte offset.
    """

    def worker():
        def process(texts):
            both = [padded(t) for t in texts]
            streams = encode_many([p for _, p in both])
            for (n, _), stream, (back, frames) in zip(both, streams, decode_many(streams, offsets=True), strict=True):
                blocks = np.stack([np.arange(len(frames) - 1) * BLOCK, np.array(frames[:-1])], 1).astype("<i8")
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), feature(back), len(blocks), hashlib.sha256(blocks.tobytes()).hexdigest())
                yield row + (stream,) if media else row

        return process

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, blocks_sha256 string" + (", media binary" if media else "")
    return map_texts(docs, id_col, text_col, fields, worker, 2_000_000)


def pcm_blocks(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per PCM block: id, block, first_sample, media_offset (of its frame), pcm (signed samples, interleaved).

    Any FLAC stream is read; a null one has no blocks.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    schema = StructType([StructField(id_col, media.schema[id_col].dataType), *StructType.fromDDL("block long, first_sample long, media_offset long, pcm binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for key, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream is None:
                    continue
                rows = list(_blocks(bytes(stream)))
                columns = [[key] * len(rows), list(range(len(rows))), *zip(*rows, strict=True)] if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    small_batches(media.sparkSession)
    return media.select(id_col, media_col).mapInArrow(run, schema)


def _blocks(stream: bytes):
    """(first sample, place of the frame, PCM) of each block."""
    try:
        [(payload, frames)] = decode_many([stream], offsets=True)
    except OtherLayout:
        depth = read_info(stream).depth
        for first, at, x in read_blocks(stream):
            yield first, at, pcm(x, depth)
        return
    signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
    for k, at in enumerate(frames[:-1]):
        yield k * BLOCK, at, signed[k * BLOCK : (k + 1) * BLOCK]
