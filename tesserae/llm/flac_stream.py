"""Any FLAC stream, frame by frame: all subframe types, escaped and partitioned residuals, stereo, 4 to 32 bits a sample.

``flac`` writes one layout and reads it many frames at once; this reader takes the streams of others, and single frames of
either for seeking. A frame's header CRC-8 and CRC-16 are verified, and the MD5 of a whole stream.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass, field

import numpy as np

#: Samples of a frame, its bits a sample and its channels by their codes in the header (fixed values).
SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@dataclass
class Info:
    """What the stream says of itself: sample count (0: unknown), MD5, seek points (first sample, offset), first frame's place."""

    block: int
    rate: int
    channels: int
    depth: int
    samples: int
    md5: bytes
    points: list = field(default_factory=list)
    start: int = 0


def read_info(stream: bytes) -> Info:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, info, points = 4, False, None, []
    while not last:
        if at + 4 > len(stream):
            raise ValueError("the stream ends in its metadata")
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = Info(int.from_bytes(body[:2], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34])
        elif kind == 3:
            points = [struct.unpack(">QQ", body[k : k + 16]) for k in range(0, size, 18)]
        at += 4 + size
    if info is None:
        raise ValueError("the stream has no info")
    info.start = at
    # A point of all ones holds a place for later.
    info.points = [(s, at + o) for s, o in points if s != (1 << 64) - 1]
    return info


class _Reader:
    """Bits of a frame, from a byte on."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.where(self.bits == 1, np.arange(len(self.bits)), len(self.bits))
        self.next_one = np.minimum.accumulate(ones[::-1])[::-1]
        self.at = 0

    def take(self, width: int) -> int:
        if self.at + width > len(self.bits):
            raise ValueError("the frame ends early")
        part = self.bits[self.at : self.at + width]
        self.at += width
        return int.from_bytes(np.packbits(part).tobytes(), "big") >> (-width % 8) if width else 0

    def signed(self, width: int) -> int:
        v = self.take(width)
        return v - (1 << width) if width and v >> (width - 1) else v

    def unary(self) -> int:
        if self.at >= len(self.bits) or self.next_one[self.at] >= len(self.bits):
            raise ValueError("the frame ends early")
        at = int(self.next_one[self.at])
        zeros = at - self.at
        self.at = at + 1
        return zeros

    def numbers(self, at: np.ndarray, width: int) -> np.ndarray:
        """Unsigned numbers of ``width`` bits at many places."""
        if len(at) and int(at.max()) + width > len(self.bits):
            raise ValueError("the frame ends early")
        out = np.zeros(len(at), np.int64)
        for j in range(width):
            out = out << 1 | self.bits[at + j]
        return out

    def rice(self, count: int, k: int) -> np.ndarray:
        high, low = np.empty(count, np.int64), np.empty(count, np.int64)
        for i in range(count):
            high[i] = self.unary()
            low[i] = self.at
            self.at += k
        u = high << k | self.numbers(low, k)
        return u >> 1 ^ -(u & 1)


def _residual(r: _Reader, n: int, order: int) -> np.ndarray:
    method = r.take(2)
    if method > 1:
        raise ValueError("reserved residual coding")
    width, parts = 4 + method, r.take(4)
    if n % (1 << parts) or n >> parts < order:
        raise ValueError("partitions don't fit the block")
    out = []
    for p in range(1 << parts):
        count, k = (n >> parts) - (order if p == 0 else 0), r.take(width)
        if k < (1 << width) - 1:
            out.append(r.rice(count, k))
            continue
        raw = r.take(5)
        v = r.numbers(r.at + raw * np.arange(count), raw)
        r.at += raw * count
        out.append(v - ((v >> (raw - 1)) << raw) if raw else v)
    return np.concatenate(out)


def _subframe(r: _Reader, n: int, depth: int) -> np.ndarray:
    if r.take(1):
        raise ValueError("a subframe's padding is set")
    kind = r.take(6)
    wasted = r.unary() + 1 if r.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = np.full(n, r.signed(depth), np.int64)
    elif kind == 1:
        v = r.numbers(r.at + depth * np.arange(n), depth)
        r.at += depth * n
        x = v - ((v >> (depth - 1)) << depth)
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        warm = [r.signed(depth) for _ in range(order)]
        if kind < 32:
            coefs, shift = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order], 0
        else:
            precision, shift = r.take(4) + 1, r.signed(5)
            if precision == 16 or shift < 0:
                raise ValueError("reserved predictor")
            coefs = [r.signed(precision) for _ in range(order)]
        x = warm + _residual(r, n, order).tolist()
        for t in range(order, n):
            x[t] += sum(c * x[t - 1 - j] for j, c in enumerate(coefs)) >> shift
        x = np.array(x, np.int64)
    else:
        raise ValueError("reserved subframe type")
    return x << wasted


def read_frame(stream: bytes, at: int, info: Info) -> tuple[np.ndarray, int, int]:
    """(samples by channel, number of the first sample, place after the frame) of the frame at ``at``."""
    from .flac import crc8, crc16

    head = stream[at : at + 4]
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xFE != 0xF8:
        raise ValueError("no frame begins here")
    size, rate, channels, depth = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    # The number is coded in UTF-8's manner: leading ones tell its bytes.
    lead, end = stream[at + 4], at + 5
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & (0x3F >> more)
    for b in stream[end : end + more]:
        number = number << 6 | b & 0x3F
    end += more
    if size in (6, 7):
        n = int.from_bytes(stream[end : end + size - 5], "big") + 1
        end += size - 5
    elif size in SIZES:
        n = SIZES[size]
    else:
        raise ValueError("reserved block size")
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if channels > 10 or depth == 3 or crc8(stream[at:end]) != stream[end]:
        raise ValueError("a frame's header is wrong")
    bits = DEPTHS.get(depth, info.depth)
    r = _Reader(stream[end + 1 : end + 1 + (channels % 8 + 2) * (n * (bits + 2) // 8 + 64) * 2])
    wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(channels, (0,) * (channels + 1))
    x = np.stack([_subframe(r, n, bits + extra) for extra in wide])
    if channels == 8:
        x[1] = x[0] - x[1]
    elif channels == 9:
        x[0] += x[1]
    elif channels == 10:
        mid, side = x[0] << 1 | x[1] & 1, x[1].copy()
        x[0], x[1] = mid + side >> 1, mid - side >> 1
    after = end + 1 + (r.at + 7) // 8
    own = np.frombuffer(stream[at:after], np.uint8)
    if int(crc16(own, np.array([0]), np.array([len(own)]))[0]) != int.from_bytes(stream[after : after + 2], "big"):
        raise ValueError("a frame's checksum is wrong")
    return x, number if head[1] & 1 else number * info.block, after + 2


def pcm(x: np.ndarray, depth: int) -> bytes:
    """Interleaved signed samples, lowest byte first, in whole bytes."""
    width = (depth + 7) // 8
    return x.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def read_blocks(stream: bytes):
    """Yields (first sample, place of the frame, samples by channel); at the end the stream's MD5 is verified."""
    info = read_info(stream)
    at, done, md5 = info.start, 0, hashlib.md5()
    while at < len(stream):
        x, first, after = read_frame(stream, at, info)
        md5.update(pcm(x, info.depth))
        yield first, at, x
        at, done = after, done + x.shape[1]
    if info.samples and done != info.samples or any(info.md5) and md5.digest() != info.md5:
        raise ValueError("the stream's MD5 or length is wrong")


def read_range(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples [first, first + count) by channel: reading begins at the last seek point before them."""
    info = read_info(stream)
    at = max([(s, o) for s, o in info.points if s <= first], default=(0, info.start))[1]
    out = []
    while at < len(stream) and count > 0:
        x, begin, at = read_frame(stream, at, info)
        part = x[:, max(0, first - begin) : max(0, first - begin) + count] if begin + x.shape[1] > first else x[:, :0]
        out.append(part)
        first, count = first + part.shape[1], count - part.shape[1]
    return np.concatenate(out, 1) if out else np.zeros((info.channels, 0), np.int64)
