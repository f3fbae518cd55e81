"""Repeated substrings: per-shard suffix arrays (Larsson-Sadakane), Kasai prefixes, cross-shard merging by binary search.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus. Steps:

1. Anchors rule out what can't repeat. The smallest hash of the ``GRAM``-byte strings within a ``LENGTH``-byte string
   is its anchor; equal strings have equal anchors. Anchors are dealt to blocks of hashes (``deal``; those that recur within
   a batch of documents are sent once); only strings whose anchor recurs go on. Of equal texts one goes on.
2. Texts with such strings are dealt to shards of bounded size. A shard sorts its suffixes to depth ``LENGTH`` by
   Larsson-Sadakane refinement: each round sorts unresolved groups only, by the rank at twice the depth. Kasai's
   inequality gives the common prefixes of neighbours; those of ``LENGTH`` or more repeat within the shard.
3. Each shard's distinct strings, as sorted fingerprints, are cut into blocks by binary search and merged: a fingerprint
   that binary search finds in another shard's run repeats across shards. The answer is a bit for each. The number of
   blocks follows the counted strings.
4. Shards mark the covered bytes.

Beside it, passages are counted by words, since ``PASSAGE_WORDS`` words can be fewer than ``LENGTH`` bytes: ``n_passages`` is
how many anchors of a text (the least hash of ``PASSAGE_GRAM``-word strings within ``PASSAGE_WORDS`` words) stand elsewhere too.
It is one or more for any text that shares ``PASSAGE_WORDS`` words in a row with another place, and none for one that
shares fewer than ``PASSAGE_GRAM``. It removes nothing.

Fingerprints have 64 bits besides the block's own hash; anchors only pre-select. Cases: null text is empty; shorter
texts lose nothing; equal texts of ``LENGTH`` bytes or more are removed whole; repeated rows and null ids are rows like
others; an empty table gives an empty table; texts of any length are read whole, a shard holds
one text at least. Ids are whole numbers, or texts that can be cast to such.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import deal
from .common import _BASE_INV, _TABLE, CHUNK, Scratch, mix64, powers, release, slices, small_batches, span_hashes, word_spans
from .ngram_join import BROADCAST_ROWS

LENGTH, GRAM = 400, 200
#: Bytes of fingerprints in a block, and bytes of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 6 << 20, 3 << 19
#: Words of a passage that is counted, and of the strings whose least hash is its anchor.
PASSAGE_WORDS, PASSAGE_GRAM = 50, 35
_OWNER, _TEXT = deal.OWNER["many"], deal.OWNER["few"]
#: Kinds of the rows that deal passages' anchors, beyond those of byte anchors.
_PASSAGES = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()
_BASE2 = np.uint64(0x9E3779B97F4A7C15 | 1)


def window_hashes(data: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if second:
        up, down = powers(len(data) + 1, _BASE2), powers(len(data) + 1, np.uint64(pow(int(_BASE2), -1, 1 << 64)))
    else:
        up, down = _TABLE.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix64((total[width:] - total[:n]) * down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, 1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: anchors, first and last start, whether the anchor occurs twice within the run.

    ``CHUNK`` starts are read at a time; a run that is cut there is two runs with one anchor, which then counts as recurring.
    """
    if len(raw) <= CHUNK + LENGTH:
        return _segments(raw)
    starts = range(0, len(raw) - LENGTH + 1, CHUNK)
    parts = [(at, _segments(raw[at : at + CHUNK + LENGTH - 1])) for at in starts]
    return tuple(np.concatenate([p[k] + at if k in (1, 2) else p[k] for at, p in parts]) for k in range(4))


def _segments(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none.astype(bool)
    grams = window_hashes(data, GRAM)
    least = sliding_min(grams, LENGTH - GRAM + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], len(least)) - 1
    keys = least[first]
    twice = np.array([np.count_nonzero(grams[a : b + LENGTH - GRAM + 1] == k) > 1 for k, a, b in zip(keys, first, last, strict=True)], bool)
    return keys, first, last, twice


def passages(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct anchors of a text's passages, which of them it has at two places or more)."""
    words = span_hashes(np.frombuffer(raw, np.uint8), *word_spans(np.frombuffer(raw, np.uint8)))
    if len(words) < PASSAGE_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total, up, down = np.zeros(len(words) + 1, np.uint64), powers(len(words) + 1), powers(len(words) + 1, _BASE_INV)
    np.cumsum(words * up[:-1], out=total[1:])
    n = len(words) - PASSAGE_GRAM + 1
    grams = mix64((total[PASSAGE_GRAM:] - total[:n]) * down[:n])
    width = PASSAGE_WORDS - PASSAGE_GRAM + 1
    least = sliding_min(grams, width)
    anchors = np.unique(least)
    # An anchor's places are all its grams' places, within windows or not.
    ordered = np.sort(grams)
    again = np.searchsorted(ordered, anchors, "right") - np.searchsorted(ordered, anchors, "left") > 1
    return anchors, again


_ROW = "kind long, batch long, idx int, doc_id long, n_bytes long, md5 string, sha string, passages long, batches binary, counts binary, keys binary, owners binary"


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (kind -1), of batches with their runs (-2), and of blocks with a batch's anchors."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        count = TaskContext.get().partitionId() << 32
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 4)
        for arrow in batches:
            for ids, texts in slices(arrow.column(0).to_pylist(), arrow.column(1).to_pylist(), 4_000_000):
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
                found = [segments(r) for r in raws]
                # Anchors are minima, so they crowd near zero: scrambled, they spread over the blocks.
                keys = mix64(np.concatenate([f[0] for f in found]))
                owner = np.repeat(np.arange(len(raws)), [len(f[0]) for f in found])
                runs = np.stack([owner, np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])], 1).astype(np.int32)
                sure = np.concatenate([f[3] for f in found])
                order = np.argsort(keys, kind="stable")
                ordered = keys[order]
                first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
                group = np.cumsum(first) - 1
                twice = np.bincount(group, minlength=1)[group] > 1 if len(keys) else first
                sure[order] |= twice
                ordinal = np.where(twice, np.iinfo(_OWNER).max, order)[first].astype(_OWNER)
                digests = [(hashlib.md5(r).hexdigest(), hashlib.sha256(r).hexdigest()) for r in raws]
                phrases = [passages(r) for r in raws]
                # What a text has twice is counted at once, without an answer from elsewhere.
                alone, owner_of, near = deal.distinct([mix64(a[~twice]) for a, twice in phrases], _TEXT)
                near = near + [int(twice.sum()) for _, twice in phrases]
                rows = [(-1, count, i, key, len(r), *d, int(p), None, None, None, None) for i, (key, r, d, p) in enumerate(zip(ids, raws, digests, near, strict=True))]
                rows.append((-2, count, *[None] * 8, runs.tobytes(), sure.tobytes()))
                rows += [(r[0], count, *[None] * 6, *r[1:]) for r in deal.coarse_rows(ordered[first], ordinal, count)]
                rows += [(_PASSAGES + r[0], count, *[None] * 6, *r[1:]) for r in deal.coarse_rows(alone, owner_of, count)]
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in _ROW.split(", ")])
            release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _ROW)


def _candidates(replies: DataFrame) -> DataFrame:
    """(batch, idx, runs, starts): first and last starts, as pairs of 32-bit numbers, whose anchors recur, and how many starts."""

    def run(batches):
        import pyarrow as pa

        for batch, rows in deal.runs(batches, 0):
            own = next(r for r in rows if r[1] == -2)
            runs, sure = np.frombuffer(own[2], np.int32).reshape(-1, 3), np.frombuffer(own[3], bool).copy()
            for r in rows:
                if r[1] == 0:
                    sure[np.frombuffer(r[2], np.uint32)] = True
            runs = runs[sure]
            docs, at = np.unique(runs[:, 0], return_index=True)
            parts = np.split(runs[:, 1:], at[1:]) if len(docs) else []
            starts = [int((p[:, 1].astype(np.int64) - p[:, 0] + 1).sum()) for p in parts]
            columns = ([batch] * len(docs), docs.astype(np.int32), [p.tobytes() for p in parts], starts)
            types = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["batch", "idx", "runs", "starts"])

    return replies.mapInArrow(run, "batch long, idx int, runs binary, starts long")


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``depth`` bytes (equal ones share a rank), by Larsson-Sadakane refinement.

    Suffixes are first ranked by eight bytes. Then each round doubles the depth: positions in groups of more than one
    are sorted by their group and the rank of the suffix that far ahead; a group's number is the place of its first
    member, so that numbers of other groups stay valid. Resolved suffixes are not touched again.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(0), np.zeros(8, np.uint64)))
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word |= padded[j : j + n] << np.uint64(56 - 8 * j)
    order = np.argsort(word, kind="stable")
    ordered = word[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else 0
    h = 8
    # Members of unresolved groups, in sorted order; the place of each in the whole order.
    single = first & np.append(first[1:], True) if n else first
    place = np.flatnonzero(~single)
    members = order[place]
    while h < depth and len(members):
        step = min(h, depth - h)
        ahead = members + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = rank[members]
        key = np.lexsort((second, own))
        members, own, second = members[key], own[key], second[key]
        first = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
        rank[members] = np.maximum.accumulate(np.where(first, place, 0))
        single = first & np.append(first[1:], True)
        place, members = place[~single], members[~single]
        h += step
    return rank


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes, up to ``most``, of suffixes ``a`` (rising) and their neighbours ``b``.

    Kasai's inequality: one byte further on, a suffix and its neighbour share at least one byte less. It is used in
    rounds of halving strides: starts from the last measured suffix, so a repeated passage is compared about once.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(a), np.int64)
    known = np.full(len(a), -1, np.int64)
    for stride in (256, 64, 16, 4, 1):
        who = np.arange(0, len(a), stride)
        who = who[known[who] < 0]
        if not len(who):
            continue
        # The nearest measured suffix before; it bounds only within one run of neighbours.
        seen = np.maximum.accumulate(np.where(known >= 0, np.arange(len(a)), -1))[who]
        gap = a[who] - a[np.maximum(seen, 0)]
        same = (seen >= 0) & (b[who] - b[np.maximum(seen, 0)] == gap)
        length = np.where(same, np.maximum(out[np.maximum(seen, 0)] - gap, 0), 0)
        active = np.arange(len(who))
        while len(active):
            left, right = a[who[active]] + length[active], b[who[active]] + length[active]
            inside = (left < n) & (right < n) & (length[active] < most)
            active, left, right = active[inside], left[inside], right[inside]
            differ = words[left] != words[right]
            step = np.where(differ.any(1), differ.argmax(1), 8)
            step = np.minimum(step, n - np.maximum(left, right))
            length[active] += step
            active = active[(step == 8)]
        out[who] = np.minimum(length, most)
        known[who] = 1
    return out


def _pieces(rows):
    """Texts of a shard cut to their candidate runs: bytes, and for every allowed start its document and place there."""
    parts, owner, place, start, base = [], [], [], [], 0
    for d, (_, raw, runs) in enumerate(rows):
        pairs = np.frombuffer(runs, np.int32).reshape(-1, 2).astype(np.int64)
        pairs = pairs[np.argsort(pairs[:, 0])]
        # Neighbouring or overlapping texts of runs stay one piece.
        cut = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > pairs[:-1, 1] + LENGTH)))
        for i, j in zip(cut, np.append(cut[1:], len(pairs)), strict=True):
            lo, hi = int(pairs[i, 0]), int(pairs[j - 1, 1]) + LENGTH
            parts.append(np.frombuffer(raw, np.uint8)[lo:hi])
            allowed = np.concatenate([np.arange(x, y + 1) for x, y in pairs[i:j]])
            owner.append(np.full(len(allowed), d))
            place.append(allowed)
            start.append(allowed - lo + base)
            base += hi - lo
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return data, cat(owner), cat(place), cat(start)


def _fingerprints(data: np.ndarray, start: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, fingerprint) of the strings that begin at ``start``."""
    prints = window_hashes(data, LENGTH)[start]
    second = window_hashes(data, LENGTH, True)[start]
    return (second >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32), prints


def _distinct(block: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by block and fingerprint, and the places in it where a new pair begins."""
    by = np.lexsort((prints, block))
    new = np.concatenate(([True], (block[by][1:] != block[by][:-1]) | (prints[by][1:] != prints[by][:-1])))
    return by, np.flatnonzero(new)


def _shards(pieces: DataFrame, blocks: int) -> DataFrame:
    """Suffix arrays of all shards: (block, shard, sorted fingerprints, bits of those that repeat in the shard)."""

    def run(batches):
        import pyarrow as pa

        for shard, rows in deal.runs(batches, 0):
            data, _, _, start = _pieces([r[1:] for r in rows])
            if not len(start):
                continue
            rank = suffix_ranks(data, LENGTH)[start]
            order = np.argsort(rank, kind="stable")
            # Neighbours in the suffix array, in text order for Kasai's inequality.
            before = np.full(len(start), -1, np.int64)
            before[order[1:]] = order[:-1]
            has = np.flatnonzero(before >= 0)
            prefix = np.zeros(len(start), np.int64)
            prefix[has] = common_prefixes(data, start[has], start[before[has]], LENGTH)
            new = prefix[order] < LENGTH
            heads, again = order[new], np.bincount(np.cumsum(new) - 1) > 1
            block, prints = _fingerprints(data, start[heads], blocks)
            by, first = _distinct(block, prints)
            again = np.logical_or.reduceat(again[by], first)
            block, prints = block[by][first], prints[by][first]
            full, edges = np.unique(block, return_index=True)
            edges = np.append(edges, len(block))
            out = [prints[i:j].tobytes() for i, j in zip(edges, edges[1:], strict=False)]
            bits = [np.packbits(again[i:j]).tobytes() for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([shard] * len(out), pa.int64()), pa.array(out, pa.binary()), pa.array(bits, pa.binary())], names=["block", "shard", "prints", "bits"])
            del data, rank, order, before, has, prefix, prints, block
            release()

    return pieces.mapInArrow(run, "block int, shard long, prints binary, bits binary")


def _merge(runs: DataFrame) -> DataFrame:
    """(shard, block, bits): of each shard's run those that repeat in it or that binary search finds in another's."""

    def run(batches):
        import pyarrow as pa

        for block, rows in deal.runs(batches, 0):
            merged = np.sort(np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows]))
            twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
            shard, out = [], []
            for r in rows:
                own = np.frombuffer(r[2], np.uint64)
                hit = np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(own)).astype(bool)
                if len(twice):
                    at = np.minimum(np.searchsorted(twice, own), len(twice) - 1)
                    hit |= twice[at] == own
                if hit.any():
                    shard.append(r[1])
                    out.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array([block] * len(shard), pa.int32()), pa.array(out, pa.binary())], names=["shard", "block", "bits"])
        release()

    return runs.mapInArrow(run, "shard long, block int, bits binary")


def _marked(pieces: DataFrame, blocks: int) -> DataFrame:
    """(md5, n_removed, n_spans, kept_sha256, kept) of a shard's texts. Rows without text bring the bits of its runs."""

    def run(batches):
        import pyarrow as pa

        for _, rows in deal.runs(batches, 0):
            texts = [r[1:4] for r in rows if r[1] is not None]
            data, owner, place, start = _pieces(texts)
            hit = np.zeros(len(start), bool)
            if len(start):
                # The shard's distinct strings in the order in which their bits were sent.
                block, prints = _fingerprints(data, start, blocks)
                by, first = _distinct(block, prints)
                flags = np.zeros(len(first), bool)
                heads = block[by][first]
                for r in rows:
                    if r[5] is not None:
                        lo, hi = np.searchsorted(heads, [np.uint64(r[4]), np.uint64(r[4] + 1)])
                        flags[lo:hi] = np.unpackbits(np.frombuffer(r[5], np.uint8), count=hi - lo)
                hit[by] = np.repeat(flags, np.diff(np.append(first, len(by))))
            out = []
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            for d, (md5, raw, _) in enumerate(texts):
                part = slice(edges[d], edges[d + 1])
                own = place[part][hit[part]]
                covered = np.bincount(own, minlength=len(raw) + 1) - np.bincount(own + LENGTH, minlength=len(raw) + 1)
                gone = np.cumsum(covered)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1))
                out.append((md5, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["md5", "n_removed", "n_spans", "kept_sha256", "kept"])
            release()

    return pieces.mapInArrow(run, "md5 string, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256, n_passages; with ``keep_bytes`` also the bytes left.

    ``kept`` is null where nothing was removed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    scanned = scratch.keep(_scan(docs, id_col, text_col))
    replies = deal.recurring(scanned.where(F.col("kind").between(0, _PASSAGES - 1)), _OWNER).select("batch", F.lit(0).cast("long").alias("kind"), F.col("owners").alias("keys"), F.lit(None).cast("binary").alias("owners"))
    replies = replies.unionByName(scanned.where("kind = -2").select("batch", "kind", "keys", "owners"))
    found = _candidates(replies.repartition("batch").sortWithinPartitions("batch"))
    more = deal.counted(deal.recurring(scanned.where(F.col("kind") >= _PASSAGES), _TEXT), _TEXT)
    rows = scanned.where("kind = -1").select("batch", "idx", "doc_id", "n_bytes", "md5", "sha", "passages").join(more, ["batch", "idx"], "left")
    rows = scratch.keep(rows.withColumn("passages", F.col("passages") + F.coalesce("more", F.lit(0))).drop("more"))
    texts = rows.groupBy("md5").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    chosen = scratch.keep(found.join(rows, ["batch", "idx"]).groupBy("md5").agg(F.first("runs").alias("runs"), F.max("starts").alias("starts"), F.min("doc_id").alias("first_id"), F.max("n_bytes").alias("n_bytes")))
    scratch.drop(scanned)
    stats = chosen.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("starts"), F.lit(0))).first()
    few, shards, blocks = stats[0] <= BROADCAST_ROWS, max(1, -(-stats[1] // SHARD_BYTES)), max(1, -(-stats[2] * 8 // BLOCK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 100_000))
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    # The texts are found by id (a row per distinct text), then told apart by MD5; runs follow by a join of few rows.
    ids = small(chosen.select(F.col("first_id").alias("__first")).distinct())
    raws = own.join(ids, F.col("__id").eqNullSafe(F.col("__first")), "left_semi").select(F.md5("raw").alias("md5"), "raw").dropDuplicates(["md5"])
    shard = F.pmod(F.xxhash64("md5"), F.lit(shards)).alias("shard")
    pieces = scratch.keep(raws.join(chosen.select("md5", "runs"), "md5").select(shard, "md5", "raw", "runs"))
    count = max(1, min(int(shards), 100_000))
    sorted_runs = _shards(pieces.repartition(count, "shard").sortWithinPartitions("shard"), blocks)
    repeats = scratch.keep(_merge(sorted_runs.repartition(parts, "block").sortWithinPartitions("block")))
    none = lambda kind: F.lit(None).cast(kind)
    texts_of = pieces.withColumns({"block": none("int"), "bits": none("binary")})
    bits_of = repeats.select("shard", none("string").alias("md5"), none("binary").alias("raw"), none("binary").alias("runs"), "block", "bits")
    marked = _marked(texts_of.unionByName(bits_of).repartition(count, "shard").sortWithinPartitions("shard"), blocks)
    marked = scratch.keep(marked if keep_bytes else marked.drop("kept"))
    out = rows.join(texts.where("copies > 1").select("md5", "copies"), "md5", "left").join(marked, "md5", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    result = [
        F.col("doc_id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(whole, _EMPTY).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), F.col("passages").alias("n_passages"),
    ]
    if keep_bytes:
        result.append(F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*result)
