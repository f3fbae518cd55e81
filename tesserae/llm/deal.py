"""Which keys recur in other batches: keys are dealt to blocks in two levels, and the answers go back to their owners.

A batch (a slice of documents read by one task) sends each of its distinct keys once, with the number of the owner in the
batch. Keys are first cut by their top byte into ``COARSE`` runs, whatever the table's size. Once these are written, their
bytes are known; if a coarse block holds more than ``BLOCK_BYTES``, the runs of many batches are gathered and cut again
by the next bits. So rows stay in proportion to the keys, and a task holds one block only. Of a key 48 bits are compared:
a chance likeness lets a key pass that a later exact step rejects, and never hides one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Blocks of the first level: the top byte of a key.
COARSE = 256
#: Bytes of keys and owners in one block of the second level, and gathered before they are cut again.
BLOCK_BYTES = 8 << 20
#: Owners are numbers of this type; its largest stands for a key that its batch has more than once and needs no answer.
OWNER = {"few": np.uint16, "many": np.uint32}
#: Bytes sent of a key below its top byte.
WIDTH = 5


def pack(keys: np.ndarray) -> bytes:
    """The five bytes below the top one of each 64-bit key."""
    return (keys >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def distinct(sets: list[np.ndarray], owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, owners, shared) of a batch's sets of keys: its sorted distinct keys with the number of their set, and how many
    keys of each set another set of the batch has too; these have no owner."""
    sizes = [len(s) for s in sets]
    keys, owners = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owners = keys[order], owners[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    twice = np.bincount(np.cumsum(first) - 1, minlength=1)[np.cumsum(first) - 1] > 1 if len(keys) else first
    shared = np.bincount(owners[twice], minlength=len(sets))
    return keys[first], np.where(twice, np.iinfo(owner).max, owners)[first].astype(owner), shared


def counted(replies: DataFrame, owner) -> DataFrame:
    """(batch, idx, more): of each set of a batch, how many keys other batches have too. ``replies``: those of ``recurring``."""

    def run(batches):
        import pyarrow as pa

        for batch, rows in runs(batches, 0):
            owners, counts = np.unique(np.concatenate([np.frombuffer(r[1], owner) for r in rows]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([batch] * len(owners), pa.int64()), pa.array(owners.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["batch", "idx", "more"])

    return replies.repartition("batch").sortWithinPartitions("batch").mapInArrow(run, "batch long, idx int, more long")


def unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return wide.view(np.uint64).ravel()


def _spans(start: np.ndarray, end: int) -> list[tuple[int, int]]:
    """(first, after the last) of runs that begin at ``start``."""
    edges = [*start.tolist(), end]
    return list(zip(edges, edges[1:], strict=False))


def coarse_rows(keys: np.ndarray, owners: np.ndarray, batch: int) -> list[tuple]:
    """Rows (kind, batches, counts, keys, owners) of a batch's sorted distinct 64-bit keys. ``owners`` has a type of ``OWNER``."""
    block = (keys >> np.uint64(56)).astype(np.int64)
    kinds, start = np.unique(block, return_index=True)
    own = np.array([batch], np.int64).tobytes()
    return [(int(k), own, np.array([j - i], np.int64).tobytes(), pack(keys[i:j]), owners[i:j].tobytes()) for k, (i, j) in zip(kinds, _spans(start, len(keys)), strict=True)]


def runs(batches, key: int):
    """Rows of sorted Arrow batches, gathered by the value of column ``key``."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _arrow(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["kind", "batches", "counts", "keys", "owners"])


def _cut_again(blobs: DataFrame, fine: int, owner) -> DataFrame:
    """Runs of one coarse block, gathered over batches and cut into ``fine`` blocks by the next bits."""

    def cut(kind, rows):
        keys = np.concatenate([unpack(r[3]) for r in rows])
        owners = np.concatenate([np.frombuffer(r[4], owner) for r in rows])
        batch = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64)) for r in rows])
        part = ((keys >> np.uint64(8)) * np.uint64(fine) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((batch, part))
        keys, owners, batch, part = keys[order], owners[order], batch[order], part[order]
        parts, start = np.unique(part, return_index=True)
        out = []
        for p, (i, j) in zip(parts, _spans(start, len(keys)), strict=True):
            own, counts = np.unique(batch[i:j], return_counts=True)
            out.append((kind * fine + int(p), own.tobytes(), counts.astype(np.int64).tobytes(), pack(keys[i:j] << np.uint64(16)), owners[i:j].tobytes()))
        return _arrow(out)

    def run(batches):
        now, rows, size = None, [], 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (row[0] != now or size > BLOCK_BYTES):
                    yield cut(now, rows)
                    rows, size = [], 0
                now = row[0]
                rows.append(row)
                size += len(row[3]) + len(row[4])
        if rows:
            yield cut(now, rows)
        release()

    return blobs.mapInArrow(run, "kind long, batches binary, counts binary, keys binary, owners binary")


def _answers(blobs: DataFrame, owner) -> DataFrame:
    """(batch, owners): of the keys that two batches hold, the owners, block by block."""

    def run(batches):
        import pyarrow as pa

        for _, rows in runs(batches, 0):
            keys = np.concatenate([unpack(r[3]) for r in rows])
            owners = np.concatenate([np.frombuffer(r[4], owner) for r in rows])
            batch = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64)) for r in rows])
            del rows
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            same = np.concatenate(([False], keys[1:] == keys[:-1], [False]))
            hit = order[(same[1:] | same[:-1]) & (owners[order] != np.iinfo(owner).max)]
            hit.sort()
            owners, batch = owners[hit], batch[hit]
            order = np.argsort(batch, kind="stable")
            owners, batch = owners[order], batch[order]
            own, start = np.unique(batch, return_index=True)
            out = [owners[i:j].tobytes() for i, j in _spans(start, len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(out, pa.binary())], names=["batch", "owners"])
        release()

    return blobs.mapInArrow(run, "batch long, owners binary")


def recurring(blobs: DataFrame, owner) -> DataFrame:
    """(batch, owners) of the keys that other batches hold too. ``blobs``: a written table of ``coarse_rows``."""
    conf = blobs.sparkSession.conf
    blobs = blobs.select("kind", "batches", "counts", "keys", "owners")
    size = F.octet_length("keys") + F.octet_length("owners")
    most, total = blobs.groupBy("kind").agg(F.sum(size).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * BLOCK_BYTES)))
    fine = -(-most // BLOCK_BYTES)
    if fine > 1:
        # Any task may cut any rows of a block: a salt keeps one block from being one task.
        salt = F.pmod(F.xxhash64("batches"), F.lit(fine))
        blobs = _cut_again(blobs.repartition(parts, "kind", salt).sortWithinPartitions("kind"), fine, owner)
    return _answers(blobs.repartition(parts, "kind").sortWithinPartitions("kind"), owner)
