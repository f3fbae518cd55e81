"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix, with size-derived bounds.

Two documents link if their sets of five-word shingles overlap by 0.75 of their union or more. Overlaps are entries of the
product of the document by shingle incidence matrix with its transpose. Only entries that can reach the bound are formed:

1. Columns (shingle hashes) are dealt out in blocks (``deal``). A block finds which of its columns have two rows or more,
   and a document is left only if at least 0.75 of its own columns do: a smaller overlap can't reach the bound. Columns
   that recur within a batch are counted there and sent once, so a shingle of every document is no hot key.
2. Documents of equal sets are one row from here on.
3. Left rows order their columns by frequency, rarest first. Linked rows share a column among the first
   n - ceil(0.75 n) + 1, and only these columns propose which blocks of rows are multiplied.
4. A block of rows (residents) is multiplied by the rows that ask for it: column block by column block overlap counts are
   accumulated, and after each block the pairs go whose count, with all columns left, can't reach ceil(75 (a + b) / 175).
   What stays at the end is linked.
5. First each row asks for a few pivots of its columns, in rounds until the columns with unlinked rows stop getting
   fewer by half; this joins groups of near copies without all pairs. Then rows that share columns are dealt
   to homes of bounded size, and every row outside its column's main component asks for the homes of that column.

Of the links of a row with one component, one is given; within a known component none are looked for.

Cases: null, empty and wordless texts have no shingles and link with nothing; texts of fewer than five words are one
shingle; repeated rows and ids are rows of one class; a null id is never a component's id unless all are null; an empty
table gives an empty table; other columns are not read. Ids are whole numbers, or texts that can be cast to such.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import deal
from .common import Scratch, fresh, lower_ascii, release, shingle_hashes, slices, small_batches, span_hashes, word_spans
from .graph import components

#: Words in a shingle; percent of the union that must be shared.
WORDS, PERCENT = 5, 75
#: Code points shingled at a time; a longer text is a slice of its own.
SLICE = 1_500_000
#: Ids up to this number are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pivots of a column in the rounds; the last number holds for further rounds.
PIVOTS = (4, 16)
#: Column blocks of a product; shingles of the residents of a block of rows; rows that ask in one task.
COLUMN_BLOCKS, RESIDENT_SHINGLES, ASKING_ROWS = 4, 1_000_000, 4_000
#: Entries of a product (row pairs), and terms summed into them, at a time.
PRODUCT, TERMS = 2_000_000, 2_000_000
_OWNER = deal.OWNER["few"]
_BATCH_DOCS = 60_000


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    data = lower_ascii(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
    return np.unique(shingle_hashes(span_hashes(data, *word_spans(data)), WORDS))


def _need(n):
    """ceil(0.75 n): the least overlap of a set of n with any partner."""
    return F.ceil(F.col(n) * PERCENT / 100).cast("long")


_FIRST = "kind long, batch long, idx int, doc_id long, n long, fp_a long, fp_b long, md5 string, shared long, batches binary, counts binary, keys binary, owners binary"


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two numbers of a set."""
    if not len(s):
        return 0, 0
    return int(s.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)).view(np.int64))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (kind -1) and, for every batch and block of columns (kind), its columns and their owners."""
    schema_names = [c.split()[0] for c in _FIRST.split(", ")]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * 4)
        count = TaskContext.get().partitionId() << 32
        for arrow in batches:
            for ids, texts in slices(arrow.column(0).to_pylist(), arrow.column(1).to_pylist(), SLICE):
                for at in range(0, len(ids), _BATCH_DOCS):
                    keys, some = ids[at : at + _BATCH_DOCS], texts[at : at + _BATCH_DOCS]
                    sets = [shingles(t) for t in some]
                    sizes = [len(s) for s in sets]
                    tokens, owners, shared = deal.distinct(sets, _OWNER)
                    prints = [_fingerprint(s) for s in sets]
                    md5 = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in some]
                    rows = [(-1, count, i, k, int(n), *f, m, int(c), None, None, None, None) for i, (k, n, f, m, c) in enumerate(zip(keys, sizes, prints, md5, shared, strict=True))]
                    rows += [(r[0], count, *[None] * 7, *r[1:]) for r in deal.coarse_rows(tokens, owners, count)]
                    count += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema_names)
            release()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _FIRST)


def _sets(docs: DataFrame, left: DataFrame, id_col: str, text_col: str, few: bool) -> DataFrame:
    """(node, n, tokens) of the classes in ``left``: their texts are fetched by id and shingled again."""
    ids = left.select(F.col("first_id").alias("__first")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("__own"), F.col(text_col).cast("string").alias("__text"))
    texts = texts.join(F.broadcast(ids) if few else ids, F.col("__own").eqNullSafe(F.col("__first")), "left_semi")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, some in slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), SLICE):
                sets = [s for s in map(shingles, some) if len(s)]
                prints = [_fingerprint(s) for s in sets]
                a, b = [f[0] for f in prints], [f[1] for f in prints]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["fp_a", "fp_b", "n", "tokens"])
            release()

    found = texts.mapInArrow(run, "fp_a long, fp_b long, n long, tokens array<long>")
    nodes = left.select("node", "fp_a", "fp_b", "n")
    joined = found.join(F.broadcast(nodes) if few else nodes, ["fp_a", "fp_b", "n"])
    # Repeated ids bring a class more than once.
    return joined.groupBy("node", "n").agg(F.first("tokens").alias("tokens"))


def _entries(sets: DataFrame) -> DataFrame:
    """(token, node, n, pos, rows): the columns to join, with their place in the row's order and how many rows have them."""
    every = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = every.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    # Windows over a row's columns, not lists of them: what Spark sorts it can spill.
    own, rarest = Window.partitionBy("node"), Window.partitionBy("node").orderBy("rows", "token")
    rows = every.join(often, "token").withColumn("i", F.row_number().over(rarest)).withColumn("own", F.count("*").over(own))
    rows = rows.where((F.col("own") >= _need("n")) & (F.col("i") <= F.col("own") - _need("n") + 1))
    return rows.select("token", "node", "n", (F.col("n") - F.col("own") + F.col("i") - 1).alias("pos"), "rows")


def _possible(a: str, b: str):
    """The size and position bounds on a pair's overlap. ``a`` and ``b`` prefix n and pos."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    least = F.ceil((na + nb) * PERCENT / (100 + PERCENT))
    rest = F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos"))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & (rest >= least)


class Residents:
    """A block of rows of the incidence matrix, by column blocks, to be multiplied by rows that ask."""

    def __init__(self, nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, tokens: np.ndarray):
        self.nodes, self.labels, self.sizes = nodes, labels, sizes
        owner = np.repeat(np.arange(len(nodes)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        edges = np.searchsorted(tokens, _EDGES[1:])
        self.columns, self.owners = np.split(tokens, edges), np.split(owner, edges)
        own = np.stack([np.bincount(o, minlength=len(nodes)) for o in self.owners])
        self.rest = sizes - np.cumsum(own, 0)

    def linked(self, nodes, labels, sizes, tokens):
        """Yields arrays (asking nodes, residents) of linked pairs of unlike labels, one for each row and label."""
        step = max(1, PRODUCT // len(self.nodes))
        ends = np.cumsum(sizes)
        for i in range(0, len(nodes), step):
            part = slice(i, i + step)
            lo = int(ends[i - 1]) if i else 0
            yield self._linked(nodes[part], labels[part], sizes[part], tokens[lo : int(ends[min(i + step, len(nodes)) - 1])])

    def _linked(self, nodes, labels, sizes, tokens):
        n, m = sizes[:, None], self.sizes[None]
        alive = (labels[:, None] != self.labels[None]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        need = -(-PERCENT * (n + m) // (100 + PERCENT))
        counts = np.zeros(alive.size, np.int64)
        block, owner = (tokens >> _SHIFT).astype(np.int64), np.repeat(np.arange(len(nodes)), sizes)
        left = sizes.copy()
        for b in range(COLUMN_BLOCKS):
            inside = block == b
            left = left - np.bincount(owner[inside], minlength=len(nodes))
            inside &= alive.any(1)[owner]
            if inside.any():
                self._add(counts, b, tokens[inside], owner[inside])
            alive &= counts.reshape(alive.shape) + np.minimum(left[:, None], self.rest[b][None]) >= need
            if not alive.any():
                break
        row, at = np.nonzero(alive)
        _, first = np.unique(np.stack([row, self.labels[at]]), axis=1, return_index=True)
        return nodes[row[first]], self.nodes[at[first]]

    def _add(self, counts, b, tokens, owner):
        """Add the terms of one column block to the overlap counts."""
        columns, rows = self.columns[b], self.owners[b]
        start = np.searchsorted(columns, tokens, "left")
        many = np.searchsorted(columns, tokens, "right") - start
        hit = many > 0
        start, many, owner = start[hit], many[hit], owner[hit]
        ends = np.cumsum(many)
        i = 0
        while i < len(many):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + TERMS, "right")))
            k = many[i:j]
            at = np.arange(int(ends[j - 1]) - done) - np.repeat(ends[i:j] - k - done - start[i:j], k)
            pair = np.repeat(owner[i:j] * len(self.nodes), k) + rows[at]
            if len(pair) * 8 < len(counts):
                np.add.at(counts, pair, 1)
            else:
                counts += np.bincount(pair, minlength=len(counts))
            i = j


#: A column's block is its leading bits.
_SHIFT = np.uint64(64 - (COLUMN_BLOCKS - 1).bit_length())
_EDGES = np.arange(COLUMN_BLOCKS, dtype=np.uint64) << _SHIFT


def _product(asks: DataFrame, members: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Links (a, b) between the asking nodes of a block of rows (block, part, salt, node) and its members (block, part, node).

    A block is sent to each salt that asks for it, so many asking rows are many tasks; its rows come before those that ask.
    """
    wanted = asks.select("block", "part", "salt").distinct()
    rows = asks.withColumn("role", F.lit(1)).unionByName(members.join(wanted, ["block", "part"]).withColumn("role", F.lit(0)))
    rows = rows.join(sets.select("node", "n", "tokens"), "node")
    rows = rows.join(labels, "node", "left") if labels is not None else rows.withColumn("label", F.lit(None).cast("long"))
    rows = rows.select("block", "part", "salt", "role", "node", F.coalesce("label", "node").alias("label"), "tokens")

    def run(batches):
        import pyarrow as pa

        now, held, residents = None, [], None
        for batch in batches:
            *key, node, label = (batch.column(i).to_numpy() for i in range(6))
            lists = batch.column(6)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy().view(np.uint64)
            key = np.stack([k.astype(np.int64) for k in key])
            cut = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
            a, b = [], []
            for i, j in zip(cut, np.append(cut[1:], batch.num_rows), strict=True):
                own, role = tuple(key[:3, i]), key[3, i]
                if own != now:
                    now, held, residents = own, [], None
                some = (node[i:j], label[i:j], np.diff(offsets[i : j + 1]), values[offsets[i] : offsets[j]])
                if role == 0:
                    held.append([x.copy() for x in some])
                elif held:
                    residents = residents or Residents(*[np.concatenate(x) for x in zip(*held, strict=True)])
                    for x, y in residents.linked(*some):
                        a.append(x)
                        b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        release()

    small_batches(sets.sparkSession)
    return rows.repartition("block", "part", "salt").sortWithinPartitions("block", "part", "salt", "role").mapInArrow(run, "a long, b long")


def _salt():
    """Rows that ask for one block are dealt by the number of rows of the column that led them there."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col("rows") / ASKING_ROWS).cast("long"))


def classes_and_labels(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text"):
    """(rows, components, scratch): a row per document with its class, and class to component id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram")
    scanned = scratch.keep(_scan(docs, id_col, text_col))
    more = deal.counted(deal.recurring(scanned.where("kind >= 0"), _OWNER), _OWNER)
    rows = scanned.where("kind = -1").select("batch", "idx", "doc_id", "n", "fp_a", "fp_b", "md5", "shared")
    counted = rows.join(more, ["batch", "idx"], "left").withColumn("shared", F.col("shared") + F.coalesce("more", F.lit(0))).drop("more")
    rows = scratch.keep(counted)
    scratch.drop(scanned)
    classes = rows.where("n > 0").groupBy("fp_a", "fp_b", "n").agg(F.min("doc_id").alias("first_id"), F.max("shared").alias("shared"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()))
    left = classes.where(F.col("shared") >= _need("n"))
    few = left.count() <= BROADCAST_ROWS
    sets = scratch.keep(_sets(docs, left, id_col, text_col, few))
    entries = scratch.keep(_entries(sets))
    labels = _label(entries, sets, scratch)
    scratch.drop(entries, sets)
    # The component's id is the smallest document id of its classes.
    known = classes.join(labels, "node")
    best = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = known.join(best, "label").select("fp_a", "fp_b", "n", "component_id")
    classes = classes.join(found, ["fp_a", "fp_b", "n"], "left").withColumn("component_id", F.coalesce("component_id", "first_id"))
    joined = rows.join(classes.select("fp_a", "fp_b", "n", F.col("component_id").alias("c")), ["fp_a", "fp_b", "n"], "left")
    return joined.withColumn("component_id", F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id"))).drop("c"), scratch


def _label(entries: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all linked nodes."""
    links = labels = before = None
    spent = []
    for i in itertools.count():
        open_ = scratch.keep(_open(entries, labels, scratch))
        spent.append(open_)
        now = open_.count()
        if not now:
            return labels if labels is not None else scratch.keep(components(open_.select(F.col("node").alias("a"), F.col("node").alias("b")), scratch))
        if i >= len(PIVOTS) and now > before / 2:
            break
        before = now
        pairs = _pivots(open_, PIVOTS[min(i, len(PIVOTS) - 1)], i, scratch)
        members = pairs.select("block", "part", F.col("block").alias("node")).distinct()
        new = scratch.keep(_product(pairs, members, sets, labels))
        links = new if links is None else links.unionByName(new)
        labels = scratch.keep(components(links, scratch))
    new = scratch.keep(_product(*_homes(open_, scratch), sets, labels))
    if new.limit(1).count():
        labels = scratch.keep(components(links.unionByName(new), scratch))
    scratch.drop(*spent)
    return labels


def _open(entries: DataFrame, labels: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Entries with labels, in columns whose rows have more than one label.

    What is known of columns is written first: then Spark knows its size, and may broadcast it or split a hot column.
    """
    if labels is None:
        return entries.withColumn("label", F.col("node"))
    named = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = scratch.keep(named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
    return named.join(mixed, "token", "left_semi")


def _pivots(open_: DataFrame, pivots: int, seed: int, scratch: Scratch) -> DataFrame:
    """(block, part, salt, node): each row with a pivot of each of its columns; a column has one of ``pivots`` orders of rows."""
    order = F.xxhash64("node", F.lit(seed), F.pmod("token", F.lit(pivots)))
    pivot = open_.groupBy("token").agg(F.min(F.struct(order.alias("h"), "node", "n", "pos", "label")).alias("p"))
    pivot = scratch.keep(pivot.select("token", *[F.col(f"p.{c}").alias(f"p{c}") for c in ("node", "n", "pos", "label")]))
    met = open_.join(pivot, "token").where((F.col("label") != F.col("plabel")) & _possible("", "p"))
    pairs = met.groupBy("node", F.col("pnode").alias("block")).agg(F.max("rows").alias("rows"))
    return scratch.keep(pairs.select("block", F.lit(0).alias("part"), _salt().alias("salt"), "node"))


def _homes(open_: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Asking rows and members of the homes that hold all open rows.

    A row's home is the first of its columns' first rows, in one order of all rows, so rows with common columns crowd in few
    homes; a large home has parts. Of two linked rows of unlike labels one is, in a common column, outside the column's main
    component, and asks for the other's home.
    """
    order = F.struct(F.xxhash64("node").alias("h"), "node")
    first = scratch.keep(open_.groupBy("token").agg(F.min(order).alias("first")))
    homes = scratch.keep(open_.join(first, "token").groupBy("node", "n").agg(F.min("first").alias("first")).select("node", "n", F.col("first.node").alias("block")))
    parts = scratch.keep(homes.groupBy("block").agg(F.ceil(F.sum("n") / RESIDENT_SHINGLES).cast("int").alias("parts")))
    homes = scratch.keep(homes.join(parts, "block"))
    members = homes.select("block", F.pmod(F.xxhash64("node", F.lit(1)), "parts").cast("int").alias("part"), "node")
    counts = open_.groupBy("token", "label").agg(F.count("*").alias("k"))
    main = scratch.keep(counts.groupBy("token").agg(F.max(F.struct("k", "label")).alias("m")).select("token", F.col("m.label").alias("main")))
    there = scratch.keep(open_.select("token", "node").join(homes.select("node", "block", "parts"), "node").select("token", "block", "parts").distinct())
    minor = open_.join(main, "token").where("label <> main").select("token", "node", "rows")
    asks = minor.join(there, "token").groupBy("node", "block").agg(F.max("rows").alias("rows"), F.max("parts").alias("parts"))
    asks = asks.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), _salt().alias("salt"), "node")
    return scratch.keep(asks), scratch.keep(members)


def join_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    rows, _ = classes_and_labels(docs, id_col=id_col, text_col=text_col)
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id, of equal ids the one of smallest MD5.

    Documents without shingles stay. Rows that agree in id and text are one document.
    """
    rows, scratch = classes_and_labels(docs, id_col=id_col, text_col=text_col)
    rows = scratch.keep(rows.where("n > 0").select("doc_id", "md5", "component_id", "fp_a", "fp_b"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat_ws(":", "fp_a", "fp_b"))
    rows = rows.withColumn("group", group)
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "md5")).alias("best"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "md5")
    best_key = F.concat_ws(":", F.coalesce(F.col("best.doc_id").cast("string"), F.lit("")), "best.md5")
    joined = rows.join(best, "group").groupBy(key.alias("key")).agg(F.max((key == best_key).cast("int")).alias("stays"), F.count("*").alias("rows"))
    keys = scratch.keep(joined.where("stays = 0 or rows > 1"))
    text_md5 = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    [name] = fresh(docs, "__key")
    own = docs.withColumn(name, F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), text_md5))
    few = keys.count() <= BROADCAST_ROWS
    size = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    out = own.join(size(keys.select(F.col("key").alias(name))), name, "left_anti")
    again = keys.where("stays = 1").select(F.col("key").alias(name))
    if again.limit(1).count():
        out = out.unionByName(own.join(size(again), name, "left_semi").dropDuplicates([name]))
    return out.select(*docs.columns)
