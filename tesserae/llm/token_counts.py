"""Token counts that follow edits: a segment tree of pre-tokens for each document.

The leaves of a document's tree are blocks of pre-tokens with their lengths and token counts; inner nodes hold sums.
An edit descends by lengths to the touched leaves. Pre-tokens are split again from a boundary at least two characters
before the edit (a pre-token's end depends on two characters beyond it at most) until a new boundary falls on an old
one behind the edit: from there on the split is the old one. Only these pre-tokens are encoded again, and only the
sums above their leaves change.

Cases: null text is empty; edits beyond the text are cut to it, null or reversed ranges are empty ranges, a null
replacement is empty; edits apply in order of ``seq``, then start, end and replacement, each to the text left by the
one before; documents without edits keep their counts; edits of unknown documents are ignored; rows of equal id get
the same edits; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_path, default_pattern
from .common import release, slices, small_batches

#: Pre-tokens in a leaf when a tree is built; a leaf of four times as many makes it be built anew.
LEAF = 64
#: Characters before an edit on which the split of what precedes may depend.
CONTEXT = 2


class Tree:
    """Sums of lengths and tokens over leaves of pre-tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.leaves):
            self.width *= 2
        self.chars, self.tokens, self.parts = ([0] * (2 * self.width) for _ in range(3))
        for i, (lengths, counts) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i], self.parts[self.width + i] = sum(lengths), sum(counts), len(counts)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        for sums in (self.chars, self.tokens, self.parts):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pre_tokens(self) -> int:
        return self.parts[1]

    def find(self, at: int) -> tuple[int, int]:
        """The last leaf that begins at ``at`` or before, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Leaves ``first`` to ``last`` hold these pre-tokens from now on."""
        if len(lengths) > 4 * LEAF * (last - first + 1):
            fresh = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)]
            self.leaves[first : last + 1] = fresh
            self._build()
            return
        each = -(-len(lengths) // (last - first + 1)) or 1
        touched = set()
        for k, leaf in enumerate(range(first, last + 1)):
            own = lengths[k * each : (k + 1) * each], counts[k * each : (k + 1) * each]
            self.leaves[leaf] = own
            node = self.width + leaf
            self.chars[node], self.tokens[node], self.parts[node] = sum(own[0]), sum(own[1]), len(own[1])
            touched.add(node // 2)
        while touched and touched != {0}:
            for node in touched:
                self._sum(node)
            touched = {node // 2 for node in touched if node > 1}


class Counter:
    """A document whose token count follows its edits."""

    def __init__(self, text: str, split, count):
        """``split`` gives the matches of the pattern from a place on; ``count`` the tokens of pre-tokens."""
        self.text, self.split, self.count = text, split, count
        parts = [m[0] for m in split(text, 0)]
        self.tree = Tree([len(p) for p in parts], count(parts))
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.tree.total

    def edit(self, start: int | None, end: int | None, replacement: str | None) -> None:
        n, new = len(self.text), replacement or ""
        start = min(max(start or 0, 0), n)
        end = min(max(end if end is not None else start, start), n)
        delta = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        tree = self.tree
        first, begin = tree.find(max(0, start - CONTEXT))
        lengths, counts = tree.leaves[first]
        starts = list(accumulate(lengths, initial=begin))
        keep = max(0, bisect_right(starts, max(0, start - CONTEXT)) - 1)
        keep = min(keep, len(lengths))
        at = starts[keep]
        head = lengths[:keep], counts[:keep]
        # Old boundaries from here on, leaf by leaf as they are needed.
        last, old = first, starts[keep:]
        old_lengths, old_counts = list(lengths[keep:]), list(counts[keep:])
        fresh, place, i = [], at, 0
        tail: tuple[list, list] = ([], [])
        synced = False
        for m in self.split(self.text, at):
            if place >= start + len(new):
                where = place - delta
                while old[-1] < where and last + 1 < len(tree.leaves):
                    last += 1
                    more = tree.leaves[last]
                    old += list(accumulate(more[0], initial=old[-1]))[1:]
                    old_lengths += more[0]
                    old_counts += more[1]
                while i < len(old) and old[i] < where:
                    i += 1
                if i < len(old) and old[i] == where and where >= end:
                    tail = old_lengths[i:], old_counts[i:]
                    synced = True
                    break
            fresh.append(m[0])
            place += len(m[0])
        if not synced:
            last = len(tree.leaves) - 1
        self.encoded += len(fresh)
        tree.replace(first, last, head[0] + [len(p) for p in fresh] + tail[0], head[1] + self.count(fresh) + tail[1])


def count_tokens(docs: DataFrame, edits: DataFrame | None = None, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_tokens_edited, n_pre_tokens and n_encoded_again (pre-tokens that edits made be encoded).

    ``edits``: (id, seq, start, end, replacement), in code points; or ``docs`` has an array of such structs
    (seq, start, end, replacement) in ``edits_col``. A document's edits are gathered in its row.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    path, pattern = path or default_path(), pattern or default_pattern()
    if pattern != default_pattern() and (edits is not None or edits_col is not None):
        raise ValueError("how far an edit reaches is known for the default pattern only")
    edit = "array<struct<seq: bigint, start: bigint, end: bigint, replacement: string>>"
    if edits is not None:
        lists = edits.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "replacement"))).cast(edit).alias("__edits"))
        own = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text"))
        rows = own.join(lists, F.col("__doc") == F.col("__id"), "left").select("__doc", "__text", "__edits")
    elif edits_col is not None:
        rows = docs.select(id_col, F.col(text_col).cast("string"), F.array_sort(edits_col).cast(edit).alias("__edits"))
    else:
        rows = docs.select(id_col, F.col(text_col).cast("string"), F.lit(None).cast(edit).alias("__edits"))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *StructType.fromDDL("n_tokens long, n_tokens_edited long, n_pre_tokens long, n_encoded_again long")])
    arrow = to_arrow_schema(schema)

    def run(batches):
        import regex

        c = codec(path, pattern)
        split = regex.compile(pattern).finditer

        def count(parts):
            sizes = {p: len(b) // 4 for p, b in c._pre_tokens(set(parts)).items()}
            return [sizes[p] for p in parts]

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for some, texts in slices(keys, batch.column(1).to_pylist(), 2_000_000):
                found = [c.find(t) if t else [] for t in texts]
                known = {p: len(b) // 4 for p, b in c._pre_tokens(set().union(*found)).items()}
                out = []
                for (key, changes), text, parts in zip(some, texts, found, strict=True):
                    total = edited = sum([known[p] for p in parts])
                    again = 0
                    if changes:
                        d = Counter.__new__(Counter)
                        d.text, d.split, d.count, d.encoded = text or "", split, count, 0
                        d.tree = Tree([len(p) for p in parts], [known[p] for p in parts])
                        for e in changes:
                            if e is not None:
                                d.edit(e["start"], e["end"], e["replacement"])
                        edited, again = d.total, d.encoded
                    out.append((key, total, edited, len(parts), again))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)
            release()
        c.forget()
        release()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)
