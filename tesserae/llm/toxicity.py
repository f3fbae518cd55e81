"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with boundary marks) and itself, each hashed to a row of one embedding
table; a window of ``WINDOW`` words is the average of its words' bags; a linear softmax over that average gives the
window's class. A text's score is the larger of two margins: the mean of its worst ``SHARE`` of windows (one at least),
where a chance likeness in a long text is not enough, and the mean of its worst run of ``RUN`` words, at any start, so
that a passage is judged alike however long the rest of the text is. Embeddings and softmax are
trained together by gradient steps; a text teaches by its worst windows, a clean one also by others. Unseen misspellings share n-grams, hence vectors, with seen words.

As softmax and average are linear, each word brings one number, which scoring remembers: the pass over the corpus
looks words up and takes running means.

Cases: null and empty texts and texts without words get the bias-only score; texts are scored whole, words without white
space too: a word above ``PIECE`` code points is a run of overlapping pieces, which are words of the windows; equal texts get
equal scores; labels for missing documents, null labels and repeated label rows are allowed (the largest label of a
document counts); without labels of both classes every score is the smoothed share of positives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts, mix64, release, slices, small_batches, span_hashes
from .gbt import platt

#: Rows of the embedding table, vector length, n-gram lengths, words in a window, share of the windows that count.
BUCKETS, DIM, GRAMS, WINDOW, SHARE = 1 << 17, 8, (3, 4, 5, 6), 2, 0.02
#: Words of a passage that counts by itself.
RUN = 10
#: At most so many labelled rows of each class, and so many code points of their texts, fit the model: those of smallest
#: crc32(doc_id), whatever the table's size. A text is taken whole or not at all; the first one always is.
FIT_ROWS, FIT_TEXT = 1500, 12_000_000
EPOCHS, RATE, SEED = 5, 0.3, 5
#: Longer words are taken as pieces of so many code points that overlap by ``max(GRAMS) - 1``: no n-gram is lost.
PIECE = 16
#: Words (and pieces) hashed at a time.
PART = 20_000
#: Words remembered with their number per worker; beyond it the memory starts anew.
CACHE = 120_000
_EDGE = ".,;:!?\"'()[]{}|#*$%&<>"


def words_of(text: str) -> list[str]:
    """A text's words; a word above ``PIECE`` code points is its pieces. A space at a piece's end marks a cut there."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [p for w in words for p in (_pieces(w) if len(w) > PIECE else (w,))]


def _pieces(word: str) -> list[str]:
    word = word.strip(_EDGE) or word
    if len(word) <= PIECE:
        return [word]
    lap = max(GRAMS) - 1
    starts = range(0, len(word) - lap, PIECE - lap)
    return [(" " if i else "") + word[i : i + PIECE] + (" " if i + PIECE < len(word) else "") for i in starts]


def _marked(word: str) -> str:
    """The word between boundary marks and without edge signs; a piece has marks only where its word ends."""
    if " " in word:
        return ("" if word[0] == " " else "<") + word.strip(" ") + ("" if word[-1] == " " else ">")
    return "<" + (word.strip(_EDGE) or word) + ">"


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all words' bags, one word after the other, and how many rows each word has.

    A bag holds a word's n-grams between boundary marks and the word itself. Edge signs don't count. Words are taken
    ``PART`` at a time, which bounds memory.
    """
    parts = [_bags(words[i : i + PART]) for i in range(0, len(words), PART)] or [_bags([])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [_marked(w) for w in words]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(m) for m in marked])
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    word_of = np.repeat(np.arange(len(words)), ends - starts)
    left = ends[word_of] - np.arange(len(chars))
    rows, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        last = np.concatenate((chars[n - 1 :], np.zeros(n - 1, np.uint64)))
        h = (h + last) * _MIX
        if n in GRAMS:
            ok = left >= n
            rows.append(_row(h[ok] + np.uint64(n)))
            owners.append(word_of[ok])
    rows.append(_row(span_hashes(chars, starts, ends)))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows)[order], np.bincount(owner, minlength=len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _row(h: np.ndarray) -> np.ndarray:
    return (mix64(h) & np.uint64(BUCKETS - 1)).astype(np.int32)


class Model:
    """A number per embedding row (its vector times the softmax's difference) and a bias, beside the vectors."""

    def __init__(self, table, weight, bias, scale=(1.0, 0.0)):
        self.table, self.weight, self.bias, self.scale = table, weight, bias, scale
        self.unit = (table @ (weight[:, 1] - weight[:, 0])).astype(np.float32)

    def __getstate__(self):
        return {"unit": self.unit, "bias": self.bias, "scale": self.scale}

    def __setstate__(self, state):
        self.__dict__.update(state, table=None, weight=None)

    def scorer(self):
        """A function from texts to their scores. It remembers words' numbers."""
        unit, bias, (a, b) = self.unit, float(self.bias[1] - self.bias[0]), self.scale
        memory: dict[str, float] = {}

        def score(words: list[str]) -> float:
            if not words:
                z = 0.0
            else:
                x = np.array([memory[w] for w in words])
                start = _windows(len(x))
                means = np.add.reduceat(x, start) / np.minimum(WINDOW, len(x) - start)
                k = _top(len(start))
                z = means.max() if k == 1 else np.partition(means, len(means) - k)[-k:].mean()
                if len(x) > RUN:
                    total = np.cumsum(x)
                    z = max(z, total[RUN - 1] / RUN, (total[RUN:] - total[:-RUN]).max() / RUN)
            return float(1 / (1 + np.exp(-np.clip(a * (z + bias) + b, -30, 30))))

        def scores(texts) -> list[float]:
            split = [words_of(t) if t else [] for t in texts]
            wanted = set().union(*split)
            new = list(wanted.difference(memory))
            if len(memory) + len(new) > CACHE:
                memory.clear()
                new = list(wanted)
            for i in range(0, len(new), PART):
                part = new[i : i + PART]
                rows, sizes = _bags(part)
                numbers = np.add.reduceat(unit[rows], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes
                memory.update(zip(part, numbers.tolist(), strict=True))
            return [score(w) for w in split]

        return scores


def _windows(n: int) -> np.ndarray:
    return np.arange(0, max(1, n), WINDOW)


def _top(n: int) -> int:
    """How many of ``n`` windows make a text's score: the worst ``SHARE`` of them, one at least."""
    return max(1, int(np.ceil(SHARE * n)))


def fit(texts: list[str], labels, seed: int = SEED) -> Model:
    """Joint training of the embedding table and the softmax by AdaGrad steps on chosen windows.

    Each epoch chooses a text's worst windows under the model so far (at first: under log ratios of n-gram counts),
    and some others of clean texts.
    """
    y = np.asarray(labels, int)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
    weight = rng.uniform(-0.5, 0.5, (DIM, 2))
    share = (y.sum() + 1) / (len(y) + 2)
    bias = np.array([0.0, np.log(share / (1 - share))])
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t or "")], np.int64) for t in texts]
    if not len(y) or y.min() == y.max() or not vocabulary:
        return Model(np.zeros_like(table), weight, bias)
    flat, sizes = bags(list(vocabulary))
    offsets = np.concatenate(([0], np.cumsum(sizes)))

    def by_word(unit):
        return np.add.reduceat(unit[flat], offsets[:-1]) / sizes

    # Windows as runs in one sequence of word numbers.
    words = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs])
    starts = np.concatenate([_windows(len(d)) + e - len(d) for d, e in zip(docs, ends, strict=True) if len(d)])
    owner = np.searchsorted(ends, starts, side="right")
    length = np.minimum(starts + WINDOW, ends[owner]) - starts
    most = np.array([_top(len(_windows(len(d)))) for d in docs])[owner]
    positive = y[owner] == 1

    counts = np.full((2, BUCKETS), 3.0)
    for d, ids in enumerate(docs):
        if len(ids):
            own = np.unique(ids)
            at = np.repeat(offsets[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
            counts[y[d], np.unique(flat[at])] += 1
    unit = np.log(counts[1] / (y.sum() + 3)) - np.log(counts[0] / ((1 - y).sum() + 3))
    squares, squares_w = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8)
    for _ in range(EPOCHS):
        number = by_word(unit)
        total = np.concatenate(([0.0], np.cumsum(number[words])))
        strength = (total[starts + length] - total[starts]) / length
        order = np.lexsort((-strength, owner))
        first = np.concatenate(([True], owner[order][1:] != owner[order][:-1]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        chosen = np.flatnonzero((rank < most) | (~positive & (rng.random(len(rank)) < 0.05)))
        rng.shuffle(chosen)
        share_pos = min(max(positive[chosen].mean(), 0.02), 0.98)
        for part in np.array_split(chosen, max(1, len(chosen) // 1024)):
            at = np.repeat(starts[part] - np.concatenate(([0], np.cumsum(length[part])[:-1])), length[part]) + np.arange(length[part].sum())
            ids = words[at]
            row_of = np.repeat(np.arange(len(part)), length[part])
            used, back = np.unique(ids, return_inverse=True)
            begin = np.concatenate(([0], np.cumsum(sizes[used])))
            rows = flat[np.repeat(offsets[used] - begin[:-1], sizes[used]) + np.arange(begin[-1])]
            vectors = np.add.reduceat(table[rows], begin[:-1], axis=0) / sizes[used][:, None]
            edges = np.concatenate(([0], np.cumsum(length[part])[:-1]))
            mean = np.add.reduceat(vectors[back], edges, axis=0) / length[part][:, None]
            z = mean @ weight + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), positive[part].astype(int)] -= 1
            p *= np.where(positive[part], 0.5 / share_pos, 0.5 / (1 - share_pos))[:, None]
            grad_w, grad_mean = mean.T @ p, (p @ weight.T) / length[part][:, None]
            grad_vec = _sum_rows(back, grad_mean[row_of], len(used)) / sizes[used][:, None]
            touched, where = np.unique(rows, return_inverse=True)
            g = _sum_rows(where, grad_vec[np.repeat(np.arange(len(used)), sizes[used])], len(touched))
            squares[touched] += (g * g).mean(1)
            table[touched] -= RATE * g / np.sqrt(squares[touched])[:, None]
            squares_w += grad_w * grad_w
            weight -= RATE * grad_w / np.sqrt(squares_w)
            bias -= 0.02 * p.mean(0)
        unit = table @ (weight[:, 1] - weight[:, 0])
    model = Model(table, weight, bias)
    scores = model.scorer()
    p = np.clip([s for _, part in slices(texts, texts, 2_000_000) for s in scores(part)], 1e-12, 1 - 1e-12)
    margin = np.log(p / (1 - p))
    model.scale = platt(margin, y.astype(float))
    return model


def _sum_rows(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, values[:, k], n) for k in range(values.shape[1])], 1)


def fit_labels(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on labelled rows outside the held-out quarter (crc32 of the id as text, modulo 4, is 2), ``rows`` per class at most."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (crc % 4 != 2))
    known = known.groupBy(id_col).agg(F.max(label_col).alias("__y"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(crc, id_col).limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    got = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    got = got.groupBy(id_col).agg(F.max("__y").alias("__y"), F.max(text_col).alias("__text"))
    # A window over the few chosen rows of a class: the driver gets no more text than the bound.
    order = Window.partitionBy("__y").orderBy(crc, id_col).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce(F.length("__text"), F.lit(0))).over(order), F.lit(0))
    size = F.coalesce(F.length("__text"), F.lit(0))
    got = got.withColumns({"__before": before, "__size": size}).where((F.col("__before") == 0) | (F.col("__before") + F.col("__size") <= FIT_TEXT))
    pairs = sorted((r[id_col], r["__y"], r["__text"] or "") for r in got.select(id_col, "__y", "__text").collect())
    model = fit([p[2] for p in pairs], [p[1] for p in pairs])
    del pairs
    release()
    return model


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Id, held_out, score and predicted for every row. One pass; the model (a bounded table) goes with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        scores = shared.value.scorer()
        return lambda texts: ((s,) for s in scores(texts))

    out = map_texts(docs, id_col, text_col, "score double", worker, 1_500_000)
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return out.select(id_col, (crc % 4 == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns and other rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scores = shared.value.scorer()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            kept = [s < threshold for _, part in slices(texts, texts, 1_500_000) for s in scores(part)]
            yield batch.filter(pa.array(kept, pa.bool_()))
            release()
        del scores
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
