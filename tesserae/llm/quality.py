"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are trained in numpy (``gbt.train``) on labelled documents and flattened into node arrays; scoring is
vectorised over a batch. Shares of symbols, of repeated words and of repeated lines are monotonic: more of them never
raises the score. A text is kept if no base rule fails it and its calibrated probability of being good reaches
``THRESHOLD``.

Cases: null, empty and wordless texts have zero statistics and fail the base rules; texts are read whole; equal texts
get equal rows; without labels of both classes the trees keep everything that the base rules keep.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import map_texts, shingle_hashes, span_hashes, word_spans

#: Symbols counted by the base statistics (fixed value).
SYMBOLS = b"#*$%&|<>"
#: Words in a window of the repetition statistic; least words; most percent of repeated words.
REPEAT, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Probability of good quality from which a text is kept.
THRESHOLD = 0.35
#: At most so many labelled rows of each class fit the trees: those of smallest crc32(doc_id).
FIT_ROWS = 4000
FEATURES = ("log words", "word length", "symbols a word", "duplicate lines", "repeated words", "distinct words", "upper case", "digits", "exclamations", "bars", "longest run of a word", "words a line", "sentence ends a word", "most frequent word", "symbol-final words")
MONOTONE = {2: -1, 3: -1, 4: -1, 8: -1, 10: -1, 14: -1}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".?")] = True


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the trees' features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_spans(data)
    n = len(starts)
    n_symbols = int(_IS_SYMBOL[data].sum())
    if not n:
        return (0, 0, n_symbols, 0, 0), [0.0] * len(FEATURES)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    chars = int(((data & 0xC0) != 0x80).sum() - space.sum())
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and (line[0] > 32 or line.split()):
            lines += 1
            dup += line in seen
            seen.add(line)
    words = span_hashes(data, starts, ends)
    repeated = 0
    if n >= REPEAT:
        windows = shingle_hashes(words, REPEAT)
        order = np.sort(windows)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(windows, twice))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + REPEAT, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    distinct, counts = np.unique(words, return_counts=True)
    same = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1], [True])))
    last = data[ends - 1]
    x = [
        np.log(n), chars / n, n_symbols / n, dup / lines, repeated / n, len(distinct) / n, _UPPER[data].sum() / chars, _DIGIT[data].sum() / chars, (data == 33).sum() / n,
        (data == 124).sum() / n, np.diff(same).max() / n, n / lines, _END[data].sum() / n, counts.max() / n, (_IS_SYMBOL[last] | (last == 33)).sum() / n,
    ]
    return (n, chars, n_symbols, dup, repeated), [float(v) for v in x]


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def fit_labels(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", rows: int = FIT_ROWS) -> gbt.FlatForest:
    """Fit on at most ``rows`` labelled documents of each class; null and other labels don't count."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("__y"))
    parts = [known.where(F.col("__y") == y).orderBy(crc, id_col).limit(rows) for y in (0, 1)]
    got = docs.select(id_col, text_col).join(F.broadcast(parts[0].unionByName(parts[1])), id_col)

    def worker():
        return lambda texts: ((statistics(t)[1],) for t in texts)

    keyed = got.groupBy(id_col).agg(F.max("__y").alias("__y"), F.max(text_col).alias("__text"))
    stats = map_texts(keyed.select(F.struct(F.col(id_col).alias("k"), F.col("__y").alias("y")).alias("id"), "__text"), "id", "__text", "x array<double>", worker)
    pairs = sorted(((r["id"]["k"], r["id"]["y"], r["x"]) for r in stats.collect()), key=lambda p: p[0])
    x = np.array([p[2] for p in pairs]).reshape(-1, len(FEATURES))
    return gbt.train(x, [p[1] for p in pairs], rounds=80, depth=4, rate=0.15, min_rows=8, monotone=MONOTONE)


def assess(docs: DataFrame, forest: gbt.FlatForest, *, id_col="doc_id", text_col="text", threshold: float = THRESHOLD) -> DataFrame:
    """Statistics, probability and verdict for every row. One pass, no shuffle."""
    # The scoring rows of one class only: nothing was learnt, so nothing is rejected.
    blind = len(forest.roots) == 1 and len(forest.value) == 1

    def worker():
        def process(texts):
            got = [statistics(t) for t in texts]
            p = forest.probability(np.array([g[1] for g in got]).reshape(-1, len(FEATURES)))
            for (base, _), q in zip(got, p.tolist(), strict=True):
                failed = base_failed(base[0], base[4])
                yield *base, failed, not failed and (blind or q >= threshold), q

        return process

    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
    return map_texts(docs, id_col, text_col, fields, worker)
