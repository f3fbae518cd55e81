"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Targets: weights 3, 1, 2, repeating over sources in code-point order (null last), share ``SHARE`` of all words; no
target exceeds ``CAP`` times its source's words, and the excess goes to the others by weight until none is above.

Rates: of all document rates in [0, CAP] that meet a source's token constraint, those nearest to the uniform rate in
relative entropy are exponentially tilted: rate = CAP * e / (1 + e) with e = exp(lambda * size / mean size of the
source). The convex dual has one lambda for each source. Newton's iterations sum gradient and curvature over the
distinct (source, size) pairs with an aggregation each; documents are not read again.

Copies: within a source documents are sorted by size, largest first, and the running sum of rates is cut at whole
numbers, so that each document gets its rate rounded down or up and a source's error is about its largest size at most
(the running sum comes from the pairs' counts; no task holds a source). Then some passes move single documents up or down where that brings the source nearer to its target.

Cases: null and wordless texts have size 0 and are taken 0 words, also where a source has no others; a null source is a source; repeated rows count each
for itself, rows of equal id and size are moved together, rows without id are not moved; an empty table gives an empty table.
Ties are broken by id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh

SHARE, CAP = 1.5, 2.0
#: Weights by the source's place in the order, repeating (fixed value).
WEIGHTS = (3, 1, 2)
#: Newton's iterations end when every constraint is met to this share, or its tilt is known to as many digits as doubles have.
#: Bisection takes over where a step leaves the bracket, so far fewer iterations than this suffice; else an error is raised.
CLOSE_ENOUGH, ITERATIONS = 1e-9, 200
#: Tilts are sought between minus and plus this.
BRACKET = float(1 << 20)
#: Passes that move single documents.
REPAIRS = 5
#: The key of the null source; other sources' keys are an s and their name.
NONE = "n"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def named(column: str) -> Column:
    """A key that is never null: an s and the value's text, or ``NONE``."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit(NONE))


def water_fill(sources: list[tuple[str | None, int]], share: float = SHARE, cap: float = CAP) -> dict:
    """Targets of sources given in order with their sizes."""
    weights = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(sources)}
    limit = {s: cap * n for s, n in sources}
    total, open_ = share * sum(n for _, n in sources), dict(weights)
    out = {}
    while open_:
        unit = total / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit > limit[s]]
        if not full:
            out.update((s, w * unit) for s, w in open_.items())
            break
        for s in full:
            out[s] = limit[s]
            total -= limit[s]
            del open_[s]
    return out


def _targets(per_source: DataFrame) -> DataFrame:
    """Source, its size and target. The water level is found over at most a row for each source, by SQL.

    A source is full if its ratio limit/weight is below the level. In order of that ratio the full ones are a prefix:
    the first place whose level would not exceed its ratio ends it.
    """
    rank = Window.orderBy(F.col("source") == NONE, "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(rank) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = per_source.withColumn("weight", weight.cast("double")).withColumn("limit", F.lit(CAP) * F.col("source_size"))
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.lit(SHARE) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    before, spent = F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)), F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0))
    level = (F.col("budget") - spent) / (F.sum("weight").over(everything) - before)
    place = F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), "source"))
    rows = rows.withColumn("level", level).withColumn("place", place)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    rows = rows.withColumn("final", F.min(fits).over(everything)["level"])
    return rows.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target"))


def _solve(sizes_: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Newton's method on every source's dual: source and tilt (null where the target is the whole cap)."""
    mean = sizes_.groupBy("source").agg((F.sum(F.col("size") * F.col("rows")) / F.sum("rows")).alias("mean"))
    state = targets.join(mean, "source").select("source", "source_size", "target", "mean")
    state = scratch.keep(state.withColumns({"tilt": F.lit(0.0), "lo": F.lit(-BRACKET), "hi": F.lit(BRACKET), "done": F.lit(False)}))
    for _ in range(ITERATIONS):
        joined = sizes_.join(state, "source").select("source", "size", "rows", "mean", "tilt")
        z = F.coalesce(F.try_divide(F.col("size"), F.col("mean")), F.lit(0.0))
        share = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * z))))
        words = F.sum(F.col("rows") * F.col("size") * CAP * share).alias("words")
        slope = F.sum(F.col("rows") * F.col("size") * z * CAP * share * (1 - share)).alias("slope")
        sums = joined.groupBy("source").agg(words, slope)
        both = state.join(sums, "source")
        gap = F.col("words") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("hi"))
        both = both.withColumns({"lo": lo, "hi": hi, "newton": F.col("tilt") - F.try_divide(F.col("words") - F.col("target"), F.col("slope"))})
        inside = F.col("newton").isNotNull() & (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        done = F.abs(F.col("words") - F.col("target")) <= CLOSE_ENOUGH * F.greatest(F.col("target"), F.lit(1.0))
        narrow = F.col("hi") - F.col("lo") <= 1e-14 * F.greatest(F.abs("tilt"), F.lit(1.0))
        both = both.withColumn("done", done | narrow | (F.col("target") >= CAP * F.col("source_size")))
        both = both.withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2))
        new = scratch.keep(both.select("source", "source_size", "target", "mean", "tilt", "lo", "hi", "done"))
        scratch.drop(state)
        state = new
        if not state.where(~F.col("done")).limit(1).count():
            return state
    raise ArithmeticError("Newton's iterations did not converge")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, rate, copies, taken (= copies * size)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), named(source_col).alias("source"), word_count(text_col).alias("size")))
    pairs = scratch.keep(rows.groupBy("source", "size").agg(F.count("*").alias("rows")))
    per_source = pairs.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    state = _solve(pairs, _targets(per_source), scratch)
    # Rates belong to (source, size) pairs; so do the offsets of the running sum of rates.
    joined = pairs.join(state, "source").select("source", "size", "rows", "mean", "tilt", "target", "source_size")
    tilted = CAP / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.try_divide(F.col("tilt") * F.col("size"), F.col("mean"))))))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("target") >= CAP * F.col("source_size"), CAP).otherwise(tilted)
    offsets = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("rate", rate).withColumn("offset", F.coalesce(F.sum(F.col("rows") * F.col("rate")).over(offsets), F.lit(0.0)))
    # Rows of one size are interchangeable: ranks within a pair spread its copies. Hot pairs are dealt out by a salt
    # of the id first: counts by salt give each salt its first rank.
    salt = F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")
    salted = rows.select("*", salt)
    counts = salted.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.join(joined, ["source", "size"]).select("source", "size", "salt", "first", "rate", "offset", "target", "source_size")
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("id")) - 1)
    full = ranked.join(counts, ["source", "size", "salt"])
    place = F.col("first") + F.col("k")
    cut = lambda p: F.floor(F.col("offset") + p * F.col("rate") + 0.5)
    full = full.select("id", "source", "size", "source_size", "target", "rate", (cut(place + 1) - cut(place)).alias("copies"))
    # No copies beyond the cap, whatever the floating-point sums.
    out = full.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(int(CAP)), F.col("copies"))))
    out = _repair(scratch.keep(out), scratch)
    return out.select(F.col("id").alias(id_col), F.when(F.col("source") != NONE, F.expr("substring(source, 2)")).alias(source_col), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _repair(full: DataFrame, scratch: Scratch) -> DataFrame:
    """Move single documents by a copy where the source comes nearer to its target.

    What can move is summed up by (source, size, copies) first: the rows of the smallest id of each.
    """
    table = full.groupBy("source", "size", "copies", "id").agg(F.count("*").alias("n"), F.first("target").alias("target"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    table = table.groupBy("source", "size", "copies").agg(F.sum("n").alias("all"), F.min(named).alias("one"), F.first("target").alias("target"))
    table = scratch.keep(table.select("source", "size", "copies", "all", F.col("one.id").alias("id"), F.col("one.n").alias("n"), "target"))
    gaps = table.groupBy("source").agg((F.first("target") - F.sum(F.col("all") * F.col("size") * F.col("copies"))).alias("gap"))
    moves = None
    for _ in range(REPAIRS):
        gap, pool = gaps, table
        if moves is not None:
            moved = moves.groupBy("source").agg(F.sum(F.col("way") * F.col("size") * F.col("n")).alias("moved"))
            gap = gaps.join(moved, "source", "left").select("source", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap"))
            pool = table.join(moves.select("source", "size", "copies"), ["source", "size", "copies"], "left_anti")
        open_ = pool.join(gap, "source").withColumn("way", F.signum("gap").cast("long")).withColumn("left", F.abs(F.abs("gap") - F.col("size") * F.col("n")))
        can = F.col("id").isNotNull() & (F.col("size") > 0) & (F.col("left") < F.abs("gap")) & F.when(F.col("way") > 0, F.col("copies") < int(CAP)).otherwise(F.col("copies") > 0)
        best = open_.where(can).groupBy("source").agg(F.min(F.struct("left", "size", "copies", "id", "n", "way")).alias("b")).select("source", "b.size", "b.copies", "b.id", "b.n", "b.way")
        new = scratch.keep(best if moves is None else moves.unionByName(best))
        if moves is not None:
            scratch.drop(moves)
        moves = new
    out = full.join(moves.select("source", "size", "id", "copies", "way"), ["source", "size", "id", "copies"], "left")
    known = out.withColumn("copies", F.col("copies") + F.coalesce("way", F.lit(0))).drop("way")
    return known


def repeat_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated by its copies (none to ``CAP``); all columns stay.

    Rows are matched by id, source and size; of rows that agree in all three those of smaller text hash are taken oftener.
    """
    *key, nth, copies, one = fresh(docs, "__id", "__source", "__size", "__nth", "__copies", "__one")
    place = lambda order: F.row_number().over(Window.partitionBy(*key).orderBy(order))
    identity = {key[0]: named(id_col), key[1]: named(source_col)}
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col)
    plan = plan.withColumns(identity | {key[2]: F.col("size")}).withColumn(nth, place(F.col("copies").desc())).select(*key, nth, F.col("copies").cast("int").alias(copies))
    rows = docs.withColumns(identity | {key[2]: word_count(text_col)}).withColumn(nth, place(F.xxhash64(text_col)))
    joined = rows.join(plan, [*key, nth])
    return joined.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
