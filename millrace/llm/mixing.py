"""Mixing sources to target weights by entropy balancing.

Sources share a total of words by their weights; no source is asked for more than cap times its words, the excess goes
to the others by weight. Within a source the rates r_i of documents, their repeats on average, are those nearest to 1
in relative entropy that give the target: minimise sum r log r - r + 1 with sum r_i size_i = target and r_i <= cap. The
convex dual has one multiplier a source, and r_i = min(cap, exp(l x_i)) with x_i the size over the source's mean. Newton
steps, kept inside a shrinking bracket, solve all sources at once; each step is one grouped sum over the distinct
(source, size) pairs, which carry all that the sum needs.

Rates become copies by a hash u_i of doc_id: the whole part, and one more where u_i is below the fraction plus a shift
of the source. The shift is found in two passes over histograms of u_i minus the fraction, so that the words taken meet
the target up to about one document. Reruns agree.

Defined results: a null or empty text has size 0 and is taken round(rate) times, adding no words; a null source is a
source of its own, last in order; repeated rows of a doc_id get equal copies; sources without words have target 0; an
empty table gives an empty table; other columns are carried, those this adds begin with mix_.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 4096
NEWTON_STEPS, CLOSE = 60, 1e-10


def size_of(text: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, total, target. One row a source is sorted in one task: sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int"))
    s = sizes.withColumn("w", w).withColumn("ratio", cap * F.col("total") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    want = F.least(F.lit(share), F.lit(cap)) * F.sum("total").over(everything)
    left = want - F.coalesce(F.sum(cap * F.col("total")).over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    # the first source, by ratio, that its part does not fill sets the level of all after it
    s = s.withColumn("c", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return s.select("source", "total", F.least(cap * F.col("total"), F.coalesce(F.col("c") * F.col("w"), cap * F.col("total"))).alias("target"))


def _rate(cap: float) -> Column:
    """min(cap, exp(l x)); a full source has all its documents at cap."""
    return F.when(F.col("full"), F.lit(cap)).otherwise(F.exp(F.least(F.col("l") * F.col("size") / F.col("mean"), F.lit(float(_ln(cap))))))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def solve(pairs: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """goal (source, total, n, target) with the multiplier l of each source. pairs: source, size, n (documents)."""
    state = goal.withColumns({
        "mean": F.col("total") / F.col("n"), "full": F.col("target") >= F.col("total") * (cap * (1 - 1e-12)),
        "l": F.lit(0.0), "lo": F.lit(-4096.0), "hi": F.lit(4096.0),
    })
    state = written(state, "state")
    for _ in range(NEWTON_STEPS):
        both = pairs.join(state.select(F.col("source").alias("of"), "l", "mean", "full"), F.col("source").eqNullSafe(F.col("of")))
        r = _rate(cap)
        free = F.col("l") * F.col("size") / F.col("mean") < _ln(cap)
        sums = both.groupBy("source").agg(
            F.sum(r * F.col("size") * F.col("n")).alias("g"),
            F.sum(F.when(free, r * F.col("size") * F.col("size") / F.col("mean") * F.col("n")).otherwise(0.0)).alias("h"),
        ).withColumnRenamed("source", "of")
        now = state.join(sums, F.col("source").eqNullSafe(F.col("of"))).withColumn("off", F.col("g") - F.col("target"))
        now = now.withColumns({"lo": F.when(F.col("off") < 0, F.greatest("lo", "l")).otherwise(F.col("lo")), "hi": F.when(F.col("off") >= 0, F.least("hi", "l")).otherwise(F.col("hi"))})
        newton = F.when(F.col("h") > 0, F.col("l") - F.col("off") / F.col("h"))
        step = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        done = F.col("full") | (F.abs("off") <= CLOSE * F.col("target")) | (F.col("total") == 0)
        now = now.withColumns({"done": done, "l": F.when(done, F.col("l")).otherwise(step)})
        now = written(now, "state")
        state = now.drop("of", "g", "h", "off", "done")
        if now.where("not done").isEmpty():
            break
    return state.drop("lo", "hi")


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size of each row; a row a source with target, multiplier and shift)."""
    slim = written(docs.select("doc_id", F.col(source).alias("source"), size_of().alias("size")), "sizes")
    pairs = written(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "pairs")
    sizes = written(pairs.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n")), "totals")
    goal = targets(sizes, weights, share, cap).join(sizes.select(F.col("source").alias("of"), "n"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state = solve(pairs, written(goal, "targets"), cap)

    # v = u - fraction: one more copy where v < shift; two histograms of BINS bins find the shift
    state = state.withColumns({"shift": F.lit(-1.0), "width": F.lit(2.0)})
    for _ in range(2):
        state = written(state, "shift")
        v = _with_rates(slim, state, cap)
        base = v.groupBy("source").agg(F.sum(F.when((F.col("v") < F.col("shift")) & F.col("room"), F.col("whole") + 1).otherwise(F.col("whole")) * F.col("size")).alias("sure"))
        inside = v.where((F.col("v") >= F.col("shift")) & (F.col("v") < F.col("shift") + F.col("width")) & F.col("room"))
        bins = inside.groupBy("source", F.floor((F.col("v") - F.col("shift")) / F.col("width") * BINS).alias("bin")).agg(F.sum("size").alias("words"))
        run = bins.withColumn("sum", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))  # at most BINS rows a source
        base = base.withColumnRenamed("source", "of")
        goal = state.join(base, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        fits = run.join(goal.select(F.col("source").alias("of"), "sure", "target"), F.col("source").eqNullSafe(F.col("of"))).where(F.col("sure") + F.col("sum") <= F.col("target"))
        last = fits.groupBy("source").agg(F.max("bin").alias("bin")).withColumnRenamed("source", "of")
        first = bins.groupBy("source").agg(F.min("bin").alias("first")).withColumnRenamed("source", "of2")
        state = goal.join(last, F.col("source").eqNullSafe(F.col("of")), "left").join(first, F.col("source").eqNullSafe(F.col("of2")), "left")
        at = F.coalesce(F.col("bin") + 1, F.col("first"), F.lit(0))
        state = state.withColumns({"shift": F.col("shift") + at * F.col("width") / BINS, "width": F.col("width") / BINS}).drop("sure", "bin", "first", "of", "of2")
    return slim, written(state, "plan")


def _with_rates(rows: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """rows (source, doc_id, size) with rate, whole (copies for sure), room for one more, v."""
    both = rows.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    rate = F.coalesce(_rate(cap), F.lit(1.0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 11) / F.lit(float(1 << 53))
    both = both.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12))
    return both.withColumns({"room": F.col("whole") < F.lit(int(cap)), "v": u - (F.col("rate") - F.col("whole"))})


def rated(rows: DataFrame, state: DataFrame, cap: float = 2.0) -> DataFrame:
    """rows with the rate and copies that the plan gives each."""
    v = _with_rates(rows, state, cap)
    return v.withColumn("copies", (F.col("whole") + F.when(F.col("room") & (F.col("v") < F.col("shift")), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Every row of docs as often as the mix takes it; the columns of docs."""
    _, state = plan(docs, weights, share, cap)
    state = state.select("source", "l", "mean", "full", "shift")
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), F.col("doc_id"), F.col("source"), size_of().alias("size"))
    taken = rated(rows, state, cap).where("copies > 0").select("mix_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mix_copy"))
    return taken.select("mix_row.*")
