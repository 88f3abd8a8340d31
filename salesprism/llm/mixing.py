"""Mixing sources to target weights by entropy balancing.

A document of n words from source s gets the rate w that stays closest to 1 in relative entropy while each source's
rates times words sum to its target and no rate exceeds `most`: w = min(most, exp(a_s * n)). The dual is convex and
separates by source; a_s is found by Newton steps inside a bracket, each step one distributed aggregation, until every
source is met or its bracket has no number left inside. Rates depend on source and size only, so steps run over the
table of (source, size, documents) and not over documents.

Rates become copies: along falling sizes, the cumulated rates of a source, shifted by one of SHIFTS offsets, are cut
to whole numbers, which errs by less than one large document; the offset with the smallest error is kept. Within a
(source, size) cell the documents with the smallest hashes get one copy more. A cell is cut into hash ranges, as many
as the table's rows ask for, that are counted first; only the range that holds the cut is ranked, so no task ranks a
cell with a third of all rows. Every row then needs no more than its cell's two numbers.

Ranks of sources, and what fills up before each, come from range partitions whose totals are added up, so that
sources may be as many as hosts of the web.

Only DataFrame functions are used. Defined results: a null text has no words; sizes of 0 are taken 0 times; a source
whose documents have no words has target 0; a null source is a source of its own, after all others; repeated rows
count as documents of their own, and which of them gets a copy more isn't defined; an empty table gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesprism.llm.common import BROADCAST_ROWS, discard, text_or_empty, written

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST = 2
SHIFTS = 32
#: Hash ranges in a cell, at least; one for so many rows of the table.
BINS, BIN_ROWS = 256, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def running(table: DataFrame, order: list[Column], **measures: Column) -> DataFrame:
    """table, sorted over all of it, with the sum of each measure over the rows before a row; a partition is one range."""
    parts = written(table.withColumns(measures).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition
    totals = parts.groupBy("part").agg(*[F.sum(m).alias(m) for m in measures])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(m).over(ahead), F.lit(0)).alias(f"{m}_ahead") for m in measures])
    out = parts.join(F.broadcast(totals), "part")
    return out.withColumns({f"{m}_before": F.col(f"{m}_ahead") + F.coalesce(F.sum(m).over(own), F.lit(0)) for m in measures}).drop("part", *[f"{m}_ahead" for m in measures])


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: float = MOST) -> DataFrame:
    """totals (source, source_size) with target: shares by repeating weights, none above most * source_size.

    Where sources are filled in order of cap / weight, those filled up come first; with the k first at their caps the
    others share what is left by weight. The level is that of the first k at which nobody else exceeds a cap.
    """
    ranked = running(totals, [F.col("source").asc_nulls_last()], one=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("one_before"), F.lit(len(weights))) + 1).cast("int"))
    t = ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size").cast("double")).alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    filled = running(t.withColumnRenamed("weight", "own_weight"), [F.col("ratio"), F.col("source").asc_nulls_last()], full=F.col("cap"), weight=F.col("own_weight"))
    whole = totals.agg(F.sum("source_size").alias("all_sizes")).crossJoin(t.agg(F.sum("weight").alias("all_weights")))
    filled = filled.crossJoin(F.broadcast(whole))
    filled = filled.withColumn("level", F.try_divide(total_share * F.col("all_sizes") - F.col("full_before"), F.col("all_weights") - F.col("weight_before")))
    filled = written(filled.select("source", "source_size", "own_weight", "cap", "ratio", "level"), "mix-levels")
    # the first level at which its own source stays under its cap holds; without one all are full
    holds = filled.where(F.col("level") * F.col("own_weight") <= F.col("cap")).agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("held"))
    share = F.col("held") * F.col("own_weight")
    return filled.crossJoin(F.broadcast(holds)).select("source", "source_size", F.when(F.col("held").isNull() | (share > F.col("cap")), F.col("cap")).otherwise(share).alias("target"))


def _rate(slope: Column, size: Column, scale: Column, most: float) -> Column:
    """min(most, exp(slope * size / scale)); the exponent is bounded so that it can't overflow."""
    return F.least(F.lit(float(most)), F.exp(F.least(slope * size / scale, F.lit(50.0))))


def balance(cells: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """targets with the slope of each source and the error left: bracketed Newton steps on sum(n * size * rate) = target.

    Every eighth step halves the bracket by magnitude whatever Newton says, so the steps end.
    """
    base = cells.where("size > 0")
    scale = base.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"))
    # a source at its cap takes every document `most` times; there is nothing to solve
    state = targets.where(F.col("target") < most * F.col("source_size")).join(scale, targets["source"].eqNullSafe(scale["source"])).select(targets["source"], "source_size", "target", "scale")
    wide = F.lit(1e4)
    # slopes at which each size's rate is at its cap, or as good as nothing, lie in the bracket
    state = written(state.select("*", F.lit(0.0).alias("slope"), (-wide).alias("low"), wide.alias("high"), F.lit(1.0).alias("error")), "mix-state")
    step, last, open_sources = 0, None, not state.isEmpty()
    while open_sources:
        step += 1
        rate = _rate(F.col("slope"), F.col("size"), F.col("scale"), most)
        free = F.col("slope") * F.col("size") / F.col("scale") < F.log(F.lit(float(most)))
        pairs = base.join(state.withColumnRenamed("source", "s"), base["source"].eqNullSafe(F.col("s")))
        sums = pairs.groupBy("source", "source_size", "target", "scale", "slope", "low", "high").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.when(free, F.col("n") * F.col("size") * F.col("size") / F.col("scale") * rate).otherwise(0.0)).alias("gradient"),
        )
        low = F.when(F.col("taken") < F.col("target"), F.col("slope")).otherwise(F.col("low"))
        high = F.when(F.col("taken") >= F.col("target"), F.col("slope")).otherwise(F.col("high"))
        newton = F.col("slope") + F.try_divide(F.col("target") - F.col("taken"), F.col("gradient"))
        least = F.sqrt(F.greatest(F.col("low") * F.col("high"), F.lit(1e-300)))
        middle = F.when((F.col("low") < 0) & (F.col("high") > 0), F.lit(0.0)).when(F.col("high") <= 0, -least).otherwise(least)
        sums = sums.withColumns({"low": low, "high": high})
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high")) & F.lit(step % 8 != 0)
        error = F.abs(F.col("taken") - F.col("target")) / F.col("source_size")
        # met, or two slopes in a row of which none lies between
        done = (error < 1e-9) | (F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high")))
        sums = sums.withColumn("next", F.when(done, F.col("slope")).when(inside, newton).otherwise(middle)).withColumn("error", error).withColumn("done", done)
        last, state = state, written(sums.select("source", "source_size", "target", "scale", F.col("next").alias("slope"), "low", "high", "error", "done"), "mix-state")
        discard(last)
        open_sources = not state.where("not done").isEmpty()
    return state.select("source", "target", "source_size", "slope", "scale", "error")


def _binned(rows: DataFrame, bins: int) -> DataFrame:
    """rows with the number of the range of their hash; ranges follow the order of hashes."""
    return rows.withColumn("bin", F.floor((F.col("hash").cast("double") / 2.0**64 + 0.5) * bins).cast("long"))


def plan_copies(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(plan, targets) of written narrow rows (source, size, hash).

    plan: for each (source, size) above 0 each, the copies that all its documents get, more_below, the hash below which
    they get one more, and ties, how many rows with that very hash do, with tied, the number of such rows.
    """
    bins = max(BINS, narrow.count() // BIN_ROWS)
    counted = written(_binned(narrow.where("size > 0"), bins).groupBy("source", "size", "bin").agg(F.count("*").alias("n")), "mix-bins")
    cells = written(counted.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells")
    sizes = narrow.select("source").distinct().withColumnRenamed("source", "s")
    totals = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    totals = sizes.join(totals, F.col("s").eqNullSafe(F.col("source")), "left").select(F.col("s").alias("source"), F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"))
    targets = written(source_targets(written(totals, "mix-totals"), weights, total_share, most), "mix-targets")
    slopes = balance(cells, targets, most)

    # whole copies for each cell: cumulated rates along falling sizes, cut after a shift
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    p = slopes.select(F.col("source").alias("s2"), "slope", "scale")
    rated = cells.join(t, F.col("source").eqNullSafe(F.col("s"))).join(p, F.col("source").eqNullSafe(F.col("s2")), "left")
    full = F.col("target") >= most * F.col("source_size")
    rated = rated.withColumn("rate", F.when(full, F.lit(float(most))).otherwise(_rate(F.col("slope"), F.col("size"), F.col("scale"), most)))
    falling = Window.partitionBy("source").orderBy(F.col("size").desc())
    rated = rated.withColumn("until", F.sum(F.col("n") * F.col("rate")).over(falling)).withColumn("from", F.col("until") - F.col("n") * F.col("rate"))
    cut = lambda shift: F.greatest(F.lit(0), F.least(most * F.col("n"), (F.floor(F.col("until") + shift) - F.floor(F.col("from") + shift)))).cast("long")
    shifts = [(k + 0.5) / SHIFTS for k in range(SHIFTS)]
    errors = rated.groupBy("source").agg(*[F.abs(F.sum(F.col("size") * cut(F.lit(x))) - F.max("target")).alias(f"e{k}") for k, x in enumerate(shifts)])
    best = errors.select(F.col("source").alias("s3"), F.array_min(F.array(*[F.struct(F.col(f"e{k}").alias("e"), F.lit(x).alias("x")) for k, x in enumerate(shifts)]))["x"].alias("shift"))
    planned = rated.join(best, F.col("source").eqNullSafe(F.col("s3"))).withColumn("copies_all", cut(F.col("shift")))
    planned = written(planned.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "rate", F.expr("copies_all div n").alias("each"), (F.col("copies_all") % F.col("n")).alias("rest")), "mix-planned")

    # the range that holds the cut of a cell, and in it the hash of the last document that gets one more
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = counted.withColumn("before", before).join(planned.where("rest > 0"), F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))).where("before < rest and rest <= before + n")
    at = written(at.select(F.col("source").alias("bs"), F.col("size").alias("bz"), F.col("bin").alias("bb"), (F.col("rest") - F.col("before")).alias("take")), "mix-cuts")
    held = _binned(narrow, bins).join(at, F.col("source").eqNullSafe(F.col("bs")) & (F.col("size") == F.col("bz")) & (F.col("bin") == F.col("bb")))
    # rows with equal hashes count together, so that a document with a third of all rows is one row here
    hashes = held.groupBy("source", "size", "hash").agg(F.count("*").alias("rows"), F.first("take").alias("take"))
    until = F.sum("rows").over(Window.partitionBy("source", "size").orderBy("hash"))
    last = hashes.withColumn("until", until).where("until - rows < take and take <= until")
    last = written(last.select(F.col("source").alias("ls"), F.col("size").alias("lz"), F.col("hash").alias("more_below"), (F.col("take") - F.col("until") + F.col("rows")).alias("ties"), F.col("rows").alias("tied")), "mix-last")
    plan = planned.join(last, F.col("ps").eqNullSafe(F.col("ls")) & (F.col("pz") == F.col("lz")), "left").drop("ls", "lz", "rest")
    plan = written(plan, "mix-plan")
    discard(counted, cells, planned, at, last)
    return plan, targets


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, size, hash, and others) with their copies and rate; rows may be read more than once.

    A plan of few cells travels to the rows. A larger one meets them by cell and some bits of the hash, for each of
    which a row of the plan is made, so that a cell with a third of all rows is spread.
    """
    if plan.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")), "left")
    else:
        bits = F.pmod("hash", F.lit(BINS))
        present = rows.where("size > 0").select(F.col("source").alias("qs"), F.col("size").alias("qz"), bits.alias("pb")).distinct()
        spread = present.join(plan, F.col("qs").eqNullSafe(F.col("ps")) & (F.col("qz") == F.col("pz")))
        joined = rows.join(spread, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz")) & (bits == F.col("pb")), "left").drop("qs", "qz", "pb")
    at_cut = F.col("hash") == F.col("more_below")
    if plan.where("ties < tied").isEmpty():
        more = (F.col("hash") < F.col("more_below")) | at_cut
        return joined.withColumn("copies", _copies(more)).drop("ps", "pz", "each", "more_below", "ties", "tied")
    # some rows with one and the same hash get a copy more, others don't: they are numbered partition by partition
    joined = joined.withColumn("part", F.when(at_cut & (F.col("ties") < F.col("tied")), F.spark_partition_id()))
    joined = written(joined, "mix-tied")
    counts = joined.where("part is not null").groupBy("ps", "pz", "part").agg(F.count("*").alias("k"))
    ahead = Window.partitionBy("ps", "pz").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("ps").alias("ts"), F.col("pz").alias("tz"), F.col("part").alias("tp"), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"))
    tied = joined.where("part is not null").join(F.broadcast(counts), F.col("ps").eqNullSafe(F.col("ts")) & (F.col("pz") == F.col("tz")) & (F.col("part") == F.col("tp")))
    nth = F.row_number().over(Window.partitionBy("ps", "pz", "part").orderBy("hash"))
    tied = tied.withColumn("more", F.col("ahead") + nth <= F.col("ties")).drop("ts", "tz", "tp", "ahead")
    sure = joined.where("part is null").withColumn("more", F.coalesce((F.col("hash") < F.col("more_below")) | at_cut, F.lit(False)))
    return sure.unionByName(tied).withColumn("copies", _copies(F.col("more"))).drop("more", "part", "ps", "pz", "each", "more_below", "ties", "tied")


def _copies(more: Column) -> Column:
    return F.coalesce(F.col("each") + F.when(more, 1).otherwise(0), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST) -> DataFrame:
    """One row per input row: size, source_size, target, taken (copies times size), copies, rate and the source."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_or_empty(text_column)).alias("size"), F.xxhash64(F.col(id_column), F.col(text_column), F.lit("mix")).alias("hash"))
    narrow = written(narrow, "mix-sizes")
    plan, targets = plan_copies(narrow, weights, total_share, most)
    out = with_copies(narrow, plan)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    t = F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    out = out.join(t, out["source"].eqNullSafe(F.col("s")), "left")
    return out.select(F.col("id").alias(id_column), "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies", F.coalesce(F.col("rate"), F.lit(0.0)).alias("rate"), F.col("source").alias("mix_source"))


def take_mix(docs: DataFrame, text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, with mix_copies, mix_size and mix_taken; texts stay where they are.

    Documents are told apart by all their columns; rows that are equal in all of them share what they get.
    """
    rows = docs.select("*", F.col(source_column).alias("_mix_source"), word_count(text_or_empty(text_column)).alias("_mix_size"), F.xxhash64(*docs.columns).alias("_mix_hash"))
    own = {"source": "_mix_source", "size": "_mix_size", "hash": "_mix_hash"}
    narrow = written(rows.select(*[F.col(v).alias(k) for k, v in own.items()]), "mix-sizes")
    plan, _ = plan_copies(narrow)
    mixed = with_copies(rows.select(F.struct(*docs.columns).alias("doc"), *[F.col(v).alias(k) for k, v in own.items()]), plan)
    return mixed.where("copies > 0").select("doc.*", F.col("copies").alias("mix_copies"), F.col("size").alias("mix_size"), (F.col("copies") * F.col("size")).alias("mix_taken"))
