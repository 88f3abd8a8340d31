"""Relations between all pairs of many items: correlations by blocks of items, and baskets cut by the support of their items.

Series are standardised once, so the correlation of two items is the product of two rows. Items are dealt into blocks
of about BLOCK_ITEMS; a task multiplies two blocks at a time, each pair of blocks once, and only pairs that a test can
call significant need leave it. Pairs of a basket come from items that are frequent enough to be in a supported pair
at all; what is left of a large basket is cut into blocks as well, and its pairs of blocks are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesprism.functions.stats import t_quantile
from salesprism.operators.periods import MONTH, whole_by_period_and
from salesprism.scratch import written

BLOCK_ITEMS, BASKET_BLOCK = 512, 512
PAIRS_AT_ONCE = 100_000
LEAST_PERIODS = 6


def item_vectors(sales: DataFrame, key: str = "product", frequency: str = MONTH) -> DataFrame:
    """(item, flat, z): standardised period values of each item that is active in a third of the periods and in three; nothing below six periods."""
    cells = whole_by_period_and(sales, key, frequency).withColumnRenamed(key, "item")
    own = cells.groupBy("item").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("active"), F.avg("value").alias("mean"), F.sqrt(F.var_pop("value") * F.count("*")).alias("norm"), F.array_sort(F.collect_list(F.struct("period", "value"))).alias("cells")
    )
    flat = F.col("norm") == 0
    z = F.transform("cells", lambda c: F.when(flat, 0.0).otherwise((c["value"] - F.col("mean")) / F.nullif("norm", F.lit(0.0))))
    return own.where(f"n >= {LEAST_PERIODS} and active >= greatest(3, n div 3)").select("item", flat.alias("flat"), z.alias("z"))


def least_correlation(periods: int, bound: float | None) -> float:
    """The smallest absolute correlation whose two-sided p is at most bound."""
    if bound is None:
        return 0.0
    t = t_quantile(1 - bound / 2, periods - 2)
    return t / (periods - 2 + t * t) ** 0.5


def correlated_pairs(vectors: DataFrame, items: int, bound: float | None = None) -> DataFrame:
    """(a, b, n, r) of pairs of items with a < b: all, r null where a series is flat, or those whose p is at most bound; items: how many there are at most."""
    n_blocks = max(1, -(-items // BLOCK_ITEMS))
    rows = vectors.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)))
    blocks = rows.groupBy("block").agg(F.collect_list(F.struct("item", "flat", "z")).alias("rows"))
    if n_blocks == 1:
        return _multiplied(blocks.select(F.lit(0).alias("k"), F.col("rows").alias("left_rows"), F.col("rows").alias("right_rows")), bound)
    # block i meets the half of the blocks that follow it on a circle, so every two meet once
    ahead = F.col("i") + F.col("k")
    left = blocks.select(F.col("block").alias("i"), F.col("rows").alias("left_rows"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks // 2))).alias("k"))
    if n_blocks % 2 == 0:
        left = left.where(f"k < {n_blocks // 2} or i < {n_blocks // 2}")
    pairs = left.withColumn("j", ahead % n_blocks).join(blocks.select(F.col("block").alias("j"), F.col("rows").alias("right_rows")), "j").select("k", "left_rows", "right_rows")
    return _multiplied(pairs, bound)


def _multiplied(pairs: DataFrame, bound: float | None) -> DataFrame:
    """The correlations of the items of each pair of blocks (k, left_rows, right_rows); k is 0 where both are one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "n", "r"]

        def side(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v = rows.flatten()
            z = v.field("z")
            return np.array(v.field("item").to_pylist(), dtype=object), v.field("flat").to_numpy(zero_copy_only=False), z.flatten().to_numpy().reshape(len(v), -1)

        for batch in batches:
            for x in range(batch.num_rows):
                one = batch.slice(x, 1)
                same = one.column("k")[0].as_py() == 0
                # the rows of a block come in any order, on either side
                (a, flat_a, za), (b, flat_b, zb) = side(one.column("left_rows")), side(one.column("left_rows" if same else "right_rows"))
                periods = za.shape[1]
                least = least_correlation(periods, bound)
                r = np.clip(za @ zb.T, -1.0, 1.0)
                r[flat_a] = r[:, flat_b] = np.nan
                wanted = np.isnan(r) | (np.abs(r) >= least) if bound is None else np.abs(r) >= least
                if same:
                    wanted = np.triu(wanted, 1)
                at_a, at_b = np.nonzero(wanted)
                for s in range(0, len(at_a), PAIRS_AT_ONCE):
                    p, q = at_a[s : s + PAIRS_AT_ONCE], at_b[s : s + PAIRS_AT_ONCE]
                    first, second, value = a[p], b[q], r[p, q]
                    turned = first > second
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(turned, second, first).tolist(), pa.string()), pa.array(np.where(turned, first, second).tolist(), pa.string()), pa.array(np.full(len(p), periods, np.int64)), pa.array(value, pa.float64(), from_pandas=True)], names=names)

    return pairs.mapInArrow(run, "a string, b string, n long, r double")


def pairs_tested(vectors: DataFrame) -> int:
    """How many pairs have a correlation."""
    n = vectors.where(~F.col("flat")).count()
    return n * (n - 1) // 2


def supported_pairs(baskets: DataFrame, floor_share: float = 0.01, floor_least: int = 8) -> DataFrame:
    """(a, b, together, n_a, n_b, n_baskets) of pairs in enough of the baskets (basket, item) of two items or more.

    A pair is in no more baskets than either of its items, so items below the floor go first; there are no more
    frequent items than the mean size of a basket over floor_share.
    """
    many = baskets.withColumn("size", F.count("*").over(Window.partitionBy("basket"))).where("size >= 2")
    n_baskets = many.agg(F.countDistinct("basket")).first()[0]
    floor = max(floor_least, int(floor_share * n_baskets))
    items = written(many.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= floor), "items")
    held = many.select("basket", "item").join(items, "item").select("basket", F.struct("item", "n").alias("x"))
    if items.count() <= BASKET_BLOCK:
        pairs = _pairs_inside(held.groupBy("basket").agg(F.array_sort(F.collect_list("x")).alias("items")))
    else:
        # what is left of a large basket comes as pairs of blocks of its items; a small one is one block
        numbered = held.withColumn("block", F.expr(f"(row_number() OVER (PARTITION BY basket ORDER BY x) - 1) div {BASKET_BLOCK}"))
        blocks = numbered.groupBy("basket", "block").agg(F.array_sort(F.collect_list("x")).alias("items"))
        blocks = blocks.withColumn("blocks", F.count("*").over(Window.partitionBy("basket")))
        several = blocks.where("blocks > 1")
        left = several.select("basket", "block", F.col("items").alias("left_items"), F.explode(F.expr("sequence(block, blocks - 1)")).alias("other")).where("other > block")
        across = left.join(several.select("basket", F.col("block").alias("other"), F.col("items").alias("right_items")), ["basket", "other"])
        across = across.repartition(F.xxhash64("basket", "block", "other")).select(F.explode("left_items").alias("a"), "right_items").select("a", F.explode("right_items").alias("b"))
        pairs = _pairs_inside(blocks).unionByName(across)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= floor)
    return counted.select("a.item", "b.item", "together", "a.n", "b.n", F.lit(n_baskets).cast("long")).toDF("a", "b", "together", "n_a", "n_b", "n_baskets")


def _pairs_inside(blocks: DataFrame) -> DataFrame:
    return blocks.select("items", F.posexplode("items").alias("at", "a")).select("a", F.explode(F.expr("slice(items, at + 2, size(items))")).alias("b"))
