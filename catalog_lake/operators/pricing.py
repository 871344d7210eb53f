"""Taxonomy and price intervals: descendants, crawl units, bucket assignment, break search.

The break searches count each price once, in Spark, and look for breaks on the prefix sums of one
taxonomy's price histogram: distinct prices in cents, bounded whatever the number of listings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from catalog_lake.session import materialise, new_path

UNBOUNDED = 1_000_000.0
PAGING_CAP = 10_000
GROW_TARGET, HALVE_TARGET = 5_000, 8_000


def descendants(nodes: DataFrame, root: int) -> DataFrame:
    """(id, name, depth, path): root and everything below it; sort by path for pre-order.

    Level by level: a join for each, which is stored, until one is empty. There is no limit on levels or rows. A node that
    is below itself is an error, as levels would never end; for that a row holds the ids above it.
    """
    spark = nodes.sparkSession
    path = new_path(spark, "levels")
    level = nodes.filter(F.col("id") == int(root)).select("id", "name", F.lit(0).alias("depth"), F.lit("").alias("path"), F.array(F.col("id")).alias("above"))
    schema, depth = level.schema, 0
    step = nodes.select(F.col("parent_id").alias("__up"), F.col("id").alias("__id"), F.col("name").alias("__name"), F.lpad(F.col("ord").cast("string"), 6, "0").alias("__ord"))
    while True:
        level.write.parquet(f"{path}/level={depth}")
        done = spark.read.schema(schema).parquet(f"{path}/level={depth}")
        if done.isEmpty():
            break
        depth += 1
        again = F.raise_error(F.concat(F.lit("a node is below itself: "), F.col("__id").cast("string"))).cast("bigint")
        level = step.join(done, F.col("__up") == F.col("id")).select(
            F.when(F.array_contains("above", F.col("__id")), again).otherwise(F.col("__id")).alias("id"), F.col("__name").alias("name"), F.lit(depth).alias("depth"),
            F.concat("path", F.lit("/"), "__ord").alias("path"), F.array_append("above", F.col("__id")).alias("above"),
        )
    return spark.read.schema(schema).parquet(*(f"{path}/level={k}" for k in range(depth + 1))).drop("above")


def leaves(nodes: DataFrame, root: int) -> DataFrame:
    below = descendants(nodes, root).filter("depth > 0").select("id", "name")
    return below.join(nodes.select(F.col("parent_id").alias("id")).distinct(), "id", "left_anti")


def crawl_units(config: DataFrame, legacy: bool = False) -> DataFrame:
    """(taxonomy_id, unit, label, min_price, max_price): one interval per adjacent pair of breaks; open above 1,000,000."""
    pairs = config.select("taxonomy_id", "name", F.size("price_breaks").alias("n"), F.posexplode("price_breaks").alias("unit", "low"), "price_breaks")
    pairs = pairs.withColumn("high", F.get("price_breaks", F.col("unit") + 1)).filter("unit < n - 1")
    lowest = F.lit(None).cast("double") if legacy else F.col("low")
    low = F.when(F.col("unit") == 0, lowest).otherwise(F.round(F.col("low") + 0.01, 2))
    label = F.when(F.col("n") == 2, F.col("name")).otherwise(F.format_string("%s (unit %d)", "name", "unit"))
    return pairs.select("taxonomy_id", "unit", label.alias("label"), low.alias("min_price"), F.when(F.col("high") < UNBOUNDED, F.col("high")).alias("max_price"))


def assign_price_bucket(listings: DataFrame, units: DataFrame) -> DataFrame:
    """listings (taxonomy_id, price) plus unit; NULL outside all intervals.

    The intervals of a taxonomy travel with it as one sorted array, so that this is an equi join and a
    binary search in the array, not a range join. The table of intervals is configuration: a row per interval.
    """
    arrays = units.groupBy("taxonomy_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("min_price", F.lit(0.0)).alias("low"), F.coalesce("max_price", F.lit(float("inf"))).alias("high"), "unit"))).alias("__units"))
    joined = listings.join(arrays, "taxonomy_id", "left").withColumn("__price", F.round(F.col("price"), 2))
    # the last interval that begins at or under the price: [lo, hi] halves in each step
    place = F.expr(
        "aggregate(sequence(0, int(log2(size(__units) + 1))), named_struct('lo', 0, 'hi', size(__units) - 1), (a, k) -> if("
        "a.lo < a.hi and __units[(a.lo + a.hi + 1) div 2].low <= __price, named_struct('lo', int((a.lo + a.hi + 1) div 2), 'hi', a.hi),"
        "named_struct('lo', a.lo, 'hi', if(a.lo < a.hi, int((a.lo + a.hi + 1) div 2) - 1, a.hi))), a -> a.lo)"
    )
    found = joined.withColumn("__unit", F.get("__units", F.when(F.size("__units") > 0, place)))
    inside = (F.col("__unit.low") <= F.col("__price")) & (F.col("__price") <= F.col("__unit.high"))
    return found.withColumn("unit", F.when(inside, F.col("__unit.unit"))).drop("__units", "__unit", "__price")


def bucket_counts(listings: DataFrame, units: DataFrame, cap: int = PAGING_CAP) -> DataFrame:
    """Listings per interval, empty ones too, and whether the count reaches the paging cap.

    Listings are counted by price first, so that intervals are looked up once for each price of a taxonomy.
    """
    prices = listings.groupBy("taxonomy_id", F.round("price", 2).alias("price")).agg(F.count(F.lit(1)).alias("listings"))
    counts = assign_price_bucket(prices, units).filter("unit is not null").groupBy("taxonomy_id", "unit").agg(F.sum("listings").alias("n"))
    joined = units.select("taxonomy_id", "unit").join(counts, ["taxonomy_id", "unit"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("at_cap", F.col("n") >= cap)


def taxonomy_counts(listings: DataFrame, limits: tuple[int, int] = (10_000, 50_000)) -> DataFrame:
    """Listings per taxonomy with flags over two limits, and a total row (NULL taxonomy): all listings, taxonomies over each limit."""
    each = listings.filter("taxonomy_id is not null").groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumns({"over_low": (F.col("n") > limits[0]).cast("bigint"), "over_high": (F.col("n") > limits[1]).cast("bigint")})
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("over_low"), F.lit(0)).alias("over_low"), F.coalesce(F.sum("over_high"), F.lit(0)).alias("over_high"))
    return each.unionByName(total.withColumn("taxonomy_id", F.lit(None).cast(each.schema["taxonomy_id"].dataType)))


def in_scope(listings: DataFrame, taxonomies: DataFrame, when_made: tuple[str, ...]) -> DataFrame:
    return listings.filter(F.col("when_made").isin(*when_made)).join(taxonomies.select("taxonomy_id").distinct(), "taxonomy_id", "left_semi")


def max_price(listings: DataFrame, taxonomies: DataFrame) -> DataFrame:
    highest = listings.groupBy("taxonomy_id").agg(F.max("price").alias("max_price"))
    return taxonomies.select("taxonomy_id").join(highest, "taxonomy_id", "left").withColumn("max_price", F.coalesce("max_price", F.lit(UNBOUNDED)))


def histogram(listings: DataFrame) -> DataFrame:
    """(taxonomy_id, cents, n): one combining aggregate."""
    priced = listings.filter("taxonomy_id is not null and price is not null and price >= 0")
    return priced.groupBy("taxonomy_id", F.round(F.col("price") * 100).cast("bigint").alias("cents")).agg(F.count(F.lit(1)).alias("n"))


def grown_breaks(cents: np.ndarray, n: np.ndarray, target: int) -> list[float]:
    """Breaks by growing each interval to the target by tenths, then shrinking it by hundredths to under it.

    A single price that holds the target's count makes an oversized interval of its own.
    """
    total = np.concatenate(([0], np.cumsum(n)))
    if total[-1] <= target:
        return [0.0, UNBOUNDED]
    upto = lambda x: int(total[np.searchsorted(cents, int(np.floor(x * 100 + 1e-6)), side="right")])
    before = lambda x: int(total[np.searchsorted(cents, int(np.round(x * 100)), side="left")])
    highest, breaks, lower, upper = cents[-1] / 100, [0.0], 0.0, 5.0
    while True:
        while upto(upper) - before(lower) < target and upper < highest:
            upper *= 1.10
        if upper >= highest:
            return [*breaks, UNBOUNDED]
        while upto(upper) - before(lower) >= target:
            upper *= 0.99
        if upper < lower:  # a hundredth of the price holds the target: take the last price that stays under it
            last = int(np.searchsorted(total, before(lower) + target, side="left")) - 1
            upper = cents[last - 1] / 100 if last > 0 else lower
        split = max(round(upper, 2), round(lower, 2))  # one cent of progress at least
        breaks.append(split)
        lower = round(split + 0.01, 2)
        upper = lower * 1.10


def halved_breaks(cents: np.ndarray, n: np.ndarray, target: int, near: int = 200, steps: int = 15) -> list[float]:
    """Breaks by halving intervals at a searched midpoint until none holds more than the target; intervals are half-open."""
    total = np.concatenate(([0], np.cumsum(n)))
    upto = lambda x: int(total[np.searchsorted(cents, int(round(x * 100)), side="right")])
    breaks, todo = set(), [(-0.01, UNBOUNDED)]
    while todo:
        low, high = todo.pop()
        count = upto(high) - upto(low)
        if count <= target:
            continue
        a, b = max(low, 0.0), high
        for _ in range(steps):
            middle = (a + b) / 2
            gap = upto(middle) - upto(low) - count // 2
            if abs(gap) < near:
                break
            a, b = (middle, b) if gap < 0 else (a, middle)
        half = float(round(middle))
        if not max(low, 0.0) < half < high:  # no whole price inside: no progress is possible
            continue
        breaks.add(half)
        todo += [(low, half), (half, high)]
    return [0.0, *sorted(breaks), UNBOUNDED]


def search_breaks(listings: DataFrame, search: Callable[[np.ndarray, np.ndarray, int], list[float]], target: int) -> DataFrame:
    """(taxonomy_id, price_breaks): one group per taxonomy, of its distinct prices."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cents")
        return pd.DataFrame({"taxonomy_id": [frame["taxonomy_id"].iloc[0]], "price_breaks": [search(frame["cents"].to_numpy(), frame["n"].to_numpy(), target)]})

    return histogram(listings).groupBy("taxonomy_id").applyInPandas(run, "taxonomy_id bigint, price_breaks array<double>")


def price_breaks_grow(listings: DataFrame, target: int = GROW_TARGET) -> DataFrame:
    return search_breaks(listings, grown_breaks, target)


def price_breaks_halve(listings: DataFrame, target: int = HALVE_TARGET) -> DataFrame:
    return search_breaks(listings, halved_breaks, target)


def interval_loads(listings: DataFrame, breaks: DataFrame) -> DataFrame:
    """Counts per interval of searched breaks, to see how even they are. The breaks are searched once and stored."""
    config = materialise(breaks, "breaks").select("taxonomy_id", F.lit("").alias("name"), "price_breaks")
    return bucket_counts(listings, crawl_units(config))

