"""Range algebra over half-open ranges, which may wrap around the origin of a circular sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAR = (1 << 63) - 1


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def rng(start, end) -> Column:
    return F.struct(_c(start).cast("long").alias("start"), _c(end).cast("long").alias("end"))


def extend(a, b) -> Column:
    return rng(_c(a)["start"], _c(b)["end"])


def left_adjoins(a, b, modulus: Column | None = None) -> Column:
    end, start = _c(a)["end"], _c(b)["start"]
    return end == start if modulus is None else (end % modulus) == (start % modulus)


def wraps(a) -> Column:
    return _c(a)["start"] > _c(a)["end"]


def linear(a) -> Column:
    """The pieces of a range: two if it wraps, the second from the origin on."""
    a = _c(a)
    return F.when(wraps(a), F.array(rng(a["start"], F.lit(FAR)), rng(F.lit(0), a["end"]))).otherwise(F.array(rng(a["start"], a["end"])))


def overlaps(a, b) -> Column:
    """The overlaps of two ranges, none to two of them, by start."""
    pairs = F.flatten(F.transform(linear(a), lambda x: F.transform(linear(b), lambda y: rng(F.greatest(x["start"], y["start"]), F.least(x["end"], y["end"])))))
    return F.array_sort(F.filter(pairs, lambda r: r["start"] < r["end"]))


def pairwise(left: DataFrame, right: DataFrame, on: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Overlap of each pair of ranges that share a key: kept if a ends after b starts and does not start after b ends."""
    joined = left.join(right, on)
    x, y = F.col(a), F.col(b)
    return joined.where((x["end"] > y["start"]) & (x["start"] <= y["end"])).withColumn(
        "overlap", rng(F.greatest(x["start"], y["start"]), F.least(x["end"], y["end"]))
    )


def about_the_origin(found: Column, size: int = FAR) -> Column:
    """A first overlap from the origin on and a last one up to the far end are one that wraps."""
    first, last = F.element_at(found, 1), F.element_at(found, -1)
    joins = (F.size(found) > 1) & (first["start"] == 0) & (last["end"] == size)
    inner = F.slice(found, F.lit(2), F.greatest(F.size(found) - 2, F.lit(0)))
    return F.when(joins, F.concat(inner, F.array(rng(last["start"], first["end"])))).otherwise(found)


def contains(a, index) -> Column:
    """Both ends count."""
    a, i = _c(a), _c(index)
    return F.when(wraps(a), (i >= a["start"]) | (i <= a["end"])).otherwise((i >= a["start"]) & (i <= a["end"]))


def circular(index, size, is_circular) -> Column:
    i, n = _c(index), _c(size)
    return F.when(_c(is_circular), F.pmod(i, n)).otherwise(i)


def translated(index, source, target) -> Column:
    """Where an index of the source range lies in the target; null outside."""
    s = _c(source)
    return F.when(contains(s, index), _c(target)["start"] + _c(index) - s["start"])


def merged_mappings(df: DataFrame, key: list[str]) -> DataFrame:
    """Mappings (s0, s1) -> (t0, t1) with each run of those that adjoin on both sides as one."""
    order = W.partitionBy(*key).orderBy("s0", "s1", "t0", "t1")
    new = ~F.coalesce((F.lag("s1").over(order) == F.col("s0")) & (F.lag("t1").over(order) == F.col("t0")), F.lit(False))
    island = F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return (
        df.withColumn("island", island)
        .groupBy(*key, "island")
        .agg(F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
        .drop("island")
    )
