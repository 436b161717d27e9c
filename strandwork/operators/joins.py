"""Interval joins and ordered numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the bins that ranges are dealt to, in letters.
WIDTH = 1 << 14
#: Buckets that rows are numbered in; their counts are all that meets in one task.
BUCKETS = 1024


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs that share ``on`` and whose half-open ranges a (of left) and b (of right) overlap.

    Ranges are dealt to bins of a width, so a long key is split; a pair comes out of the bin in which the later of its
    starts lies, once.
    """
    (a0, a1), (b0, b1) = a, b
    meets = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(F.col(s), F.col(e) - 1) / width)))
    joined = left.withColumn("_bin", bins(a0, a1)).join(right.withColumn("_bin", bins(b0, b1)), [*on, "_bin"])
    return joined.where(meets & (F.floor(F.greatest(a0, b0) / width) == F.col("_bin"))).drop("_bin")


def point_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, r: tuple[str, str], width: int = WIDTH) -> DataFrame:
    """Pairs that share ``on`` and whose point lies in the half-open range, which is dealt to bins."""
    inside = (F.col(r[0]) <= F.col(point)) & (F.col(point) < F.col(r[1]))
    spread = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(r[0]) / width), F.floor(F.greatest(F.col(r[0]), F.col(r[1]) - 1) / width))))
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(spread, [*on, "_bin"]).where(inside).drop("_bin")


def numbered(df: DataFrame, key: list[str], name: str = "id", start: int | Column = 1) -> DataFrame:
    """df with the numbers start, start + 1, ... in an order that depends on the key alone.

    Rows are counted in fixed buckets of the key's hash and numbered inside each, so no task sees all rows and a
    retried task gives the same numbers.
    """
    held = df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)))
    counts = held.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*key))
    first = start if isinstance(start, Column) else F.lit(start)
    return held.join(F.broadcast(before), "_bucket").withColumn(name, (first + F.col("_before") + inside - 1).cast("long")).drop("_bucket", "_before")


def spread_ids(df: DataFrame, key: list[str], name: str = "id", start: int = 1, by: list[str] | None = None) -> DataFrame:
    """df with numbers from start on that are unique but leave gaps: the rows of a bucket take every BUCKETS-th number.

    Unlike ``numbered`` it needs no count before, so it is one shuffle and no job of its own; a retried task gives the same
    numbers. Rows that are equal in ``by`` (a part of the key; else all of it) get theirs in the order of the key.
    """
    held = df.withColumn("_bucket", F.pmod(F.xxhash64(*(by or key)), F.lit(BUCKETS)))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*key))
    return held.withColumn(name, (F.lit(start) + (place - 1) * F.lit(BUCKETS) + F.col("_bucket")).cast("long")).drop("_bucket")


def next_id(table: DataFrame, name: str = "id") -> int:
    return (table.agg(F.max(name)).first()[0] or 0) + 1


def same(columns: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality on all columns."""
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def missing_from(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of rows that the table does not hold; null equals null."""
    r, t = rows.dropDuplicates(key).alias("r"), table.select(*key).alias("t")
    on = F.lit(True)
    for c in key:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    return r.join(t, on, "left_anti")


def resolved(table: DataFrame, rows: DataFrame, key: list[str], id_col: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """rows, in any order and with repeats, with the id that their key has, and existed: whether the table held it.

    Rows and table meet once, by a bucket of the key's hash; what the table lacks is numbered there, from the highest id on,
    as ``numbered`` does. Null equals null.
    """
    spare = [c for c in rows.columns if c not in key and c != id_col]
    hashed = F.xxhash64(*key)
    bucket = F.pmod(hashed, F.lit(buckets)).cast("int").alias("_bucket")
    old = table.select(bucket, *key, F.col(id_col).alias("_old"), F.lit(None).alias("_rest"))
    new = rows.select(bucket, *key, F.lit(None).cast("long").alias("_old"), F.struct(F.lit(0).alias("_"), *spare).alias("_rest"))
    both = old.withColumn("_rest", F.lit(None).cast(new.schema["_rest"].dataType)).unionByName(new).repartition("_bucket")
    same_key = W.partitionBy("_bucket", *key)
    both = both.withColumn("_old", F.max("_old").over(same_key))
    first = F.col("_old").isNull() & (F.row_number().over(same_key.orderBy(F.lit(0))) == 1)
    both = both.withColumn("_first", first.cast("long"))
    counts = both.groupBy("_bucket").agg(F.sum("_first").alias("_n"))  # a row for each bucket
    before = counts.select("_bucket", (F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    # rows of one key are peers in this order, so all of them get the number of their first
    place = F.sum("_first").over(W.partitionBy("_bucket").orderBy(*key))
    top = next_id(table, id_col)
    made = (F.lit(top) + F.col("_before") + place - 1).cast("long")
    return (
        both.join(F.broadcast(before), "_bucket")
        .withColumn(id_col, F.coalesce("_old", made))
        .where("_rest is not null")
        .select(id_col, *key, *[F.col(f"_rest.{c}").alias(c) for c in spare], F.col("_old").isNotNull().alias("existed"))
    )


def get_or_create(table: DataFrame, rows: DataFrame, key: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to append, with new ids; all rows, in any order and with repeats, with the id that their key now has)."""
    every = resolved(table, rows, key, id_col)
    new = every.where("not existed").dropDuplicates([id_col]).select(*table.columns)
    return new, every.drop("existed")
