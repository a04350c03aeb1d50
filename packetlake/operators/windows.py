"""Windows over one key's history that no task has to hold whole: time is cut into blocks, and blocks are joined by their ends."""

import functools
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetlake.operators.stored import stored

#: Rows of a stored table of keys that are broadcast.
BROADCAST = 400_000


def sliding(df: DataFrame, keys: list[str], width: int, **columns) -> DataFrame:
    """Add columns computed over the key's rows of the last `width` milliseconds, the current one included.

    columns: name -> function of a window. Time is cut into blocks of that width, and each row also goes to the next
    block as context, so a frame never leaves its (key, block) and one key's history is spread over many tasks.
    """
    w = W.partitionBy(*keys, "_block").orderBy("ts_ms").rangeBetween(-(width - 1), 0)
    return _doubled(df, width).withColumns({name: f(w) for name, f in columns.items()}).where("_own").drop("_own", "_block")


def count_in_window(df: DataFrame, keys: list[str], width: int, name: str) -> DataFrame:
    """Add the number of the key's rows in the last `width` milliseconds, those of the same millisecond included."""
    return sliding(df, keys, width, **{name: lambda w: F.count("*").over(w)})


def newest_in_window(df: DataFrame, keys: list[str], width: int, value: str, name: str) -> DataFrame:
    """Add the newest `value` that is not empty of the key's rows in the last `width` milliseconds; of one millisecond that of the largest pkt_id."""
    newest = F.max(F.when(F.col(value) != "", F.struct("ts_ms", "pkt_id", value)))
    return sliding(df, keys, width, **{name: lambda w: newest.over(w)[value]})


def _doubled(df: DataFrame, width: int) -> DataFrame:
    block = F.floor(F.col("ts_ms") / width)
    return df.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_block", F.when(F.col("_own"), block).otherwise(block + 1))


def distinct_in_window(df: DataFrame, keys: list[str], value: str, width: int, **tests) -> DataFrame:
    """Add, for each test (name -> condition on the row), how many different values rows that pass it had in the last `width` milliseconds.

    No set is built: a value counts from the row that brings it until `width` after the last one before a gap, and the
    counts are a running sum of those beginnings and ends.
    """
    rows = _doubled(df, width).repartition(*keys, "_block")
    seen = W.partitionBy(*keys, "_block", value).orderBy("ts_ms", "pkt_id")
    rows = rows.withColumns({"_last": F.lag("ts_ms").over(seen), "_next": F.lead("ts_ms").over(seen)})
    fresh = F.coalesce(F.col("ts_ms") - F.col("_last") >= width, F.lit(True))
    gone = F.coalesce(F.col("_next") - F.col("ts_ms") >= width, F.lit(True))
    steps = F.array(F.struct(F.col("ts_ms").alias("at"), fresh.cast("int").alias("step"), F.lit(True).alias("real")), F.when(gone, F.struct((F.col("ts_ms") + width).alias("at"), F.lit(-1).alias("step"), F.lit(False).alias("real"))))
    rows = rows.withColumn("_x", F.explode(steps)).where("_x is not null")
    so_far = W.partitionBy(*keys, "_block").orderBy("_x.at").rangeBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({name: F.sum(F.when(test, F.col("_x.step")).otherwise(0)).over(so_far) for name, test in tests.items()})
    return rows.where("_own and _x.real").drop("_own", "_block", "_last", "_next", "_x")


def busy(df: DataFrame, keys: list[str], width: int, least: int, value: str | None = None) -> DataFrame:
    """df without rows that can't matter where a window of `width` milliseconds must hold `least` rows (or different values of `value`).

    A window lies in its row's block of time and the one before. Blocks that have fewer together with the one before are
    left out, but for those that the next one needs: counts from `least` on stay as they are, lower ones may get lower.
    """
    block = F.floor(F.col("ts_ms") / width)
    rows = df.select(*keys, block.alias("_block"), *([value] if value else []))
    counted = (rows.distinct() if value else rows).groupBy(*keys, "_block").agg(F.count("*").alias("_k"))
    two = counted.select(*keys, F.explode(F.array(F.col("_block"), F.col("_block") + 1)).alias("_block"), "_k").groupBy(*keys, "_block").agg(F.sum("_k").alias("_k"))
    kept = two.where(F.col("_k") >= least).select(*keys, F.explode(F.array(F.col("_block"), F.col("_block") - 1)).alias("_block")).distinct()
    kept = _dealt(stored(kept.select(*[F.col(k).alias("_of_" + k) for k in keys], F.col("_block").alias("_of_block"))))
    same = [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys]
    return df.join(kept, functools.reduce(Column.__and__, same, block == F.col("_of_block")), "left_semi")


def _dealt(table: DataFrame) -> DataFrame:
    """A stored table as one side of a join: broadcast if it has BROADCAST rows at most, else both sides are shuffled."""
    return F.broadcast(table) if table.limit(BROADCAST + 1).count() <= BROADCAST else table.hint("merge")


def running_total(df: DataFrame, key: str, value: str, name: str, block_ms: int = 600_000, changes=None) -> DataFrame:
    """Add the key's sum of `value` up to each row in order of (ts_ms, pkt_id): sums of blocks first, then inside each block.

    changes: a condition on (sum before a block, sum behind it); the rows of other blocks are left out.
    """
    rows = df.withColumn("_block", F.floor(F.col("ts_ms") / block_ms))
    sums = rows.groupBy(key, "_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(value).over(W.partitionBy(key, "_block").orderBy("ts_ms", "pkt_id").rowsBetween(W.unboundedPreceding, 0))
    sums = sums.select(key, "_block", before.alias("_before"), "_sum")
    if changes is not None:
        sums = _dealt(stored(sums.where(changes(F.col("_before"), F.col("_before") + F.col("_sum")))))
    return rows.join(sums.drop("_sum"), [key, "_block"]).withColumn(name, F.col("_before") + inside).drop("_block", "_before")


def previous(df: DataFrame, key: str, value: str, name: str, block_ms: int = 600_000) -> DataFrame:
    """Add the key's `value` of the row before in order of (ts_ms, pkt_id): each block starts from the last row of the one before."""
    rows = df.withColumn("_block", F.floor(F.col("ts_ms") / block_ms))
    last = rows.groupBy(key, "_block").agg(F.max_by(F.struct(value), F.struct("ts_ms", "pkt_id")).alias("_end"))
    carried = last.select(key, "_block", F.lag("_end").over(W.partitionBy(key).orderBy("_block")).alias("_carried"))
    lag = F.lag(F.struct(value)).over(W.partitionBy(key, "_block").orderBy("ts_ms", "pkt_id"))
    return rows.join(carried, [key, "_block"]).withColumn(name, F.coalesce(lag, "_carried")[value]).drop("_block", "_carried")


def sums_before(rows: DataFrame, block: str, per: int = 4096, **values) -> DataFrame:
    """(block, name, ...): for each value (name -> aggregate, whole numbers or decimals), its sum over all rows of earlier blocks.

    Blocks (numbers) are added up in groups of `per`, and only the groups' sums, one row for `per` blocks, come to the
    driver; inside a group a window goes over its blocks.
    """
    sums = stored(rows.groupBy(block).agg(*[v.alias(n) for n, v in values.items()]).withColumn("_group", F.floor(F.col(block) / per)))
    groups, so_far, out = sums.groupBy("_group").agg(*[F.sum(n).alias(n) for n in values]).orderBy("_group").collect(), dict.fromkeys(values, 0), []
    for g in groups:
        out.append((g["_group"], *so_far.values()))
        so_far = {n: so_far[n] + (g[n] or 0) for n in values}
    kinds = dict(sums.dtypes)
    start = sums.sparkSession.createDataFrame([(g, *map(_whole, x)) for g, *x in out], "_group long, " + ", ".join(f"_{n} decimal(38,{_scale(kinds[n])})" for n in values))
    inside = W.partitionBy("_group").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    own = {n: F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in values}
    return sums.withColumns(own).join(F.broadcast(start), "_group").select(block, *[(F.col(n) + F.col("_" + n)).cast(_sum_of(kinds[n])).alias(n) for n in values])


def _whole(x):
    return x if isinstance(x, Decimal) else Decimal(x)


def _scale(kind: str) -> int:
    return int(kind.rstrip(")").split(",")[1]) if kind.startswith("decimal") else 0


def _sum_of(kind: str) -> str:
    return f"decimal(38,{_scale(kind)})" if kind.startswith("decimal") else "long"


def running_over_all(df: DataFrame, value, name: str, block_ms: int = 10_000) -> DataFrame:
    """Add the sum of `value` (whole numbers) over all rows up to each one in order of (ts_ms, pkt_id), with no task that sees them all."""
    rows = df.withColumns({"_block": F.floor(F.col("ts_ms") / block_ms), "_value": value})
    before = sums_before(rows, "_block", _before=F.sum("_value"))
    inside = F.sum("_value").over(W.partitionBy("_block").orderBy("ts_ms", "pkt_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(before, "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_value", "_inside", "_before")


def nth_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, ts_ms, pkt_id) of each key's n-th row in order of (ts_ms, pkt_id). Each task passes on at most n rows of a key."""
    place = F.row_number().over(W.partitionBy(key).orderBy("ts_ms", "pkt_id"))
    return df.select(key, "ts_ms", "pkt_id").withColumn("_place", place).where(F.col("_place") <= n).where(F.col("_place") == n).drop("_place")
