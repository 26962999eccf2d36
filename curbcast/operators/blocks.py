"""Fragment-and-replicate join: an exact pair join whose work is split into
bounded blocks, so that no key (a view, a market) lands in one task.

Key sizes are counted first.  While every key is within ``block_rows`` on both
sides a plain equi join is enough.  Otherwise each side of a key is cut into
fragments of about ``block_rows`` rows (by hash) and every fragment of the left
meets every fragment of the right under its own join key.  Callers aggregate
the pairs right after the join, so pairs are combined map-side and are never
shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_ROWS = 8192
BROADCAST_ROWS = 200_000


def key_sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on both sides: keys, _l, _r."""
    both = left.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionAll(
        right.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return both.groupBy(*keys).agg(F.sum("_a").alias("_l"), F.sum("_b").alias("_r"))


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_hash: list[str],
               right_hash: list[str], how: str = "inner", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Equi join on ``keys`` with oversized keys split into bounded fragments.

    ``how`` may be 'inner' or 'left'.  With 'left', a left row without partner
    in a fragment yields one null-extended row per fragment; aggregates over
    the right columns ignore them.  Both inputs are read twice: pass staged or
    cheap ones.

    The counted sizes also choose the strategy.  A right side of at most
    ``BROADCAST_ROWS`` rows is broadcast and the left is spread by its own rows;
    a larger one is shuffled by key.  The number of tasks follows the number of
    pairs, because pairs and not bytes are the work here.
    """
    if how not in ("inner", "left"):
        raise ValueError("block_join supports inner and left joins")
    sizes = key_sizes(left, right, keys)
    top = sizes.agg(F.max("_l"), F.max("_r"), F.sum("_r"), F.sum(F.col("_l").cast("double") * F.col("_r"))).first()
    tasks = pair_tasks(left, top[3] or 0.0)
    if (top[2] or 0) <= BROADCAST_ROWS:
        return left.repartition(tasks, *keys, *left_hash).join(F.broadcast(right), keys, how)
    if max(top[0] or 0, top[1] or 0) <= block_rows:
        return left.repartition(tasks, *keys).join(right.repartition(tasks, *keys), keys, how)
    parts = sizes.select(*keys, *[F.greatest(F.lit(1), F.ceil(F.col(c) / float(block_rows))).cast("int").alias(n)
                                  for c, n in (("_l", "_lf"), ("_r", "_rf"))])

    def place(df: DataFrame, own: str, other: str, own_ix: str, other_ix: str, cols: list[str]) -> DataFrame:
        return (df.join(parts, keys)
                .withColumn(own_ix, F.pmod(F.xxhash64(*cols), F.col(own)).cast("int"))
                .withColumn(other_ix, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
                .drop("_lf", "_rf").repartition(tasks, *keys, "_lb", "_rb"))

    lb = place(left, "_lf", "_rf", "_lb", "_rb", left_hash)
    rb = place(right, "_rf", "_lf", "_rb", "_lb", right_hash)
    return lb.join(rb, [*keys, "_lb", "_rb"], how).drop("_lb", "_rb")


def pair_tasks(df: DataFrame, pairs: float) -> int:
    """Tasks for a number of pairs: about 50 000 to 20 million pairs each.

    Small work takes few tasks; usual work takes the session's shuffle
    partitions; very large work takes more, so that a task stays short.
    """
    spark = df.sparkSession
    usual = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return int(max(1, min(usual, pairs // 50_000 + 1), pairs // 20_000_000))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash partitioning with the session's full task count.

    An explicit count is not merged at run time: the work per row of grouped
    Python code is far above its bytes.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *cols)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that later steps read instead of computing them again.

    A column of ``withColumn`` is put in place of its name wherever a later
    projection or filter of the same chain reads it, so a costly one (a distance
    of a pair) is computed many times a row.  A generated row ends the chain.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
