"""Equi-join that splits hot keys over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot when it makes more than one part in SHARE of all pairs of rows, so there
# are fewer than SHARE hot keys and their list is always small. Keys of fewer pairs than
# MIN_PAIRS are never worth dividing.
SHARE = 1000
MIN_PAIRS = 4_000_000

# Groups per key in a join with a narrow lookup table.
SALT = 8


def key_loads(
    left: DataFrame, right: DataFrame, on: list[str], share: int = SHARE, min_pairs: int = MIN_PAIRS,
    most_right: int | None = None,
) -> tuple[DataFrame | None, float]:
    """Hot keys as ``hot_keys`` gives them, and the number of all pairs of rows.

    With ``most_right`` keys of more rows than that on the right are in the list too, in chunks of at most so many.
    """
    sides = left.select(*on, F.lit(1).alias("_l")).unionAll(right.select(*on, F.lit(0).alias("_l")))
    rows = sides.groupBy(*on).agg(F.sum("_l").cast("double").alias("_a"), F.sum(1 - F.col("_l")).cast("double").alias("_b"))
    counts = rows.withColumn("_pairs", F.col("_a") * F.col("_b"))
    seen = counts.agg(F.sum("_pairs").alias("total"), F.max("_pairs").alias("top"), F.max("_b").alias("right")).first()
    total = seen.total or 0
    bound = max(total / share, min_pairs)
    many = most_right is not None and (seen.right or 0) > most_right
    if (seen.top or 0) <= bound and not many:
        return None, total
    # Both sides in chunks of at most ``edge`` rows: no task has more than ``bound`` pairs of a key.
    edge = bound**0.5
    is_hot = F.col("_pairs") > bound
    wanted = {"_lc": F.when(is_hot, F.ceil(F.col("_a") / edge)), "_rc": F.when(is_hot, F.ceil(F.col("_b") / edge))}
    if many:
        wanted["_rc"] = F.greatest(wanted["_rc"], F.ceil(F.col("_b") / most_right))
        is_hot = is_hot | (F.col("_b") > most_right)
    chunks = [F.coalesce(count, F.lit(1)).cast("int").alias(name) for name, count in wanted.items()]
    hot = counts.where(is_hot).select(*on, *chunks)
    return left.sparkSession.createDataFrame(hot.collect(), hot.schema), total


def hot_keys(
    left: DataFrame, right: DataFrame, on: list[str], share: int = SHARE, min_pairs: int = MIN_PAIRS
) -> DataFrame | None:
    """Hot keys and the numbers of chunks, ``_lc`` and ``_rc``, for both sides' rows; ``None`` if there are none.

    What a key costs is the product of both sides' rows. One job counts both sides, combined
    before the shuffle; only its sum and maxima come back. A second one fetches the list,
    fewer than ``share`` rows, when a key is hot.
    """
    return key_loads(left, right, on, share, min_pairs)[0]


def _chunk(rows: list[str], chunks: str) -> Column:
    return F.pmod(F.xxhash64(*rows), F.coalesce(F.col(chunks), F.lit(1)).cast("bigint")).cast("int")


def _every(chunks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(chunks), F.lit(1)) - 1))


def deal(
    left: DataFrame, right: DataFrame, on: list[str], left_row: list[str], right_row: list[str], hot: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Both sides with chunks ``_li`` and ``_ri``: rows of a hot key are in one of their side's, once for each of the other's."""
    hot = F.broadcast(hot)  # fewer than ``share`` rows, or one in very many rows
    dealt_left = left.join(hot, on, "left").select(
        *left.columns, _chunk(left_row, "_lc").alias("_li"), _every("_rc").alias("_ri")
    )
    dealt_right = right.join(hot, on, "left").select(
        *right.columns, _chunk(right_row, "_rc").alias("_ri"), _every("_lc").alias("_li")
    )
    return dealt_left, dealt_right


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_row: list[str],
    right_row: list[str],
    share: int = SHARE,
    min_pairs: int = MIN_PAIRS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join on ``on``; the pairs of a hot key go to several tasks.

    The rows of a hot key are dealt over chunks by a hash of ``left_row`` or ``right_row``
    (columns that tell rows apart), and repeated once per chunk of the other side. Every
    pair still meets exactly once. ``on`` must hold no NULL. Neither side is broadcast: the size of exploded
    rows is estimated from the rows before, so millions of them would be gathered in the driver.
    ``counted`` has the keys of ``left`` where those cost less without its other columns.
    """
    hot = hot_keys(left if counted is None else counted, right, on, share, min_pairs)
    if hot is None:
        return left.join(right.hint("merge"), on)
    dealt_left, dealt_right = deal(left, right, on, left_row, right_row, hot)
    return dealt_left.join(dealt_right.hint("merge"), [*on, "_li", "_ri"]).drop("_li", "_ri")


def lookup_join(df: DataFrame, lookup: DataFrame, on: str, how: str = "left", salt: int = SALT) -> DataFrame:
    """Join many rows per key with a narrow table of at most one row per key.

    Whether the lookup is broadcast is decided from its size. Otherwise the rows of a key
    go to ``salt`` groups by a hash of their other columns, each with a copy of the lookup
    row. The salted key also makes Spark shuffle the lookup anew even when it is grouped
    by ``on`` already; without a shuffle of its own on both sides, the adaptive join could
    not split a group that is still too large.
    """
    others = [name for name in df.columns if name != on]
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salt).cast("bigint")).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")
