"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from skyledger.session import scratch_path, ship_package

#: Keys of rows that are broadcast: two numbers each, some 50 MB.
MOST_KEYS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_in_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` on executors that need no copy of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``row_key``, which tells rows of one id apart.

    Only these two columns are taken, so further columns of ``docs`` may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("row_key", F.xxhash64("text"))


def attach(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with the columns that ``found`` has for its row, null where it has none."""
    right = found.withColumnsRenamed({"doc_id": "found_id", "row_key": "found_key"})
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key"))
    return texts.join(right, same, "left").drop("found_id", "found_key")


def row_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (stored; each ``doc_id`` and ``row_key`` once, null ids too) with the texts of its rows; equal rows each come.

    The keys alone pick the texts first: up to ``MOST_KEYS`` of them (counted) go to the texts, more meet them in a shuffle.
    """
    keys = found.select(F.col("doc_id").alias("found_id"), F.col("row_key").alias("found_key"))
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key"))
    few = F.broadcast(keys) if found.count() <= MOST_KEYS else keys
    picked = stored(texts.join(few, same, "left_semi"), "texts")
    return attach(picked, found)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; plain ASCII texts take the quick way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda uses it."""
    return F.transform(F.array(value), body)[0]


def running_sum(values: Column, chunk: int = 256) -> Column:
    """Sums of all earlier elements, by chunks so that long arrays aren't copied for each element."""
    grow = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    zero = F.array(F.lit(0).cast("long"))

    def of(pair: Column) -> Column:
        return F.flatten(
            F.transform(
                pair["sums"],
                lambda own, i: F.transform(F.slice(own, 1, F.size(own) - 1), lambda v: v + pair["before"][i]),
            )
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(chunk))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, chunk), zero, grow))
    both = let(
        sums,
        lambda own: F.struct(
            own.alias("sums"),
            F.aggregate(own, zero, lambda acc, x: grow(acc, F.element_at(x, -1))).alias("before"),
        ),
    )
    return let(both, of)
