"""Spelling variants: words grouped with their more frequent neighbours by a dictionary of trie-node pairs.

1. Runs of letters are counted as words; a planted damage (``damaged``) takes one letter from some runs first.
2. Words in range-sorted order are walked as a trie: a word shares its first nodes with the word before it and numbers
   the rest anew, so every distinct prefix has one integer. The same over reversed words numbers the suffixes. Neighbouring
   range partitions agree on the nodes at their border through their first and last words, one pair for each partition.
3. A word enters the dictionary under pairs (prefix node, suffix node): once for each skipped letter, and once for each
   gap where a letter may be inserted. Words that skip a letter at one pair differ by a replacement; a word with a gap
   at a pair is what the words that skip a letter there become by a deletion (counted at the first of several
   equal letters, so that each neighbour counts once). That is exact; nothing is verified or missed.
4. A pair holds at most one word with a gap and one skipping word for each letter of the alphabet (90). So a group is
   bounded, whatever the words are, and gives counts and the most frequent neighbour for its members, not pairs of words.
5. Forms are followed from the roots downwards, level by level. A word's form has twice its count, so levels are few.

Definitions: null and empty texts have no words. Each row counts, also rows with equal ids; a null ``doc_id`` is written as an
empty text in the damage's checksum. Ties between neighbours go to the smallest word in code-point order. A word without
neighbours is its own root. An empty table gives no rows. Texts are read whole; a word of L letters has 2 L + 1 pairs of integers, so long
runs cost in proportion to their length. Of ``docs`` only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import ascii_lower, map_in_arrow
from skyledger.session import scratch_path

LETTERS = r"[A-Za-zÀ-ÿ]+"
SHORTEST, RAREST = 5, 3
DAMAGE = 97
#: A numbered word or node is its partition in the upper bits and its number there in the lower ones.
_PART = 40


def damaged(doc_id: Column, run: Column) -> Column:
    """The run without one letter, if ``DAMAGE`` divides the checksum of document and run."""
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(check, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(check % DAMAGE == 0, cut).otherwise(run)


def count_words(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """``word`` and ``n`` of all words that are long and frequent enough."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    # The damage takes one letter at most, so shorter runs can't become words.
    runs = runs.where(F.length("run") >= shortest).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    words = runs.select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= rarest)


def shared_letters(one: str, two: str) -> int:
    n = min(len(one), len(two))
    if one[:n] == two[:n]:
        return n
    return next(i for i in range(n) if one[i] != two[i])


def walk_trie(words: DataFrame, nodes: str, place: str) -> DataFrame:
    """``words`` (``key`` and further columns) in the order of their keys, with ``place`` and the trie ``nodes`` of the key's prefixes.

    The nodes of a partition's first word are numbered anew here; ``borders`` tells which of them the partition before has already.
    """
    columns = [c for c in words.columns if c != "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _PART
        before, path, made, seen = "", np.zeros(1, np.int64), 0, 0
        for batch in batches:
            paths = []
            for word in batch.column("key").to_pylist():
                old = shared_letters(before, word)
                new = len(word) - old
                path = np.concatenate([path[: old + 1], np.arange(base + made + 1, base + made + 1 + new)])
                made, before = made + new, word
                paths.append(path)
            places = pa.array(np.arange(seen, seen + batch.num_rows) + base, pa.int64())
            seen += batch.num_rows
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
            flat = np.concatenate([np.zeros(0, np.int64), *paths])
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ["key", *columns]), places, listed], ["key", *columns, place, nodes])

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.select("key", *columns).repartitionByRange(n, "key").sortWithinPartitions("key")
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return map_in_arrow(ordered, run, ", ".join(f"{c} {kinds[c]}" for c in kinds) + f", {place} bigint, {nodes} array<bigint>")


def borders(walked: DataFrame, nodes: str, place: str) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that a partition's first word numbered anew, and the numbers they have from the partitions before it.

    Read from one row for each partition.
    """
    edges = (
        walked.groupBy(F.shiftright(place, _PART).alias("part"))
        .agg(
            F.min("key").alias("first"), F.min_by(nodes, place).alias("first_nodes"),
            F.max("key").alias("last"), F.max_by(nodes, place).alias("last_nodes"),
        )
        .orderBy("part")
        .collect()
    )
    same: dict[int, int] = {}
    before, path = "", [0]
    for edge in edges:
        shared = shared_letters(before, edge.first)
        same |= {edge.first_nodes[d]: path[d] for d in range(1, shared + 1)}
        before, path = edge.last, [same.get(node, node) for node in edge.last_nodes]
    own = np.array(sorted(same), np.int64)
    return own, np.array([same[node] for node in own.tolist()], np.int64)


def node_pairs(walked: DataFrame, prefixes: tuple, suffixes: tuple) -> DataFrame:
    """The dictionary: ``a``, ``b`` (prefix and suffix node), the word's ``id`` and ``n``, and ``kind``.

    Kind 0 has a gap between prefix and suffix, 1 and 2 skip a letter; 2 is the first of equal letters in a row.
    """
    shared = walked.sparkSession.sparkContext.broadcast((prefixes, suffixes))

    def settled(nodes: np.ndarray, same: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        own, real = same
        if not len(own):
            return nodes
        at = np.minimum(np.searchsorted(own, nodes), len(own) - 1)
        return np.where(own[at] == nodes, real[at], nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, suffixes = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 2000):
                batch = whole.slice(first, 2000)
                ids, ns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
                rows: list[list[np.ndarray]] = []
                heads = [np.array(x, np.int64) for x in batch.column("heads").to_pylist()]
                tails = [np.array(x, np.int64) for x in batch.column("tails").to_pylist()]
                for at, word in enumerate(batch.column("word").to_pylist()):
                    size = len(word)
                    head, tail = heads[at], tails[at][::-1]  # by the number of letters before
                    letters = np.array(list(map(ord, word)))
                    start = np.concatenate([[True], letters[1:] != letters[:-1]])
                    kind = np.concatenate([np.zeros(size + 1, np.int8), 1 + start.astype(np.int8)])
                    row = np.full(2 * size + 1, at)
                    rows.append([np.concatenate([head, head[:-1]]), np.concatenate([tail, tail[1:]]), kind, row])
                if rows:
                    a, b, kind, row = map(np.concatenate, zip(*rows))
                    columns = [settled(a, prefixes), settled(b, suffixes), ids[row], ns[row], kind]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "id", "n", "kind"])

    return map_in_arrow(walked.select("word", "id", "n", "heads", "tails"), run, "a bigint, b bigint, id bigint, n bigint, kind tinyint")


def neighbour_counts(pairs: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (count, negative id) of every word with a neighbour."""
    # Larger is better: the count, then the smaller word.
    member = F.struct("n", (-F.col("id")).alias("minus"), "kind")
    groups = pairs.groupBy("a", "b").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)
    rank = lambda x: F.struct(x["n"].alias("n"), x["minus"].alias("minus"))
    skipping = F.filter("all", lambda x: x["kind"] > 0)
    groups = groups.select(
        F.sort_array(F.transform(skipping, lambda x: F.struct(x["n"].alias("n"), x["minus"].alias("minus"), x["kind"].alias("kind"))), asc=False).alias("skip"),
        F.get(F.transform(F.filter("all", lambda x: x["kind"] == 0), rank), F.lit(0)).alias("gap"),
    )
    n_skip = F.size("skip")
    firsts = F.filter("skip", lambda x: x["kind"] == 2)
    none = F.lit(None).cast("struct<n:bigint,minus:bigint>")
    gap = F.col("gap")
    of_skipping = F.transform(
        "skip",
        lambda x, i: F.struct(
            (-x["minus"]).alias("id"),
            (n_skip - 1 + F.when((x["kind"] == 2) & gap.isNotNull(), 1).otherwise(0)).cast("long").alias("near"),
            F.greatest(
                F.when(n_skip > 1, rank(F.when(i == 0, F.get("skip", F.lit(1))).otherwise(F.get("skip", F.lit(0))))).otherwise(none),
                F.when(x["kind"] == 2, gap).otherwise(none),
            ).alias("best"),
        ),
    )
    of_gap = F.when(
        gap.isNotNull() & (F.size(firsts) > 0),
        F.array(F.struct((-gap["minus"]).alias("id"), F.size(firsts).cast("long").alias("near"), rank(F.get(firsts, F.lit(0))).alias("best"))),
    ).otherwise(F.array().cast("array<struct<id:bigint,near:bigint,best:struct<n:bigint,minus:bigint>>>"))
    found = groups.select(F.explode(F.concat(of_skipping, of_gap)).alias("x")).select("x.*").where(F.col("near") > 0)
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def follow_forms(words: DataFrame) -> DataFrame:
    """``words`` (``id``, ``word``, ``n``, ``n_near``, ``form_id``) with ``form``, ``form_n`` and ``root``.

    Each level joins the words whose form the level above holds. A form's words are its neighbours, so none is hot.
    """
    spark = words.sparkSession
    text = F.lit(None).cast("string")
    level = words.where(F.col("form_id").isNull()).select(
        "id", "word", "n", "n_near", text.alias("form"), F.lit(None).cast("long").alias("form_n"), F.col("word").alias("root")
    )
    rest = words.where(F.col("form_id").isNotNull())
    levels = []
    while True:
        path = scratch_path(spark, "forms")
        level.write.parquet(path)
        level = spark.read.parquet(path)
        levels.append(path)
        if level.isEmpty():
            return spark.read.parquet(*levels)
        above = level.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"), "root")
        level = rest.join(above, "form_id").select("id", "word", "n", "n_near", "form", "form_n", "root")


def variants(counts: DataFrame, times: int = 2) -> DataFrame:
    """Forms and roots of all words in ``counts`` (``word``, ``n``, each word once, none empty).

    A word's form is its most frequent neighbour if that is at least ``times`` (2 or more) as frequent.
    """
    spark = counts.sparkSession
    paths = {name: scratch_path(spark, name) for name in ("words", "heads", "tails", "near")}
    counts.select("word", "n").write.parquet(paths["words"])
    words = spark.read.parquet(paths["words"]).withColumn("key", F.col("word"))
    walk_trie(words, "heads", "id").write.parquet(paths["heads"])
    forward = spark.read.parquet(paths["heads"])
    backward = forward.select("word", "n", "id", "heads", F.reverse("word").alias("key"))
    walk_trie(backward, "tails", "back").write.parquet(paths["tails"])
    both = spark.read.parquet(paths["tails"])
    pairs = node_pairs(both, borders(forward, "heads", "id"), borders(both, "tails", "back"))
    near = neighbour_counts(pairs)
    enough = F.col("best.n") >= times * F.col("n")
    found = forward.select("id", "word", "n").join(near, "id", "left")
    found = found.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, -F.col("best.minus")).alias("form_id")
    )
    found.write.parquet(paths["near"])
    return follow_forms(spark.read.parquet(paths["near"])).drop("id")


def variant_words(docs: DataFrame) -> DataFrame:
    return variants(count_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")
