"""Near-duplicates by circulant MinHash.

1. One pass makes each document's set of word shingles and its signature. Two permutations
   serve for all coordinates: the first places shingle hashes in a ring of ``RING`` slots, the
   second is a random table over the ring; coordinate k is the shingle whose slot has the least value in the table, shifted by k.
   So a shingle's values are ``COORDINATES`` neighbours in the table. Of shingles in one slot the one with
   the least hash stands for it, so sets that fill the ring still differ.
2. Rows with equal sets form a class with the smallest ``doc_id`` as representative; only
   representatives go on. Banding gives buckets of representatives.
3. Each bucket's members are compared with its smallest one: full sets, exact Jaccard. Links give
   components (alternating stars, by joins).
4. Buckets whose other members are still in several components are compared throughout, by blocks
   of ``BLOCK`` members against each other; tasks return only the links that join components. So no
   link between members of a bucket is lost, and no bucket is one task or a list of all pairs.

Hot keys: a class, bucket or hub with more than a ``SHARE``-th of a table's rows (there are fewer than ``SHARE`` of them)
is looked up by a broadcast of that bounded list, all others by a join on the key; and the pairs of such a pivot are dealt to
several groups, each with one copy of its text.

At a similarity of 0.85 a pair shares no bucket with probability (1 - 0.85^7)^34 = 2e-6.

Definitions: A-Z in lower case; words are ``[^\\x20\\x09-\\x0D]+``; a set holds the different shingles of
``WIDTH`` words, or the whole sequence if it is shorter. Texts without words, and null texts, have an empty
set and no links; so have rows with a null ``doc_id``, whose ``component_id`` is null and which are kept.
``doc_id`` should be unique: rows that repeat it are judged each by its text but share the id's place
in the graph, and all stay if it is the component's smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_in_arrow
from skyledger.llm.tokens import Memo, runs
from skyledger.session import scratch_path, ship_package

WIDTH, SIMILARITY = 5, 85  # similarity in hundredths
BANDS, ROWS = 34, 7
COORDINATES = BANDS * ROWS
RING = 1 << 20
BLOCK = 256
SHARE = 1000
SEED = 5

_ODD = np.uint64(0x9E3779B97F4A7C15)
_memo = Memo(xxhash.xxh3_64_intdigest)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles; null counts as empty."""
    # Lower-casing and splitting bytes touch ASCII letters and white space only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    if not len(words):
        return hashes
    n = max(1, len(words) - width + 1)
    total = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        total = mixed(total * _ODD + hashes[k : k + n])
    return np.unique(total)


_tables: list[np.ndarray] = []


def ring_rows() -> tuple[np.ndarray, np.ndarray]:
    """Row s: the table's values at the slots s, s + 1, ... for all coordinates; and the slot of each value."""
    if not _tables:
        table = np.random.default_rng(SEED).permutation(RING).astype(np.int32)
        _tables.append(np.lib.stride_tricks.sliding_window_view(np.r_[table, table[:COORDINATES]], COORDINATES))
        _tables.append(np.argsort(table).astype(np.int64))
    return _tables[0], _tables[1]


def signature(found: np.ndarray) -> np.ndarray:
    """For each coordinate the hash of the shingle that comes first in its order."""
    slot = ((found * _ODD) >> np.uint64(64 - RING.bit_length() + 1)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    slots, first = slot[starts], np.minimum.reduceat(mixed(found[order] + _ODD), starts)
    (rows, place), least = ring_rows(), None
    for at in range(0, len(slots), 1024):
        low = rows[slots[at : at + 1024]].min(axis=0)
        least = low if least is None else np.minimum(least, low)
    chosen = (place[least] - np.arange(COORDINATES)) % RING
    return first[np.searchsorted(slots, chosen)]


def band_hashes(sign: np.ndarray) -> np.ndarray:
    parts = sign.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        total = mixed(total * _ODD + parts[:, k])
    return total.view(np.int64)


SIGNED = "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>"


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in runs(batch, 8_000_000):
                n, c1, c2, bands = [], [], [], []
                for text in texts:
                    found = shingles(text, width)
                    n.append(len(found))
                    c1.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                    c2.append(int(np.bitwise_xor.reduce(mixed(found)).view(np.int64)) if len(found) else 0)
                    bands.append(band_hashes(signature(found)) if len(found) else [])
                ids = batch.column("doc_id").slice(first, len(texts))
                columns = [pa.array(x, pa.int64()) for x in (n, c1, c2)]
                yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "c1", "c2", "bands"])

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, SIGNED)


def some_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` for the ``ids`` only; of repeated ids all texts.

    Texts travel instead of their sets: hashes don't compress, and texts of near-duplicates do.
    The ids grow with the corpus, so they are never broadcast.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id", "left_semi")


def alike(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether 100 * intersection >= similarity * union, for sorted arrays without repetitions."""
    if not len(a) or 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= similarity * (len(a) + len(b) - shared)


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns that ``found`` has for their key; ``found`` has each key once, with ``n``, its number of ``rows``.

    Keys with more than a ``SHARE``-th of ``total`` rows are fewer than ``SHARE``, and are broadcast; the rest is joined on the key.
    ``n`` is not kept.
    """
    limit = max(1, total // SHARE)
    hot = F.broadcast(found.where(F.col("n") > limit).drop("n"))
    rest = found.where(F.col("n") <= limit).drop("n")
    few = hot.select(*keys)
    return rows.join(hot, keys, "inner").unionByName(rows.join(F.broadcast(few), keys, "left_anti").join(rest, keys, how))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are links by their full sets.

    The texts of ``b`` travel to groups of one ``a`` and a share of its pairs, where one copy of ``a``'s text comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot: int | None = None
        held: list[np.ndarray] = []  # an id that several rows share has several texts
        for batch in batches:
            right = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text")), strict=True):
                if b is None:
                    held = [*held, shingles(text, width)] if a == pivot else [shingles(text, width)]
                    pivot = a
                    right.append(False)
                else:
                    own = shingles(text, width)
                    right.append(any(alike(x, own, similarity) for x in held))
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield rows.filter(pa.array(right, pa.bool_()))

    pairs = stored(pairs, "pairs")
    total = pairs.count()
    share = max(1, total // SHARE)
    # A hot pivot's pairs go to several groups, as many as it has shares; there are fewer than ``SHARE`` such pivots.
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share).select("a", F.ceil(F.col("n") / share).alias("groups"))
    group = F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1).cast("bigint")))
    dealt = stored(pairs.join(F.broadcast(hot), "a", "left").select("a", "b", group.alias("part")), "dealt")
    other = dealt.join(texts.select(F.col("doc_id").alias("b"), "text"), "b").select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct().join(texts.select(F.col("doc_id").alias("a"), "text"), "a")
    met = heads.select("a", "part", F.lit(None).cast("bigint").alias("b"), "text").unionByName(other)
    sorted_ = met.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return map_in_arrow(sorted_.select("a", "b", "text"), run, "a bigint, b bigint")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``links`` (``a``, ``b``), by alternating stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
    before = mark(edges)
    while before.n:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub of very many neighbours is one key: ``n`` tells it apart.
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "v").alias("m"), "n")
        large = looked_up(both.where("v > u"), least, ["u"], before.n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = looked_up(large, low, ["u"], before.n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u > v").distinct(), "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(nodes.select(F.col("component").alias("node"), "component").distinct())


def buckets(signed: DataFrame) -> DataFrame:
    """``bucket``, ``pivot`` (smallest member) and ``member`` of the buckets with several members; of equal buckets only one."""
    rows = signed.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("member"))
    total = BANDS * signed.count()
    # Most buckets have one member, so this aggregate carries as little as it can.
    several = stored(
        rows.groupBy("bucket").agg(F.min("member").alias("pivot"), F.max("member").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("pivot") < F.col("last")).select("bucket", "pivot", "n"), "several",
    )
    return different(stored(looked_up(rows, several, ["bucket"], total).select("bucket", "pivot", "member"), "buckets"))


def different(members: DataFrame) -> DataFrame:
    """``members`` (``bucket``, ``member`` and more, stored) without buckets that hold the same members as another."""
    # Sums of hashes tell the member lists of buckets apart.
    lists = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(F.xxhash64("member"), 20)).alias("s1"),
        F.bit_xor(F.xxhash64(F.lit(1), "member")).alias("s2"),
    )
    one = stored(lists.groupBy("n", "s1", "s2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "different")
    return looked_up(members, one, ["bucket"], members.count())


def cross_links(members: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Links between members of different components in one bucket (``bucket``, ``member``, ``component``).

    A bucket's members are dealt into blocks; each pair of blocks is a group of at most about
    2 * ``BLOCK`` rows. A group returns links until its members' components are joined.
    """
    sized = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    dealt = looked_up(members, sized, ["bucket"], members.count()).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    paired = dealt.select("bucket", "member", "component", "block", F.explode(others).alias("other"))
    grouped = paired.select(
        "bucket", "member", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    ).join(texts.select(F.col("doc_id").alias("member"), "text"), "member")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [shingles(text, width) for text in pdf["text"]]
        member, block, i, j = pdf["member"].tolist(), pdf["block"].to_numpy(), pdf["i"].iloc[0], pdf["j"].iloc[0]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        component = pdf["component"].tolist()
        found = []
        for x in range(len(held)):
            for y in range(x) if i == j else np.flatnonzero(block[:x] != block[x]):
                a, b = root(component[x]), root(component[y])
                if a != b and alike(held[x], held[y], similarity):
                    above[a] = b
                    found.append((member[x], member[y]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    ship_package(members.sparkSession)
    return grouped.groupBy("bucket", "i", "j").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id``, ``n_shingles``, ``class_id``, ``component_id``, ``kept``."""
    signed = stored(signatures(docs, width), "signed")
    linked = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key, total = ["n_shingles", "c1", "c2"], linked.count()
    classes = stored(linked.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    classed = stored(looked_up(linked, classes, key, total).select("doc_id", "n_shingles", "class_id", "bands"), "classed")
    members = stored(buckets(classed.where("doc_id = class_id").select("doc_id", "bands").distinct()), "members")
    texts = stored(some_texts(docs, members.select(F.col("member").alias("doc_id")).distinct()), "texts")
    stars = members.where("member > pivot").select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct()
    links = stored(confirmed(stars, texts, width, similarity), "links")
    found = components(links)

    # The pivots' pairs are done; the others of a bucket may still be in several components.
    others = stored(
        members.where("member > pivot").join(found.withColumnRenamed("node", "member"), "member", "left").select(
            "bucket", "member", F.coalesce("component", "member").alias("component")
        ), "others",
    )
    spans = others.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    open_ = stored(spans.where("x < y").select("bucket", "n"), "open")
    left = different(stored(looked_up(others, open_, ["bucket"], others.count()), "left"))
    more = stored(cross_links(left, texts, width, similarity), "links")
    if more.take(1):
        found = components(links.unionAll(more))

    sizes = classes.groupBy("class_id").agg(F.sum("n").alias("n"))
    reached = sizes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", F.coalesce("component", "class_id").alias("component_id"), "n"
    )
    placed = looked_up(classed, stored(reached, "reached"), ["class_id"], total).select("doc_id", "n_shingles", "class_id", "component_id")
    alone = signed.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0)).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")
    )
    return placed.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dup_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def without_near_duplicates(docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with all columns, one document of each component: the one with the smallest id."""
    gone = near_duplicates(docs, width, similarity).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
