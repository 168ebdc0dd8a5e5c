"""Lines that occur in several documents stay only in the first: DataFrame functions only.

Line keys become 128-bit hashes. They are uniform, so their upper bits are the range and no sample is taken.
Partitions of (range, part of the documents), sorted by hash, document and position, stream the first occurrence of each hash; parts
split a hash that a third of all lines share. The first occurrences of the parts meet in an aggregate, and each
document gets a compressed bitmap of the lines to keep. So lines travel as hashes; whole texts travel once, to meet their bitmaps.

Definitions: a text is split at ``\\n``; a null or empty text is one empty line. A key is the line
without white space ``[\\x20\\x09-\\x0D]`` at its ends and with A-Z in lower case. Keys of fewer than
``least`` code points always stay. All rows of one ``doc_id`` count as one document; a row whose
``doc_id`` is null keeps all lines and takes none from others. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from skyledger.llm.common import ascii_lower, attach, keyed_texts, let

LEAST = 10
_SPACE = " \t\n\x0b\f\r"
_WORD = 64  # lines to a bitmap word
_RANGE_BITS = 16


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def line_hashes(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """A row for each line that may be a repetition: where it is, its hash and the part of its document."""
    lines = texts.where(F.col("doc_id").isNotNull()).select(
        "doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    keys = lines.select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select(
        "doc_id", "row_key", "pos",
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part"),
    )


def drop_bitmaps(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """``keep`` for documents that lose lines: bitmap words with a dropped line, as word number and bits.

    A word that isn't listed keeps all its lines.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = line_hashes(texts, least, n).withColumn("range", F.shiftrightunsigned("h1", 64 - _RANGE_BITS).cast("int"))
    ranged = hashes.repartition(n, "range", "part")
    stream = Window.partitionBy("range", "part", "h1", "h2").orderBy("doc_id", "pos")
    firsts = F.first("doc_id").over(stream)
    ranged = ranged.withColumn("part_first", firsts)
    # Lines behind the first document of their part go in any case.
    behind = ranged.where(F.col("doc_id") > F.col("part_first")).select("doc_id", "row_key", "pos")
    # Those of a part's first document go if another part has an earlier one.
    leading = ranged.where(F.col("doc_id") == F.col("part_first"))
    heads = (
        # The whole place, not only its document, so that both branches read one exchange.
        leading.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "row_key", "pos")).alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("first.doc_id") < F.col("last")).select("h1", "h2", F.col("first.doc_id").alias("first"))
    )
    beaten = leading.join(heads, ["h1", "h2"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "row_key", "pos")
    words = (
        behind.unionAll(beaten)
        .groupBy("doc_id", "row_key", F.floor(F.col("pos") / _WORD).cast("int").alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {_WORD})")).alias("gone"))
    )
    return words.groupBy("doc_id", "row_key").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep")
    )


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines whose bit is set; a null bitmap keeps all."""
    by_word = F.map_from_entries(keep)
    all_words = F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / _WORD).cast("int"))
    dense = F.transform(all_words, lambda w: F.coalesce(F.element_at(by_word, w), F.lit(-1).cast("long")))
    some = let(
        dense,
        lambda bits: F.filter(
            lines, lambda _, i: F.getbit(bits[F.floor(i / _WORD).cast("int")], (i % _WORD).cast("int")) == 1
        ),
    )
    return F.when(keep.isNull(), lines).otherwise(some)


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``doc_id``, ``keep``, the kept ``text``, and the numbers of lines and of dropped lines, for each row."""
    texts = keyed_texts(docs)
    maps = drop_bitmaps(texts, least)
    lines = F.split("text", "\n")
    joined = attach(texts, maps)
    n_dropped = F.coalesce(
        F.aggregate("keep", F.lit(0).cast("long"), lambda n, w: n + _WORD - F.bit_count(w["bits"])), F.lit(0).cast("long")
    )
    return joined.select(
        "doc_id", "keep",
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        n_dropped.alias("n_dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with all columns; ``text`` has the kept lines only, ``n_chars`` (if there) its code points.

    A null text stays null.
    """
    text = F.coalesce("row.text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.xxhash64(text).alias("row_key"))
    lines = F.split(text, "\n")
    joined = attach(rows, drop_bitmaps(keyed_texts(docs), least))
    kept = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(F.array_join(kept_lines(lines, F.col("keep")), "\n"))
    joined = joined.select("row", kept.alias("kept"))
    new = {"text": F.col("kept")} | ({"n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
