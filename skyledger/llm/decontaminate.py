"""Benchmark passages in documents by a positional inverted index: DataFrame functions only.

1. Over all documents, the words that benchmark items hold are counted.
2. Each window of ``WINDOW`` item words is asked for by its rarest terms (``TERMS`` of them). A window that several items hold is
   asked for once, through the smallest of them, and its ``twins`` are told apart at the end.
3. The index stores the postings (term, document, position) of the terms asked for. Documents
   are its shards: a term that every document holds makes no hot key.
4. Posting lists are shifted by the term's offset in the item and intersected: where all
   terms of a window agree on one shift, the window may occur.
5. Such places are compared word by word with the document: exact phrases. ``proximity``
   instead returns places where the terms lie near each other. It chooses the terms itself: the ``NEAR_TERMS`` rarest
   of those words of a window that some document holds, of which all but one have to agree. So two of the three rarest
   have to, or the one there is: only documents and items where they do are looked up by all terms.

Definitions: words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. An item of fewer
words than a window, but not none, is one window. A null text has no words. Items are told
apart by ``item_id`` (null: the empty string) and text; rows of one ``item_id`` count as one item.
Repeated documents give repeated results. An empty benchmark, or one without words, hits nothing; an empty table gives no rows.
Texts of any length are taken whole. ``proximity`` follows the same definitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from skyledger.llm.common import ascii_lower, attach, keyed_texts, let, row_texts, stored
from skyledger.session import scratch_path

WINDOW, TERMS = 13, 3
NEAR_TERMS, SLOP = 6, 8
RAREST = 3
#: A table of benchmark terms is broadcast up to so many rows (some 100 MB), else joined by a shuffle.
MOST_BROADCAST = 1_000_000
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    parts = F.split(ascii_lower(text), _BETWEEN, -1)
    return F.filter(parts, lambda w: w != "")


def bounded(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= MOST_BROADCAST else small


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item``, ``item_key`` and ``item_words`` of each different item with words."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    made = benchmark.select(item.alias("item"), F.xxhash64(text).alias("item_key"), words_of(text).alias("item_words"))
    return made.where(F.size("item_words") > 0).dropDuplicates(["item", "item_key"])


def corpus_counts(texts: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    tokens = texts.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(bounded(terms, n_terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def twins_of(items: DataFrame, window: int) -> DataFrame:
    """Each different window as its first holder (``item``, ``item_key``, ``start``), with all its holders (``twins``)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("item_words") - window, F.lit(0)))
    each = items.select("item", "item_key", "item_words", F.explode(starts).alias("start"))
    held = each.select(F.struct("item", "item_key", "start").alias("place"), F.slice("item_words", F.col("start") + 1, F.lit(window)).alias("words"))
    return held.groupBy("words").agg(F.min("place").alias("first"), F.collect_set(F.struct("place.item", "place.start")).alias("twins")).select(
        "first.*", "twins"
    )


def windows_of(items: DataFrame, counts: DataFrame, firsts: DataFrame, window: int, terms: int, whole: bool = True) -> DataFrame:
    """Each different window (``firsts``) as its start and its rarest places, most telling first; without those that can't occur.

    If not ``whole``, only the words that no document holds are left out, not their windows.
    """
    placed = items.select("item", "item_key", F.size("item_words").alias("size"), F.posexplode("item_words").alias("place", "term"))
    counted = placed.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = F.sequence(F.greatest(F.col("place") - (window - 1), F.lit(0)), F.greatest(F.least("place", F.col("size") - window), F.lit(0)))
    each = counted.select("item", "item_key", "term", "place", "n", F.explode(starts).alias("start"))
    each = each.join(firsts.select("item", "item_key", "start"), ["item", "item_key", "start"], "left_semi")
    rarest = Window.partitionBy("item", "item_key", "start").orderBy("n", "place")
    least = F.min("n").over(Window.partitionBy("item", "item_key", "start"))
    ranked = each.withColumn("least", least if whole else F.col("n")).where("least > 0")
    return ranked.withColumn("rank", F.row_number().over(rarest)).where(F.col("rank") <= terms).select(
        "item", "item_key", "start", "term", "place", "rank"
    )


def postings(texts: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(term, document, position) of the given terms in all documents."""
    tokens = texts.select("doc_id", "row_key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return tokens.join(bounded(terms, n_terms), "term").select("term", "doc_id", "row_key", "pos")


def build_index(texts: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """The postings of the terms asked for, stored in the shared folder, sorted by term within files."""
    spark = texts.sparkSession
    path = scratch_path(spark, "postings")
    terms = asked.select("term").distinct()
    postings(texts, terms, n_asked).sortWithinPartitions("term", "doc_id", "pos").write.parquet(path)
    return spark.read.parquet(path)


def aligned(index: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """For each document, item and shift: the item places whose term stands there in the document."""
    places = asked.select("item", "item_key", "term", "place").distinct()
    shifted = index.join(bounded(places, n_asked), "term").select(
        "doc_id", "row_key", "item", "item_key", (F.col("pos") - F.col("place")).alias("shift"), "place"
    )
    return shifted.groupBy("doc_id", "row_key", "item", "item_key", "shift").agg(F.collect_set("place").alias("places"))


def item_windows(items: DataFrame, asked: DataFrame, firsts: DataFrame) -> DataFrame:
    """Each item with its words and an array of the windows asked through it: start, places asked for, holders."""
    grouped = asked.groupBy("item", "item_key", "start").agg(F.collect_set("place").alias("need"))
    held = grouped.join(firsts, ["item", "item_key", "start"]).withColumn("twins", F.array_distinct("twins.item"))
    arrays = held.groupBy("item", "item_key").agg(F.collect_list(F.struct("start", "need", "twins")).alias("windows"))
    return items.join(arrays, ["item", "item_key"])


def phrase_candidates(found: DataFrame, windows: DataFrame, n_items: int) -> DataFrame:
    """Per document, the items and shifts at which all asked places of some window agree."""
    joined = found.join(bounded(windows, n_items), ["item", "item_key"])
    met = F.filter("windows", lambda w: F.size(F.array_except(w["need"], F.col("places"))) == 0)
    return (
        joined.select("doc_id", "row_key", "shift", "item_words", F.transform(met, lambda w: F.struct(w["start"], w["twins"])).alias("starts"))
        .where(F.size("starts") > 0)
        .groupBy("doc_id", "row_key")
        .agg(F.collect_list(F.struct("shift", "item_words", "starts")).alias("places"))
    )


def exact_phrases(words: Column, places: Column, window: int) -> Column:
    """The document positions of each candidate that hold a whole window, as ``hit``, and the windows' ``items``."""

    def verified(p: Column) -> Column:
        length = F.least(F.lit(window), F.size(p["item_words"]))
        right = F.filter(
            p["starts"],
            lambda s: (p["shift"] + s["start"] >= 0)
            & (F.slice(words, F.greatest(p["shift"] + s["start"] + 1, F.lit(1)), length) == F.slice(p["item_words"], s["start"] + 1, length)),
        )
        hit = F.transform(right, lambda s: F.sequence(p["shift"] + s["start"], p["shift"] + s["start"] + length - 1))
        held = F.flatten(F.transform(right, lambda s: s["twins"]))
        return F.struct(F.array_distinct(held).alias("items"), F.array_distinct(F.flatten(hit)).alias("hit"))

    return F.filter(F.transform(places, verified), lambda p: F.size(p["hit"]) > 0)


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, terms: int = TERMS) -> DataFrame:
    """For each row: ``doc_id``, ``n_words``, ``hit`` (positions of hit words) and ``items``, with the text's row key.

    Words are counted where the texts are read; only the texts of candidates travel.
    """
    texts = keyed_texts(docs)
    items = items_of(benchmark)
    vocabulary = items.select(F.explode("item_words").alias("term")).distinct()
    n_terms = vocabulary.count()
    firsts = stored(twins_of(items, window), "twins")
    asked = stored(windows_of(items, corpus_counts(texts, vocabulary, n_terms), firsts, window, terms), "asked")
    n_asked = asked.count()
    index = build_index(texts, asked, n_asked)
    found = aligned(index, asked, n_asked)
    places = stored(phrase_candidates(found, item_windows(items, asked, firsts), n_asked), "candidates")
    held = row_texts(texts, places).select("doc_id", "row_key", words_of(F.col("text")).alias("words"), "places")
    phrases = held.select("doc_id", "row_key", let(F.col("words"), lambda w: exact_phrases(w, F.col("places"), window)).alias("phrases"))
    hits = phrases.select(
        "doc_id", "row_key",
        F.array_distinct(F.flatten(F.transform("phrases", lambda p: p["hit"]))).alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("phrases", lambda p: p["items"])))).alias("items"),
    )
    hits = hits.where(F.size("hit") > 0).dropDuplicates(["doc_id", "row_key"])  # equal rows have equal hits
    counted = texts.select("doc_id", "row_key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return attach(counted, hits).select(
        "doc_id", "row_key", "n_words", F.coalesce("hit", none("int")).alias("hit"), F.coalesce("items", none("string")).alias("items")
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """Some word is hit, and at least one word in twenty."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    n_hit = F.size("hit").cast("long")
    return contaminated_words(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with all columns, without contaminated rows."""
    judged = contaminated_words(docs, benchmark)
    bad = (
        judged.where(contaminated(F.size("hit").cast("long"), F.col("n_words")))
        .select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    )
    rows = docs.select(F.struct("*").alias("row")).withColumn("row_key", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    same = F.col("row.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("row_key") == F.col("bad_key"))
    kept = rows.join(bad, same, "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_windows(items: DataFrame, asked: DataFrame, window: int, terms: int) -> DataFrame:
    """Per item, its windows with their places asked for and the number of them that must agree; only windows with enough."""
    size = F.least(F.size("item_words"), F.lit(window), F.lit(terms))
    enough = items.select("item", "item_key", F.when(size >= 4, size - 1).otherwise(size).alias("enough"))
    grouped = asked.groupBy("item", "item_key", "start").agg(F.collect_set("place").alias("need"))
    able = grouped.join(enough, ["item", "item_key"]).where(F.size("need") >= F.col("enough"))
    return able.groupBy("item", "item_key", "enough").agg(F.collect_list(F.struct("start", "need")).alias("windows"))


def near_places(docs: DataFrame, benchmark: DataFrame, slop: int, window: int, terms: int) -> DataFrame:
    """``doc_id``, ``row_key``, ``item``, ``start`` and ``pos`` of the places that ``proximity`` describes."""
    texts = keyed_texts(docs)
    items = items_of(benchmark)
    vocabulary = items.select(F.explode("item_words").alias("term")).distinct()
    n_terms = vocabulary.count()
    firsts = stored(twins_of(items, window), "twins")
    asked = stored(windows_of(items, corpus_counts(texts, vocabulary, n_terms), firsts, window, terms, whole=False), "asked_near")
    n_asked = asked.count()
    windows = near_windows(items, asked, window, terms)
    able = windows.select("item", "item_key", "enough")
    places = asked.join(able, ["item", "item_key"]).groupBy("item", "item_key", "enough", "term", "place").agg(F.min("rank").alias("rank"))
    places = stored(places, "places")
    # All shifts within ``slop`` of each other share one of two overlapping cells.
    cell = F.floor(F.col("shift") / (slop + 1))
    key = ["doc_id", "row_key", "item", "item_key"]
    rare = places.where(F.col("rank") <= RAREST)
    index = build_index(texts, rare, n_asked)
    shifted = index.join(bounded(rare, n_asked), "term").withColumn("shift", F.col("pos") - F.col("place"))
    cells = shifted.select(*key, "enough", "place", F.explode(F.array(cell, cell + 1)).alias("cell"))
    # Two different places are a least and a greatest one.
    agree = (F.min("place") < F.max("place")) | (F.max("enough") == 1)
    likely = cells.groupBy(*key, "cell").agg(agree.alias("agree")).where("agree")
    # Each document's list of items and cells, as hashes: what a collision lets in is judged like the rest.
    code = F.xxhash64("item", "item_key", "cell")
    listed = stored(likely.groupBy("doc_id", "row_key").agg(F.collect_set(code).alias("likely")), "likely")
    # Now all terms, in those documents and items only; nothing else is shuffled.
    few = row_texts(texts, listed)
    tokens = few.select("doc_id", "row_key", "likely", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    near = tokens.join(bounded(places, n_asked), "term").withColumn("shift", F.col("pos") - F.col("place"))
    hits = near.select(*key, "likely", "enough", "shift", "place", F.explode(F.array(cell, cell + 1)).alias("cell"))
    hits = hits.where(F.array_contains("likely", code))
    grouped = hits.groupBy(*key, "enough", "cell").agg(F.collect_set(F.struct("shift", "place")).alias("hits"))
    grouped = grouped.where(F.size(F.array_distinct("hits.place")) >= F.col("enough"))

    def met(hits: Column, w: Column) -> Column:
        """The window's start and its place by the leftmost term, null where too few terms agree."""

        def near(own: Column, s: Column) -> Column:
            return F.filter(own, lambda h: (h["shift"] >= s["shift"]) & (h["shift"] <= s["shift"] + slop))

        def first(own: Column) -> Column:
            right = F.filter(own, lambda s: F.size(F.array_distinct(near(own, s)["place"])) >= F.col("enough"))
            return F.transform(F.slice(right, 1, 1), lambda s: F.array_min(F.transform(near(own, s), lambda h: h["shift"] + h["place"])))

        own = F.array_sort(F.filter(hits, lambda h: F.array_contains(w["need"], h["place"])))
        return F.struct(w["start"].alias("start"), let(own, first).alias("pos"))

    joined = grouped.join(bounded(windows.drop("enough"), n_asked), ["item", "item_key"])
    found = F.filter(F.transform("windows", lambda w: met(F.col("hits"), w)), lambda m: F.size(m["pos"]) > 0)
    each = joined.select("doc_id", "row_key", "item", "item_key", F.explode(found).alias("m"))
    told = each.select("doc_id", "row_key", "item", "item_key", F.col("m.start").alias("start"), F.col("m.pos")[0].alias("pos")).distinct()
    holders = told.join(bounded(firsts, n_asked), ["item", "item_key", "start"]).select("doc_id", "row_key", "pos", F.explode("twins").alias("t"))
    return holders.select("doc_id", "row_key", F.col("t.item").alias("item"), F.col("t.start").alias("start"), "pos").distinct()


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, window: int = WINDOW, terms: int = NEAR_TERMS) -> DataFrame:
    """Places where the asked terms of a window stand at their distances in the item, give or take ``slop`` words.

    Returns ``doc_id``, ``item``, ``start`` (the window in the item) and ``pos`` (its place by the
    leftmost term). Of four or more terms one may be missing; words between or in place of the others may differ.
    """
    return near_places(docs, benchmark, slop, window, terms).select("doc_id", "item", "start", "pos").distinct()


def proximity_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: the number of items with a proximity match, and the items."""
    found = near_places(docs, benchmark, SLOP, WINDOW, NEAR_TERMS)
    listed = found.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("item")).alias("near_items"))
    joined = attach(keyed_texts(docs), listed)
    items = F.coalesce("near_items", F.array().cast("array<string>"))
    return joined.select("doc_id", F.size(items).cast("long").alias("n_near_items"), F.array_join(items, ",").alias("near_items"))
