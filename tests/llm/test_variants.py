"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import corpus
import pytest

from skyledger.llm import variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    """Counts of the words of (doc_id, text), by the contract."""
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(corpus.LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(one, two):
    if len(one) == len(two):
        return sum(a != b for a, b in zip(one, two)) == 1
    if len(one) > len(two):
        one, two = two, one
    return len(two) == len(one) + 1 and any(two[:i] + two[i + 1 :] == one for i in range(len(two)))


def grouped(counts):
    """The contract's rows for words and counts."""
    rows, forms = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if w != word and near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        rows[word], forms[word] = (form, n, len(others), counts.get(form)), form
    out = []
    for word, (form, n, n_near, form_n) in rows.items():
        root = word
        while forms[root]:
            root = forms[root]
        out.append((word, form, root, n, n_near, form_n))
    return corpus.bag(out)


def check_words(spark, counts):
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert corpus.bag(variants.variants(frame).select(COLUMNS).collect()) == grouped(counts)


def check_docs(spark, rows):
    docs = corpus.frame(spark, [t for _, t in rows], [i for i, _ in rows])
    assert corpus.bag(variants.variant_words(docs).collect()) == grouped(counted(rows))


def test_words_equal_all_pairs(spark):
    draw = random.Random(11)
    words = {"".join(draw.choice("aabéz") for _ in range(draw.randrange(1, 7))) for _ in range(700)}
    check_words(spark, {w: draw.choice([1, 1, 2, 3, 4, 8, 16, 40]) for w in sorted(words)})


def test_ties_equal_letters_and_chains(spark):
    check_words(spark, {"hello": 4, "helo": 4, "helllo": 2, "hallo": 8, "hullo": 8, "hollo": 1, "hell": 16, "ell": 32, "é": 9, "è": 9, "e": 9})
    check_words(spark, {"a" * n: 2**n for n in range(1, 12)})


def test_one_hot_word_with_every_neighbour(spark):
    letters = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    hot = "streets"
    counts = {hot[:i] + c + hot[j:]: 3 for c in letters for i in range(len(hot) + 1) for j in (i, i + 1)}
    check_words(spark, counts | {hot: 1_000_000_000})


def test_one_word_and_long_words(spark):
    long = "xy" * 20_000
    check_words(spark, {"alone": 3})
    check_words(spark, {long: 3, long[1:]: 6, long[:-1]: 12, long + "z": 5, "z" + long[:-1] + "é": 1})


@pytest.mark.parametrize("ids", [None, "equal"])
def test_documents_equal_brute_force(spark, ids):
    draw = random.Random(4)
    words = ["Street", "street", "streets", "strEat", "Über", "überall", "Überall", "cat", "mother", "Mother", "mothers", "ſtreet", "straße", "İstanbul", "plain÷word"]
    texts = [None, "", "...", *("".join(draw.choice(words) + draw.choice(" \n-1'") for _ in range(draw.randrange(60))) for _ in range(300))]
    texts.append("street " * 5_000 + "a" * 3_000)
    rows = list(enumerate(texts)) if ids is None else [(draw.choice([None, -7, 5]), t) for t in texts * 2]
    check_docs(spark, rows)


def test_damage_to_short_and_shortest_words(spark):
    hit = [i for i in range(3_000) if zlib.crc32(f"{i}:abcdef".encode()) % 97 == 0]
    assert hit
    check_docs(spark, [(i, "abcdef abcde bcdef") for i in hit * 2])


def test_empty_tables(spark):
    assert variants.variant_words(corpus.frame(spark, ["x"]).limit(0)).collect() == []
    assert variants.variant_words(corpus.frame(spark, [None, "", "1 2"])).collect() == []


def test_borders_of_partitions_share_nodes(spark):
    words = sorted({f"prefix{a}{b}" for a in "abcdefgh" for b in "abcdefgh"})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint").withColumnRenamed("word", "key")
    path = variants.scratch_path(spark, "walk")
    variants.walk_trie(frame, "heads", "id").write.parquet(path)
    walked = spark.read.parquet(path)
    same = dict(zip(*(x.tolist() for x in variants.borders(walked, "heads", "id"))))
    node_of = {}
    for row in walked.collect():
        for depth, node in enumerate(row.heads):
            node_of.setdefault(row.key[:depth], set()).add(same.get(node, node))
    assert all(len(nodes) == 1 for nodes in node_of.values())
    assert len({node for nodes in node_of.values() for node in nodes}) == len(node_of)
    assert len({id_ >> 40 for (id_,) in walked.select("id").collect()}) > 1
