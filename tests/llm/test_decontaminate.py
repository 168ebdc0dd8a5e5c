import random

import corpus
import pytest

from skyledger.llm import decontaminate

ITEM = "item_id bigint, text string, term string, pos int"


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], ITEM)


@pytest.fixture(scope="module")
def made():
    draw = random.Random(6)
    vocabulary = ["the", "of", "and", "Ünder", "naïve", *[f"w{i}" for i in range(40)]]
    passage = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, passage(draw.choice([1, 2, 5, 12, 13, 14, 30]))) for i in range(25)]
    items += [(3, "another text of item three with the of and " + passage(14)), (90, None), (91, ""), (92, "?!"), (None, passage(15)), (0, items[0][1])]
    texts: list[str | None] = [None, "", "!", "one"]
    for _ in range(150):
        body = [passage(draw.randrange(40)) for _ in range(3)]
        for _, text in draw.sample(items, 2):
            w = (text or "").split()
            at = draw.randrange(3)
            body.insert(at, " ,".join(w[draw.randrange(3) :]).upper() if draw.random() < 0.5 else "\n".join(w))
        texts.append("; ".join(body))
    return list(zip([None, *range(len(texts) - 2), 7], texts, strict=True)), items


def test_equals_brute_force(spark, made):
    rows, items = made
    docs = corpus.frame(spark, [t for _, t in rows], [i for i, _ in rows])
    want = corpus.contamination(rows, items)
    got = decontaminate.contamination_digest(docs, items_frame(spark, items)).collect()
    assert corpus.bag(got) == corpus.bag((i, n, h, len(x), corpus.sha(",".join(x)), c) for i, n, h, x, c in want)
    assert any(c for *_, c in want) and any(h and not c for _, _, h, _, c in want)
    kept = decontaminate.without_contaminated(docs, items_frame(spark, items))
    assert kept.columns == docs.columns
    assert corpus.bag((r.doc_id, r.text) for r in kept.collect()) == corpus.bag(row for row, w in zip(rows, want, strict=True) if not w[4])


def test_shuffled_joins_give_the_same(spark, made, monkeypatch):
    rows, items = made
    docs = corpus.frame(spark, [t for _, t in rows[:60]], [i for i, _ in rows[:60]])
    bench = items_frame(spark, items)
    first = corpus.bag(decontaminate.contamination_digest(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert corpus.bag(decontaminate.contamination_digest(docs, bench).collect()) == first


def test_repeated_words_and_overlaps(spark):
    items = [(1, "a a a a"), (2, "b " * 30)]
    rows = [(1, "a a a"), (2, "a a a a a x a a a a"), (3, "b " * 12), (4, "B! " * 50 + "c " * 700)]
    docs = corpus.frame(spark, [t for _, t in rows], [i for i, _ in rows])
    got = decontaminate.contamination_digest(docs, items_frame(spark, items)).collect()
    want = corpus.contamination(rows, items)
    assert corpus.bag((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == corpus.bag((i, n, h, c) for i, n, h, _, c in want)


def test_empty_tables(spark, made):
    rows, items = made
    docs, bench = corpus.frame(spark, ["some text", None]), items_frame(spark, items)
    assert decontaminate.contamination_digest(docs.limit(0), bench).collect() == []
    none = decontaminate.contamination_digest(docs, bench.limit(0)).collect()
    assert sorted((r.n_words, r.n_hit, r.contaminated) for r in none) == [(0, 0, False), (2, 0, False)]


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    near = item.replace("gamma", "very gamma").replace("eta theta", "eta so theta")
    far = item.replace("gamma", "x " * 40 + "gamma").replace("iota", "y " * 40 + "iota").replace("mu", "z " * 40 + "mu").replace("beta", "v " * 40 + "beta")
    docs = corpus.frame(spark, [near, far, item, "unrelated words"])
    found = decontaminate.proximity(docs, items_frame(spark, [(5, item)]))
    assert {r.doc_id for r in found.collect()} == {0, 2}


def test_proximity_with_a_replaced_word(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    replaced = item.replace("gamma", "other")
    absent = [replaced, "unrelated words", None, replaced]
    bench = items_frame(spark, [(5, item), (6, "one two"), (7, "")])
    docs = corpus.frame(spark, absent, [0, 1, 2, None])
    assert {(r.doc_id, r.item, r.start, r.pos) for r in decontaminate.proximity(docs, bench).collect()} == {(0, "5", 0, 0), (None, "5", 0, 0)}
    # The word stands elsewhere, so it is a term asked for.
    docs = corpus.frame(spark, [*absent, "gamma " * 3], [0, 1, 2, None, 4])
    rows = decontaminate.proximity_digest(docs, bench).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(0, 1, "5"), (1, 0, ""), (2, 0, ""), (None, 1, "5"), (4, 0, "")], key=str)


def near_by_rules(rows, items, slop=8, window=13, terms=6):
    """(doc_id, items) by the definition: all but one of a window's rarest occurring words within ``slop`` of one shift."""
    texts = [corpus.words(t) for _, t in rows]
    counts = corpus.Counter(w for words in texts for w in words)
    out = []
    for (i, _), words in zip(rows, texts, strict=True):
        found = set()
        for item, text in items:
            own = corpus.words(text)
            size = min(len(own), window, terms)
            enough = size - 1 if size >= 4 else size
            for start in range(max(1, len(own) - window + 1)) if own else ():
                places = [(counts[w], p, w) for p, w in enumerate(own[start : start + window], start) if counts[w]]
                asked = [(p, w) for _, p, w in sorted(places)[:terms]]
                hits = sorted({(pos - p, p) for p, w in asked for pos, x in enumerate(words) if x == w})
                if len(asked) >= enough and any(len({p for s, p in hits if first <= s <= first + slop}) >= enough for first, _ in hits):
                    found.add("" if item is None else str(item))
        out.append((i, len(found), ",".join(sorted(found))))
    return corpus.bag(out)


def test_proximity_equals_its_rules(spark, made):
    rows, items = made
    draw = random.Random(1)
    changed = []
    for i, text in rows[:70]:
        words = (text or "").split()
        for _ in range(draw.randrange(4)):
            if words:
                words[draw.randrange(len(words))] = draw.choice(["x", "two words", ""])
        changed.append((i, None if text is None else " ".join(words)))
    changed.append((900, ("filler " * 3_000) + (items[6][1] or "") + " filler" * 3_000))
    docs = corpus.frame(spark, [t for _, t in changed], [i for i, _ in changed])
    want = near_by_rules(changed, items)
    assert corpus.bag(decontaminate.proximity_digest(docs, items_frame(spark, items)).collect()) == want
    assert sum(n > 0 for _, n, _ in want.elements()) > 10


def test_proximity_of_empty_tables(spark):
    docs, bench = corpus.frame(spark, ["some text", None]), items_frame(spark, [(1, "some text"), (2, None)])
    assert decontaminate.proximity_digest(docs.limit(0), bench).collect() == []
    assert {tuple(r) for r in decontaminate.proximity_digest(docs, bench.limit(0)).collect()} == {(0, 0, ""), (1, 0, "")}


def test_a_shared_passage_is_asked_for_once(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = corpus.frame(spark, [f"before {passage} behind"] * 4)
    rows = []
    for n in (1, 40):
        items = decontaminate.items_of(items_frame(spark, [(i, f"own{i} words{i} {passage}") for i in range(n)]))
        texts = decontaminate.keyed_texts(docs)
        firsts = decontaminate.twins_of(items, 13)
        counts = decontaminate.corpus_counts(texts, items.select(decontaminate.F.explode("item_words").alias("term")).distinct(), 100)
        asked = decontaminate.windows_of(items, counts, firsts, 13, 3)
        rows.append(decontaminate.aligned(decontaminate.build_index(texts, asked, 100), asked, 100).count())
    assert rows[0] == rows[1] > 0
    got = decontaminate.contamination_digest(docs, items_frame(spark, [(i, f"own{i} words{i} {passage}") for i in range(40)])).collect()
    assert {(r.n_hit, r.n_items, r.contaminated) for r in got} == {(20, 40, True)}
