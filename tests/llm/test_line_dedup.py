import corpus

from skyledger.llm import line_dedup

PARTS = [
    "a line of some length", "  A LINE of some length\t", "short", "", "another line here", "Ärger und Überfluß", "ärger und überfluß", "ten letter",
    "nine char", "\x0bten letter\x0c", "x\ry", "only spaces   ", "       ", "😀😀😀😀😀😀😀😀😀😀",
]


def check(spark, rows):
    docs = corpus.frame(spark, [t for _, t in rows], [i for i, _ in rows])
    want = corpus.dedup_lines(rows)
    got = line_dedup.line_digest(docs).collect()
    assert corpus.bag(got) == corpus.bag((i, n, gone, corpus.sha(kept)) for i, n, gone, kept in want)
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    rows_kept = corpus.bag((r.doc_id, r.text, r.n_chars) for r in kept.collect())
    whole = zip(rows, want, strict=True)
    assert rows_kept == corpus.bag((i, None if t is None else w[3], None if t is None else len(w[3])) for (i, t), w in whole)


def test_equals_brute_force(spark):
    texts = [None, "", *corpus.pieces(3, PARTS, 200, 9, "\n")]
    check(spark, list(zip(range(len(texts)), texts, strict=True)))


def test_repeated_and_null_ids(spark):
    text = "a line of some length\nshort"
    check(spark, [(4, text), (4, text), (4, "a line of some length"), (None, text), (None, text), (9, text), (2, "other\n" + text), (-3, "x")])


def test_hot_line_and_long_document(spark):
    rows = [(i, f"the line that many documents share\nown line number {i}") for i in range(700)]
    rows.append((1000, "\n".join(f"own line number {i % 900}" for i in range(5000))))
    check(spark, rows)


def test_empty_table(spark):
    docs = corpus.frame(spark, ["x"]).limit(0)
    assert line_dedup.line_digest(docs).collect() == [] == line_dedup.without_repeated_lines(docs).collect()


def test_bitmaps_instead_of_texts(spark):
    docs = corpus.frame(spark, ["\n" * 130 + "a line of some length", "\n" * 130 + "a line of some length"])
    (row,) = line_dedup.drop_bitmaps(line_dedup.keyed_texts(docs)).collect()
    assert row.doc_id == 1 and [(w.word, w.bits) for w in row.keep] == [(2, ~(1 << 2))]
