"""The registered queries of this package and their checking SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyledger.llm import bpe, conversations, decontaminate, licenses, line_dedup, near_dups, neighbours, packing, pii, quality, secrets, toxicity, variants
from skyledger.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The tokenizer's file; it has the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.proximity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_dup_digest(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_words(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    run.__name__: run
    for run in (
        op1_pii, op2_line_dedup, op3_packing, op4_licenses, op5_decontamination, op5_proximity, op6_secrets,
        op7_neighbours, op8_toxicity, op9_near_dups, op10_quality, op11_variants, op12_bpe, op13_conversations,
    )
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def secrets_sql() -> str:
    """Places from the gaps between the matches, for each rule."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, {rule.base} AS base, {rule.least} AS least,
    generate_subscripts(found, 1) AS i, unnest(found) AS m, unnest(held) AS held, unnest(gaps[1:len(found)]) AS gap
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS held,
      string_split_regex(t, '{pattern}') AS gaps FROM texts WHERE regexp_matches(t, '{pattern}')) r""")
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.RULES)
    span = "kind || ':' || start || ':' || stop"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, stop - length(m) AS start FROM (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM matches) s),
spans AS (SELECT * FROM placed WHERE length(held) >= least)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({span}, ',' ORDER BY start, ord) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY start, ord), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


#: The table of the checksum, and the checksum of the hexadecimal bytes ``x`` by it.
CRC_TABLE = """bits(i, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""
CRC_OF_X = """xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
    lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])))"""


def repair_sql() -> str:
    """Rows in order, and for each row the least (cost, audit, text) of every state."""

    def way(of: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {of} IS NOT NULL THEN {{'cost': {of}.cost + {cost}, 'audit': {of}.audit || '{letter}', 'made': {of}.made || {line}}} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    def insert(of: str, role: str) -> str:
        return way(of, "4", "I", f"chr(10) || '{role}:'")

    def stay(of: str, initial: str) -> str:
        return f"CASE WHEN fault IN (0, 3) AND c = '{initial}' THEN {way(of, 'fault', 'K', 'line')} END"

    def rerole(of: str, role: str) -> str:
        return f"CASE WHEN fault IN (0, 3) THEN {way(of, '3 + fault', 'R', f"chr(10) || '{role}:' || text")} END"

    delete = {of: way(of, "4", "D") for of in ("w0", "ws", "wu", "wa")}
    to_user = [f(of, x) for of in ("w0", "ws", "wa") for f, x in ((stay, "u"), (rerole, "user"))]
    nothing = "CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, made VARCHAR))"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE {CRC_TABLE},
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
kinds AS (SELECT *, {CRC_OF_X} % 20 AS kind FROM coded, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    trim(text, {space}) AS kept, left(role, 1) AS c, chr(10) || role || ':' || text AS line FROM damaged),
faulted AS (SELECT *, CASE WHEN kept = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
ids AS (SELECT DISTINCT conv_id FROM conversations),
ways(conv_id, i, w0, ws, wu, wa) AS (
  SELECT conv_id, CAST(0 AS BIGINT), z, {nothing}, {insert("z", "user")}, {way("z", "8", "II", "chr(10) || 'user:' || chr(10) || 'assistant:'")}
  FROM (SELECT conv_id, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'made': ''}} AS z FROM ids) s
  UNION ALL
  SELECT conv_id, i, n0, ns, nu, {least("na", insert("nu", "assistant"))} FROM (
    SELECT conv_id, i, n0, ns, {least("nu", insert("n0", "user"), insert("ns", "user"), insert("na", "user"))} AS nu, na FROM (
      SELECT w.conv_id, f.i, {delete["w0"]} AS n0, {least(delete["ws"], stay("w0", "s"))} AS ns,
        {least(delete["wu"], *to_user)} AS nu, {least(delete["wa"], stay("wu", "a"), rerole("wu", "assistant"))} AS na
      FROM ways w JOIN faulted f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) moved) closed),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulted GROUP BY conv_id),
ended AS (SELECT w.conv_id, {least("w0", "wa")} AS best FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n, 0))
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit, sha256(substr(best.made, 2)) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE_SQL = {
    "op5_decontamination": rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, len(w[s:s + 12]) AS n, w[s:s + 12] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM items WHERE len(w) > 0) p),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, item_id, s, p.n FROM (SELECT doc_id, n, s, w[s:s + n - 1] AS win FROM places) p
  JOIN windows v ON p.n = v.n AND p.win = v.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) u GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) i GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id""",
    "op6_secrets": secrets_sql(),
    "op13_conversations": repair_sql(),
    "op9_near_dups": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^ 	-
]+') AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM docs WHERE len(w) > 0) p),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS whole FROM shingled GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingled x
    JOIN shingled y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
reached AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
components AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept,
  CASE WHEN whole IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY whole) END AS class_id
FROM documents d JOIN components c ON d.doc_id = c.node LEFT JOIN sizes s ON d.doc_id = s.doc_id""",
    "op11_variants": r"""
WITH RECURSIVE """ + CRC_TABLE + r""",
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) e WHERE length(r) >= 5 GROUP BY 1, 2),
coded AS (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
checked AS (SELECT run, times, """ + CRC_OF_X + r""" AS h FROM coded, crc),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM checked),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
skips AS (SELECT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words) s),
cuts AS (SELECT DISTINCT s.word AS long, w.word AS short FROM skips s JOIN words w ON w.word = s.a || s.b),
near AS (SELECT x.word, y.word AS other FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT long, short FROM cuts UNION SELECT short, long FROM cuts),
ranked AS (SELECT near.word, other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place FROM near JOIN words o ON o.word = other),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
    CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
rooted AS (SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM rooted r JOIN formed f ON f.form = r.word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN rooted r ON f.word = r.word""",
    "op2_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
}
