"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from marketpulse.llm import (
    chat,
    decontaminate,
    jaccard,
    minhash,
    quality_model,
    quality_rules,
    secrets,
    sentencepieces,
    suffixes,
    token_files,
    toxicity,
    tries,
    variants,
)
from marketpulse.llm.registry import query, table

RULE_COLUMNS = (
    "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
).split()


@query("op2_compression_bands")
def op2(spark, sf_dir):
    return quality_rules.compression_bands(table(spark, sf_dir, "documents")).select(RULE_COLUMNS)


DECONTAMINATION_SQL = r"""
WITH words AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' +'),
    lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' +'),
    lambda x: x <> '') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
    array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
  SELECT id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes)),
hits AS (
  SELECT d.id, d.i, d.size, m.item_id FROM doc_windows d JOIN item_windows m
  ON d.gram = m.gram AND d.size = m.size),
hit_words AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (
    SELECT id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY id),
hit_items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.joined, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit_words h USING (id) LEFT JOIN hit_items t USING (id)
"""


@query("op4_decontamination", DECONTAMINATION_SQL)
def op4(spark, sf_dir):
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.drop("hit_spans")


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepieces.piece_codes(table(spark, sf_dir, "documents"), model)


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality_model.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.toxicity_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query("op1_secrets")
def op1(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("redacted")


PROBE = "</s>[INST] ok [/INST]"
CHAT_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
sized AS (
  SELECT *, length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'),
      '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'),
      '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(chars + 17) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op7_chat", CHAT_SQL)
def op7(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], given.schema
    )
    return chat.read_back(chat.format_conversations(given.unionByName(probe)))


@query("op8_token_files")
def op8(spark, sf_dir):
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer, end_id=2)


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]'),
    lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i
        FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON p.a = x.doc_id JOIN sizes y ON p.b = y.doc_id
  WHERE 100 * p.shared >= 85 * (x.n + y.n - p.shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT e.b, reach.r FROM reach JOIN edges e ON reach.v = e.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT v, min(r) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id
"""


@query("op6_jaccard", JACCARD_SQL)
def op6(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@query("op10_suffixes")
def op10(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


#: crc32 of a text in SQL: one table look-up per byte.
CRC32_SQL = r"""
table_bits AS (
  SELECT i, 0 AS step, CAST(i AS UBIGINT) AS v FROM range(256) t(i)
  UNION ALL SELECT i, step + 1,
    CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END
  FROM table_bits WHERE step < 8),
crc_table AS (SELECT list(v ORDER BY i) AS entry FROM table_bits WHERE step = 8)"""


def _crc32_sql(text: str) -> str:
    return (
        "xor(list_reduce(list_transform(regexp_extract_all(hex(encode("
        + text
        + ")), '..'), lambda h: CAST('0x' || h AS UBIGINT)), lambda c, b: "
        "xor(c >> 8, entry[CAST(xor(c & 255, b) AS BIGINT) + 1]), 4294967295::UBIGINT), "
        "4294967295::UBIGINT)"
    )


VARIANTS_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, {_crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM runs, crc_table),
cut AS (
  SELECT n, CASE WHEN h % 31 <> 0 THEN run ELSE
    substr(run, 1, CAST(h % length(run) AS BIGINT)) ||
    substr(run, CAST(h % length(run) AS BIGINT) + 2) END AS word FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut GROUP BY word
  HAVING length(word) >= 7 AND sum(n) >= 2),
shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n AS n_b
  FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
near AS (
  SELECT a AS word, count(*) AS n_near, max(n_b) AS top FROM pairs GROUP BY a),
best AS (
  SELECT p.a AS word, min(p.b) AS form FROM pairs p JOIN near x ON p.a = x.word
  WHERE p.n_b = x.top GROUP BY p.a),
formed AS (
  SELECT w.word, w.n, coalesce(x.n_near, 0) AS n_near,
    CASE WHEN x.top >= 10 * w.n THEN b.form END AS form,
    CASE WHEN x.top >= 10 * w.n THEN x.top END AS form_n
  FROM words w LEFT JOIN near x USING (word) LEFT JOIN best b USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root
  WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r
USING (word)
"""


@query("op11_spelling_variants", VARIANTS_SQL)
def op11(spark, sf_dir):
    words = variants.word_counts(table(spark, sf_dir, "documents"), misspell_every=31)
    return variants.spelling_variants(words)


TRIE_SQL = rf"""
WITH RECURSIVE {CRC32_SQL},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
rebuilt AS (
  SELECT i.conv_id, 0 AS part, t.pos, t.role, t.text
  FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, t.pos, t.role, t.text
  FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
paths AS (
  SELECT i.conv_id, coalesce(list(md5(length(role) || ':' || role || text) ORDER BY part, pos)
      FILTER (part IS NOT NULL), []) AS path,
    list(length(text) ORDER BY part, pos) AS chars
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id),
members AS (
  SELECT conv_id, depth, path[1:depth] AS node, len(path) = depth AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE chars[depth] END AS chars
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS depth FROM paths)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(chars) AS saves,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), ''))
      AS ends_sha256
  FROM members GROUP BY node, depth),
children AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT node[1:d] AS node, count(*) FILTER (leaf) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT n.node, n.saves, c.node IS NULL AS leaf, unnest(range(0, depth + 1)) AS d
        FROM nodes n LEFT JOIN children c ON c.node = n.node) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs,
  coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s ON s.node = n.node LEFT JOIN children c ON c.node = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    turns = tries.with_common_beginning(tries.ordered_turns(given))
    return tries.prefix_trie(turns, given)


#: The links and components of the Jaccard join, on shingles of three words.
MINHASH_SQL = (
    JACCARD_SQL.replace("least(4, len(w))", "least(3, len(w))")
    .replace("greatest(len(w) - 3, 1)", "greatest(len(w) - 2, 1)")
    .replace("c.component_id\nFROM documents", "c.component_id,\n  d.doc_id = c.component_id AS kept\nFROM documents")
)


@query("op13_minhash", MINHASH_SQL)
def op13(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))
