"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as dc
from . import align, dual_tree, html_tree, huffman_ids, lattice_lm, mixing, mpeg_media, packing, quality_fm, recompress, simhash, url_filter
from .common import crc_of_id, table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality_fm.score_documents(docs, quality_fm.train(docs, labels))
    return scored.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('a' || source, 'b') AS src, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
per AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY src),
ranked AS (SELECT src, source_size, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM per),
capped AS (SELECT *, CAST(source_size AS DOUBLE) * 2 AS cap FROM ranked),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM capped),
water AS (SELECT max(lvl) AS water FROM levels),
targets AS (SELECT src, source_size, least(cap, water * w) AS target FROM levels CROSS JOIN water),
parts AS (
  SELECT src, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
running AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
         CAST(floor(p.target - p.whole * p.source_size) AS BIGINT) AS extra,
         coalesce(sum(s.size) OVER (PARTITION BY s.src ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.src = p.src)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, extra - before)) AS BIGINT) AS taken FROM running
"""


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.id_digests(*huffman_ids.write_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), vocabulary("word_bpe_49k.json"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM g),
gone AS (SELECT doc_id, list(p) AS places, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE nth > 1) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(places, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""


def op8_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "samples", "sample_rate", "offsets")
    return mpeg_media.media_round_trip(table(spark, sf_dir, "documents")).select(*names)


def op9_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.s, g.n, x.item_id FROM grams g JOIN wins x ON g.win = x.win AND g.n = x.n),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(m.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.listed, '')) AS items_sha256, coalesce(m.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked m ON d.doc_id = m.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
held AS (SELECT doc_id, doc, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(w) AS term FROM held) GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS (
  SELECT DISTINCT item, item_id, x.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT item, item_id, unnest(w) AS term FROM i) x JOIN df ON x.term = df.term CROSS JOIN total),
found AS (
  SELECT item, item_id, held.doc, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) AS BIGINT) AS score
  FROM asked JOIN tf ON asked.term = tf.term JOIN held ON tf.doc = held.doc CROSS JOIN total GROUP BY item, item_id, held.doc, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_fm, op2_lattice_lm, op3_simhash_pigeonring, op4_source_mixing, op5_huffman_ids, op6_url_filter, op7_recompression, op8_mpeg_media, op9_html_tree, op10_decontamination, op11_token_alignment, op12_best_fit_packing, op13_dual_tree_search)}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": OP4_SQL, "op7_recompression": OP7_SQL, "op10_decontamination": OP10_SQL, "op13_dual_tree_search": OP13_SQL}
