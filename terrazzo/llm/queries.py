"""Registered queries of the text operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrazzo.llm import bpe, chat, decontam, middle, negatives, ngramjoin, pii, quality, secretscan, sharding, sitetree, substring, warc
from terrazzo.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT a AS node, a AS reach FROM (SELECT DISTINCT a FROM e) UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(reach) AS c FROM r GROUP BY node) m USING (doc_id)
"""


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
p AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT g.doc_id, g.i, unnest([0, 1, 2]) AS k FROM g JOIN m USING (doc_id, gram)) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 100 * n_dup_lines > 50 * greatest(n_lines, 1)) AS kept
FROM f
"""


def _span_digests(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The contract's columns from (doc_id, spans): counts and digest of the base spans, and all spans."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[of_kind(k) for k in kinds], F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(secretscan.scan(_table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digests(pii.scan(_table(spark, sf_dir, "documents")), pii.TYPES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(_table(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).cast("long")
    response = warc.read(spark, archive).where("warc_type = 'response'")
    revisit = warc.read(spark, archive, payload=False).where("warc_type = 'revisit'")
    head = F.col("headers")
    # responses are measured on the payload that was read; revisits carry no payload
    first = response.select(
        head["x-page-id"].cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    again = revisit.select(
        head["x-page-id"].cast("long").alias("page_id"),
        head["x-payload-length"].cast("long").alias("payload_bytes"),
        F.substring_index(head["warc-payload-digest"], ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page(head["warc-refers-to"]).alias("refers_to"),
    )
    return first.unionByName(again)


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS keeper FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (h)
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{planted}'), (-1L, 1L, 'assistant', '{planted}') AS t(conv_id, turn, role, text)")
    chats = chat.format_chats(turns.unionByName(extra))
    read = chats.withColumns({"_turns": chat.parse_chats(F.col("formatted")), "_loss": chat.loss_text(F.col("segments"))})
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        digest(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w AS pos, coalesce(lag(role) OVER w, 'begin') AS before,
         lead(role) OVER w IS NULL AS is_last,
         length(role) + length(text) + (length(role || text) - length(replace(role || text, '\', '')))
         + (length(role || text) - length(translate(role || text, '<[', ''))) AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + 12 + 1 + 11) AS BIGINT) AS formatted_chars,
       bool_and(before || '>' || role IN ('begin>system', 'begin>user', 'system>user', 'user>assistant',
                                          'assistant>user', 'assistant>tool', 'tool>assistant', 'tool>tool'))
       AND bool_or(is_last AND role = 'assistant') AS valid
FROM e GROUP BY conv_id
"""


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT side, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id),
c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s i ON d.shingle = i.shingle AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment
FROM c JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.75)
"""


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
s AS (SELECT anchor_id, id, score FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT s.anchor_id, s.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.id AS negative_id, s.score AS positive_score, p.score AS negative_score
FROM s JOIN p ON p.anchor_id = s.anchor_id AND NOT p.same AND 30 * s.score <= 100 * p.score AND 100 * p.score <= 90 * s.score
WINDOW w AS (PARTITION BY s.anchor_id, s.id ORDER BY p.score DESC, p.id)
QUALIFY row_number() OVER w <= 10
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.dedup(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY gram) AS first FROM g),
c AS (SELECT doc_id, list_distinct(list(i + k)) AS gone FROM (SELECT doc_id, i, unnest(range(20)) AS k FROM r WHERE first.d <> doc_id OR first.i <> i) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, gone FROM d LEFT JOIN c USING (doc_id)),
s AS (
  SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS kept
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM k) x
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, unnest(gone) AS p FROM c) y WHERE y.d = x.doc_id AND y.p = x.p) GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM k LEFT JOIN s USING (doc_id)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS k1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS k2,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4
  FROM d),
f AS (
  SELECT doc_id, t, n, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
         array_to_string(u[greatest(k1, k2) + 1:], '') AS s,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""


def queries() -> dict:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_pii": op2_pii,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_html_extraction": op4_html_extraction,
        "op5_warc": op5_warc,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_sharding": op7_sharding,
        "op8_ngram_jaccard": op8_ngram_jaccard,
        "op9_quality_rules": op9_quality_rules,
        "op10_decontamination": op10_decontamination,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_substring_dedup": op12_substring_dedup,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict:
    return {
        "op5_warc": OP5_SQL,
        "op6_chat_formatting": OP6_SQL,
        "op8_ngram_jaccard": OP8_SQL,
        "op9_quality_rules": OP9_SQL,
        "op10_decontamination": OP10_SQL,
        "op11_hard_negatives": OP11_SQL,
        "op12_substring_dedup": OP12_SQL,
        "op13_fill_in_middle": OP13_SQL,
    }
