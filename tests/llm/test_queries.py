"""The registered text queries against their SQL on the smallest tables; every query's columns."""

import os

import duckdb
import pytest

from terrazzo.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
COLUMNS = {
    "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op5_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op6_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op7_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op9_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op13_fill_in_middle": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    df, rel = queries.queries()[name](spark, SF), duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr) and got


def test_chat_sql_counts_escapes(spark, tmp_path):
    """Backslashes and control characters in roles and texts, which the given conversations lack."""
    rows = [(1, 0, "user", "a\\b \\\\[x]<|im_end|>"), (1, 1, "assistant", "\\"), (2, 0, "us\\er", "<<[["), (2, 1, "assistant", None), (3, 0, None, "\\<[")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    df, rel = queries.op6_chat_formatting(spark, str(tmp_path)), con.sql(queries.OP6_SQL)
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())
    assert df.where("conv_id = 1").first()["formatted_chars"] == 2 * (12 + 1 + 11) + len("user" + rows[0][3] + "assistant" + rows[1][3]) + 3 + 2 + 1


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    got = dict(queries.queries()[name](spark, SF).dtypes)
    assert {c: got.get(c) for c in COLUMNS[name]} == COLUMNS[name]
