"""The registered queries on a whole small scale: their columns, rows and digests."""

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from registra.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op5_sketch": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_html": "page_id bigint, url string, text string, n_chars bigint",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op10_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_lines": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op12_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_periodic": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
}


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op12_trie"])
def test_query(spark, name):
    out = queries.QUERIES[name](spark, SF)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == t for c, t in (x.split() for x in COLUMNS[name].split(", ")))
    table, key = ("pages", "page_id") if name == "op7_html" else ("embeddings", "vec_id") if name == "op4_neighbours" else ("documents", "doc_id")
    rows = queries.table(spark, SF, table)
    if name == "op4_neighbours":
        asked = rows.where(F.col(key) % 50 == 0).count()
        assert out.count() == 5 * asked and out.select("query_id", "rank").distinct().count() == 5 * asked
    else:
        assert sorted(r[0] for r in out.select(key).collect()) == sorted(r[0] for r in rows.select(key).collect())


def test_language_query_is_held_out(spark):
    got = {r.doc_id: r for r in queries.op9_language(spark, SF).collect()}
    docs = queries.table(spark, SF, "documents").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in docs)
    fold = [r for r in docs if got[r.doc_id].held_out and r.lang and re.search(r"[^\W\d_]", r.text or "")]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in fold) >= 0.9 * len(fold)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out, sql = queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name]
    want = duck.execute(sql)
    assert [f"{c} {t}" for c, t in out.dtypes] == COLUMNS[name].split(", ")
    assert [x[0] for x in want.description] == out.columns
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want.fetchall(), key=key)
