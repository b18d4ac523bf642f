"""The registered queries themselves: against their SQL, or their columns and rows."""

import duckdb
import pytest

from dialoom.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_pivotal_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_nnls_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_ngram_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op8_page_text": ["page_id", "url", "text", "n_chars"],
    "op9_simple8b_tokens": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op12_backtracking_pieces": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op13_chebyshev_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in want.description)
    order = [c[0] for c in want.description]
    rows = sorted((tuple(r[order.index(n)] for n in names) for r in want.fetchall()), key=repr)
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == rows


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_returns_whole_tables(spark, name):
    got = queries.queries()[name](spark, DATA)
    assert set(COLUMNS[name]) <= set(got.columns)
    table, key, each = ("pages", "page_id", 1) if name.startswith("op8") else ("embeddings", "vec_id", 4) if name.startswith("op13") else ("documents", "doc_id", 1)
    ids = sorted(r[0] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())
    found = sorted(r[0] for r in got.select(key).collect())
    if name.startswith("op5"):
        assert sorted(set(found)) == ids
    else:
        assert found == sorted(ids * each)
