import duckdb
import pytest

import __spark_entry__ as entry
from quoteloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["benchmark_window_fallback", "compare_items", "po_prefill_mode", "clean_numeric", "tokenize_desc", "canonical_registry_loose", "receipt_dedupe", "bm25_topk", "knn_topk", "rrf_fusion", "attr_filter", "item_exclusion", "scope_match", "exact_code_match", "index_status"]


def shown(row):
    return tuple("" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)[:10] if hasattr(v, "year") else str(v) for v in row)


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(shown, got.select(cols).collect())) == sorted(map(shown, want))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
