import duckdb
import pytest

from veilgrid.plans import catalog

SF = "/root/testdata/sf0.001"
FAST = ["minmax_encode", "string_encode", "timestamp_encode", "snapped_range", "lcf_groups", "lcf_groups_noisy", "pid_xor", "flattened_count", "null_pid_unaccounted", "adjusted_counts", "nearest_values", "entity_max", "entity_joins", "balances_descending", "correlations", "binned_error", "column_summary", "ordinal_codes", "one_hot_flags", "robust_scaled", "varied_columns", "csv_round_trip", "dependence_noiseless"]


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = db.sql(catalog.ORACLES[name]).df(), catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(tuple(round(float(x), 5) if isinstance(x, (int, float)) or getattr(x, "dtype", None) is not None and x.dtype.kind in "if" else str(x) for x in r) for r in df[columns].fillna(-1e9).itertuples(index=False))
    assert rows(got) == rows(want)


def test_every_oracle_has_its_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
