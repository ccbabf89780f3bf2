import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import normal, rows_of

SF = "/root/testdata/sf0.001"
# one query of each family; all of them: python check_queries.py
CHECKED = ["sliding_count_keyed", "session_strict_gap", "count_window_all", "watermark_lag", "sliding_on_time_spark",
           "late_rows", "early_count_panes", "parse_policy_storm", "session_policy_spark", "profile_diff",
           "user_function_session", "user_aggregate_count_window", "sliding_on_time_avg", "early_avg_panes", "session_policy_avg",
           "session_late_rows_whole", "session_early_panes_with_lateness"]


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["start_us", "end_us", "key", "count"]
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    got = queries()[name](spark, SF).toPandas()
    assert rows_of(normal(got)) == rows_of(normal(duck.sql(oracle_sql()[name]).df()))
