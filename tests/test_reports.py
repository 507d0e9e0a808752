"""Reports of tables without a fault, and of empty ones, against their SQL."""

import pytest
from check_oracle import compare

import __spark_entry__ as entry


@pytest.mark.parametrize("days", ["range(3)", "range(0)"])
def test_filter_report_without_incomplete_days(spark, con, tmp_path, days):
    """Every half hour of every day has an event, or there is no event at all."""
    con.execute(f"""COPY (SELECT (48 * d.d + p.p)::BIGINT AS event_id, TIMESTAMP '2024-01-01' + to_minutes((1440 * d.d + 30 * p.p)::BIGINT) AS ts, 1::BIGINT AS user_id,
        'view' AS event_type, 2.5::DOUBLE AS value, '' AS props FROM {days} d(d), range(48) p(p)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    own = con.cursor()
    own.execute(f"CREATE TEMP VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    name = "q03_filter_report"
    assert compare(spark, own, entry.queries()[name], entry.oracle_sql()[name], str(tmp_path)) == ("ok", 1)
