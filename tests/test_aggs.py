from datetime import date, datetime

import duckdb

from freshness.plans import catalog


def test_views_of_any_day_are_kept(spark, tmp_path):
    at = [(1, datetime(2023, 12, 28, 23, 59)), (1, datetime(2024, 1, 31)), (2, datetime(2024, 3, 1, 12)), (2, datetime(2024, 3, 1, 13)), (3, datetime(2024, 1, 5))]
    rows = [(i, k, ts, 1.0, "view") for i, (k, ts) in enumerate(at)] + [(9, 4, datetime(2025, 1, 1), 1.0, "click")]
    schema = "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, value DOUBLE, event_type STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(f"""WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day FROM '{tmp_path}/events.parquet/*.parquet' WHERE event_type = 'view'),
    d AS (SELECT unnest(range((SELECT min(day) FROM v), (SELECT max(day) FROM v) + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day)
    SELECT u.user_id, d.day, (SELECT count(*) FROM v WHERE v.user_id = u.user_id AND v.day = d.day), date_diff('day', DATE '2023-12-31', d.day) * 1440
    FROM (SELECT DISTINCT user_id FROM v) u CROSS JOIN d""").fetchall()
    got = catalog.QUERIES["views_long"](spark, str(tmp_path)).select("user_id", "day", "n_views", "ts_min").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_views for r in got) == len(at) and (1, date(2023, 12, 28), 1, -4320) in map(tuple, got)


def test_no_views_give_no_rows(spark, tmp_path):
    schema = "event_id LONG, user_id LONG, ts TIMESTAMP_NTZ, value DOUBLE, event_type STRING"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES["views_long"](spark, str(tmp_path)).count() == 0
