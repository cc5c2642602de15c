import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshness.functions.scalars import biased_rating
from freshness.operators import priority as R, windows as N
from freshness.operators.factors import gram_sums, ridge_fit
from freshness.operators.ordered import width_slice
from freshness.plans import catalog, streams
from freshness.plans.tables import Tables
from freshness.sources import io
from freshness.streaming import maintenance as M, streams as T

D = 2


@pytest.fixture(scope="module")
def ratings():
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 9)) if t % 3 else 0, int(rng.integers(0, 7)), t, float(rng.uniform(1, 5))) for t in range(160)]
    return pd.DataFrame(rows, columns=["user_id", "item_id", "ts", "rating"])


def solve(items, rows, alpha=0.001):
    x = np.stack([items[i][:D] for i in rows["item_id"]])
    y = rows["rating"].to_numpy() - np.array([items[i][-1] for i in rows["item_id"]])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(D), xc.T @ yc)
    return np.append(w, y.mean() - x.mean(0) @ w)


def ridge_model():
    sums = lambda e: gram_sums(e, "user_id", "item_vec", F.col("rating") - F.element_at("item_vec", -1), D)
    fit = lambda: ridge_fit("n", "sum_y", "sum_x", "rhs", "gram", F.lit(0.001))
    return M.Model(sums, fit, lambda: biased_rating("feature", "item_vec"), 3.0)


def mean_model():
    sums = lambda e: e.groupBy("user_id").agg(F.count("rating").alias("n"), F.sum("rating").alias("total"))
    return M.Model(sums, lambda: F.array(F.col("total") / F.col("n")), lambda: F.element_at("feature", 1), 3.0)


def sweep(spark, folder, batches, runs, **options):
    job = M.Maintenance(spark, folder, runs, mean_model(), "user_id", "rating", ["ts"], F.col("item_id") != 3, **options)
    for b, rows in enumerate(batches):
        job.run_batch(spark.createDataFrame(rows), b)
    return job


def test_runs_of_a_sweep(spark, tmp_path, ratings):
    """Each run of a sweep equals its own plain loop; repeating a round and folding the logs change nothing."""
    batches = [ratings[ratings["ts"] // 40 == b] for b in range(4)]
    runs = [M.Run("total_error", 1.5, lambda r: F.round(R.total_error(), 9)), M.Run("max_pending", 2, lambda r: R.max_pending()),
            M.Run("batch", 3.0), M.Run("max_pending", 0.0, lambda r: R.max_pending()), M.Run("max_pending", M.EVERYTHING, lambda r: R.max_pending())]
    job = sweep(spark, str(tmp_path / "a"), batches, runs, compact_every=2)
    got = job.table("predictions").toPandas()
    assert not got[(got["y_pred"] != 3.0) & ~got["known"]].size and len(got) == len(runs) * len(ratings)
    for run in runs:
        feature, error, pending, saved = {}, {}, {}, 0.0
        for b, rows in enumerate(batches):
            for r in rows.itertuples():
                guess = feature.get(r.user_id, 3.0) if r.item_id != 3 else 3.0
                mine = got[(got["ts"] == r.ts) & (got["policy"] == run.policy) & (got["budget"].isna() if run.budget is None else got["budget"] == run.budget)]
                assert mine["y_pred"].tolist() == [pytest.approx(guess)]
                error[r.user_id] = error.get(r.user_id, 0.0) + abs(guess - r.rating)
                pending[r.user_id] = pending.get(r.user_id, 0) + (r.item_id != 3)
            waiting = [u for u, n in pending.items() if n]
            score = error if run.policy == "total_error" else pending
            saved += run.budget or 0
            if run.policy == "batch":
                chosen, saved = (waiting, 0.0) if len(waiting) <= saved else ([], saved)
            elif run.budget is None:
                chosen = waiting
            else:
                chosen = sorted(waiting, key=lambda u: (-round(score[u], 9), u))[: run.allowed(b)]
            seen = pd.concat(batches[: b + 1])
            for u in chosen:
                feature[u] = seen[(seen["user_id"] == u) & (seen["item_id"] != 3)]["rating"].mean()
                error[u], pending[u] = 0.0, 0
    rows = lambda j: sorted(map(str, j.table("predictions").collect()))
    before = rows(job)
    job.run_batch(spark.createDataFrame(batches[3]), 3)
    assert rows(job) == before
    assert rows(sweep(spark, str(tmp_path / "b"), batches, runs, compact_every=100)) == before


def test_a_sweep_broadcasts_no_table_that_grows(spark, tmp_path, ratings):
    """However small the compressed files of items, keys and features are."""
    spark.createDataFrame([(i,) for i in range(1, 90)], "p_partkey LONG").write.parquet(f"{tmp_path}/part.parquet")
    events = spark.createDataFrame([(1, 40), (1, 41), (2, 80), (3, None), (4, 500)], "user_id LONG, item_id LONG")
    marked = streams.in_catalogue(Tables(spark, str(tmp_path)), events)
    plans = [marked]
    assert sorted((r.user_id, r.item_id, r.listed) for r in marked.where("user_id < 3").collect()) == [(1, 40, None), (1, 41, True), (2, 80, None)]
    assert marked.where("listed IS NULL").count() == 4

    class Watched(M.Maintenance):
        def _write(self, df, *args):
            plans.append(df)
            return super()._write(df, *args)

    runs = [M.Run("total_error", 1.5, lambda r: R.total_error()), M.Run("round_robin", None, lambda r: F.lit(r))]
    job = Watched(spark, str(tmp_path / "job"), runs, mean_model(), "user_id", "rating", ["ts"])
    for b in range(2):
        job.run_batch(spark.createDataFrame(ratings[ratings["ts"] % 2 == b]), b)
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert not [t for t in texts if "BroadcastHashJoin" in t]
    assert sum("SortMergeJoin" in t for t in texts) > 5


def test_a_step_is_never_cut(spark, tmp_path):
    rows = spark.range(0, 100).select("id", F.floor(F.col("id") / 30).alias("step"))
    io.write_steps(rows, "step", "id", str(tmp_path / "src"))
    seen = []
    stream = io.replay_source(spark, str(tmp_path / "src"), rows.schema).drop("_folder")
    writer = stream.writeStream.foreachBatch(lambda df, b: seen.append((b, sorted(r.id for r in df.collect())))).option("checkpointLocation", str(tmp_path / "m"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert seen == [(b, list(range(b * 30, min(100, b * 30 + 30)))) for b in range(4)]


@pytest.mark.parametrize("update_first,budget", [(False, 1.5), (False, 0.0), (True, 1.5)])
def test_maintenance_equals_the_loop(spark, tmp_path, ratings, update_first, budget):
    rng = np.random.default_rng(9)
    items = {i: rng.normal(size=D + 1) for i in range(7)}
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in items.items()], "item_id LONG, item_vec ARRAY<DOUBLE>")
    src = str(tmp_path / "src")
    io.write_replay(spark.createDataFrame(ratings), "ts", src, 4)
    files = [spark.read.parquet(f).toPandas() for f in sorted(spark.read.parquet(src).inputFiles())]
    schema = spark.read.parquet(src).schema
    job = M.Maintenance(spark, str(tmp_path / "out"), [M.Run("total_error", budget, lambda r: R.total_error())], ridge_model(), "user_id", "rating", ["ts"],
                        update_first=update_first, compact_every=2)
    writer = M.stream_maintain(io.replay_source(spark, src, schema).join(table, "item_id"), str(tmp_path / "marks"), job)
    writer.trigger(availableNow=True).start().awaitTermination()

    vec, err, pending, seen = {}, {}, {}, ratings.iloc[:0]
    chosen, preds = [], {}

    def predict(batch):
        for r in batch.itertuples():
            v, m = vec.get(r.user_id), items[r.item_id]
            guess = 3.0 if v is None else float(np.clip(v[:D] @ m[:D] + v[-1] + m[-1], 1, 5))
            preds[r.ts] = guess
            err[r.user_id] = err.get(r.user_id, 0.0) + abs(guess - r.rating)

    def update(b):
        allowed = int(np.floor((b + 1) * budget) - np.floor(b * budget))
        order = sorted((-err.get(u, 0.0), u) for u, n in pending.items() if n)[:allowed]
        for _, u in order:
            vec[u] = solve(items, seen[seen["user_id"] == u])
            err[u], pending[u] = 0.0, 0
            chosen.append((b, u))

    for b, batch in enumerate(files):
        if not update_first:
            # predictions of a round all use the vectors of its start
            predict(batch)
        seen = pd.concat([seen, batch])
        for u, n in batch["user_id"].value_counts().items():
            pending[u] = pending.get(u, 0) + n
        update(b)
        if update_first:
            predict(batch)

    got = job.table("predictions").toPandas().set_index("ts")["y_pred"]
    assert len(got) == len(ratings)
    for t, guess in preds.items():
        assert got[t] == pytest.approx(guess), t
    made = job.table("updates").collect()
    assert sorted((r.round_no, r.user_id) for r in made) == sorted(chosen)
    assert len(chosen) <= 4 * budget


def test_windows_agree_with_batch(spark, tmp_path, ratings):
    src = str(tmp_path / "src")
    io.write_replay(spark.createDataFrame(ratings), "ts", src, 5)
    stream = io.replay_source(spark, src, spark.read.parquet(src).schema)
    out = T.stream_count_windows(stream, "user_id", "ts", "rating", 6, 2)
    io.feature_log_sink(out, str(tmp_path / "o"), str(tmp_path / "m")).trigger(availableNow=True).start().awaitTermination()
    batch = N.count_windows(spark.createDataFrame(ratings), "user_id", "ts", "rating", 6, 2, width_slice("ts", 13))
    rows = lambda df: sorted((r.user_id, r.window, r.end_rn, tuple(r["values"])) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "o"))) == rows(batch.select("user_id", "window", "end_rn", "values"))


def test_slide_longer_than_the_window(spark, ratings):
    out = N.count_windows(spark.createDataFrame(ratings), "user_id", "ts", "rating", 2, 5, width_slice("ts", 13)).collect()
    for user, g in ratings.groupby("user_id"):
        x = g["rating"].tolist()
        want = [(w, tuple(x[w * 5 : w * 5 + 2])) for w in range(len(x)) if w * 5 + 2 <= len(x)]
        assert sorted((r.window, tuple(r["values"])) for r in out if r.user_id == user) == want


def test_compaction_keeps_the_current_features(spark, tmp_path):
    log, small = str(tmp_path / "log"), str(tmp_path / "small")
    for b in range(3):
        rows = [(k, b * 10 + k, float(b)) for k in range(b, 4)]
        spark.createDataFrame(rows, "key LONG, ts LONG, x DOUBLE").write.parquet(f"{log}/batch={b}")
    T.compact_features(spark, log, small, "key", "ts")
    read = lambda p: sorted(map(tuple, T.current_features(spark, p, "key", "ts").collect()))
    assert read(small) == read(log) and len(read(log)) == 4


def test_memory_sink(spark, tmp_path, ratings):
    src = str(tmp_path / "src")
    io.write_replay(spark.createDataFrame(ratings), "ts", src, 2)
    stream = io.replay_source(spark, src, spark.read.parquet(src).schema).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    q = io.console_or_memory_sink(stream, "seen_counts", "complete").option("checkpointLocation", str(tmp_path / "m")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen_counts").agg(F.sum("n")).first()[0] == len(ratings)


def test_every_window_comes_out(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    want = duckdb.sql(f"""SELECT user_id, date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR,
      round(sum(value * CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) / nullif(sum(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)), 0), 7), count(*)
      FROM '{folder}/events.parquet' GROUP BY ALL""").fetchall()
    rows = catalog.QUERIES["stream_tumbling"](spark, folder).collect()
    got = {(r.key, r.window_start): (r.window_end, r.n, r.weighted_avg) for r in rows}
    assert len(rows) == len(want) and got.keys() == {r[:2] for r in want}
    assert all(got[r[:2]][:2] == (r[2], r[4]) for r in want)
    assert all(got[r[:2]][2] == (None if r[3] is None else pytest.approx(r[3], abs=1e-6)) for r in want)
    days = duckdb.sql(f"SELECT date_trunc('day', ts) AS day, count(*) AS n FROM '{folder}/events.parquet' GROUP BY 1").fetchall()
    got = catalog.QUERIES["stream_watermark"](spark, folder).select("day", "n").collect()
    assert sorted((r.day.date(), r.n) for r in got) == sorted((getattr(d, "date", lambda: d)(), n) for d, n in days)


def test_a_window_open_over_batches_keeps_its_last_state(spark, tmp_path):
    rows = spark.range(0, 40).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("key"))
    io.write_replay(rows, "ts", str(tmp_path / "src"), 4)
    stream = T.stream_watermark(io.replay_source(spark, str(tmp_path / "src"), rows.schema), "ts", "1 hour")
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "key").agg(F.count(F.lit(1)).alias("n"))
    T.stream_table(counts, str(tmp_path / "log"), str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() > 2
    got = T.current_table(spark, str(tmp_path / "log"), ["w", "key"])
    assert sorted((r.key, r.n) for r in got.collect()) == [(0, 20), (1, 20)]


def test_a_batch_of_several_files(spark, tmp_path):
    """`parts` files make one batch; batches stay in order and hold all rows, and no file holds a whole batch."""
    rows = spark.range(0, 4_000).select("id", F.col("id").cast("string").alias("text"))
    io.write_replay(rows, "id", str(tmp_path / "src"), 2, 3)
    sizes = [spark.read.parquet(f).count() for f in rows.sparkSession.read.parquet(str(tmp_path / "src")).inputFiles()]
    assert len(sizes) == 6 and max(sizes) < 1_500
    seen = []
    stream = io.replay_source(spark, str(tmp_path / "src"), rows.schema, 3)
    writer = stream.writeStream.foreachBatch(lambda df, b: seen.append([r.id for r in df.collect()])).option("checkpointLocation", str(tmp_path / "m"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 2 and max(seen[0]) < min(seen[1]) and sorted(seen[0] + seen[1]) == list(range(4_000))


def test_rows_of_a_key_come_in_order():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"ts": rng.integers(0, 9, 40), "pass_id": rng.integers(0, 1_000, 40).astype(str), "x": range(40)})
    for frames in ([rows], [rows[:15], rows[15:]], [rows[:1]], [rows.assign(ts=rows["ts"].where(rows["ts"] > 2))]):
        got = T._in_order(iter(frames), ["ts", "pass_id"])
        assert got["x"].tolist() == pd.concat(frames).sort_values(["ts", "pass_id"])["x"].tolist()
