from datetime import datetime, timedelta

import pytest

from congruity.spec import SpecError
from congruity.streaming.events import first_seen, match, window_counts
from congruity.streaming.runs import file_stream, run_available

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, name, rows):
    path = f"{tmp_path}/{name}"
    for i, part in enumerate(rows):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in part], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_window_counts(spark, tmp_path):
    s = stream(spark, tmp_path, "w", [[("a", 0), ("a", 3), ("b", 7)], [("c", 60)], [("c", 120)]])
    got = {(r.start, r.n) for r in drain(window_counts(s, "ts", "10 minutes", "5 minutes"), "w")}
    assert (T0, 2) in got and (T0 + timedelta(minutes=5), 1) in got


def test_duplicates_go(spark, tmp_path):
    s = stream(spark, tmp_path, "d", [[("a", 0), ("a", 1), ("b", 2)], [("a", 3)]])
    assert sorted(r.k for r in drain(first_seen(s, ["k"], "ts", "1 hour"), "d")) == ["a", "b"]


def test_streams_match_and_report_what_is_missing(spark, tmp_path):
    s = stream(spark, tmp_path, "s", [[("a", 0), ("b", 1)], [("z", 600)], [("z", 1200)]])
    t = stream(spark, tmp_path, "t", [[("a", 2), ("c", 1)], [("z", 600)], [("z", 1200)]])
    got = {(r.k, r.status) for r in drain(match(s, t, "k", "ts", "10 minutes", "5 MINUTES"), "m")}
    assert {("a", "MATCHED"), ("b", "MISSING_IN_TARGET"), ("c", "EXTRA_IN_TARGET")} <= got


def arrive(spark, path, rows):
    spark.createDataFrame([(k, T0 + timedelta(minutes=m)) for k, m in rows], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(path)


def test_runs_go_on_from_their_checkpoint(spark, tmp_path):
    src, dst, out, state = (str(tmp_path / n) for n in ("s", "t", "out", "state"))
    arrive(spark, src, [("a", 0), ("b", 1), ("p", 3)])
    arrive(spark, dst, [("a", 2), ("q", 4)])

    def run():
        s, t = (file_stream(spark, p, "k string, ts timestamp", files=1) for p in (src, dst))
        return run_available(match(s, t, "k", "ts", "10 minutes", "5 MINUTES"), out, state)

    run()
    assert {(r.k, r.status) for r in spark.read.parquet(out).collect()} == {("a", "MATCHED")}
    assert run() >= 0 and spark.read.parquet(out).count() == 1  # nothing new, nothing twice
    arrive(spark, src, [("late", 500)])
    arrive(spark, dst, [("p", 6), ("late", 500)])  # the partner of p comes with the next run
    run()
    got = sorted((r.k, r.status) for r in spark.read.parquet(out).collect())
    assert got == [("a", "MATCHED"), ("b", "MISSING_IN_TARGET"), ("late", "MATCHED"), ("p", "MATCHED"), ("q", "EXTRA_IN_TARGET")]


def test_duplicates_are_known_across_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("s", "out", "state"))
    for rows in ([("a", 0), ("a", 1), ("b", 2)], [("a", 3), ("c", 4)], [("b", 5)]):
        arrive(spark, src, rows)
        run_available(first_seen(file_stream(spark, src, "k string, ts timestamp"), ["k"], "ts", "1 hour"), out, state, partition_by=("k",))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    with pytest.raises(SpecError):
        run_available(spark.range(1), out, state)
