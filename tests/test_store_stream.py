import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidepanel.sources import panels
from tidepanel.sources.panels import FactorStore
from tidepanel.streaming.bars import event_bars
from tidepanel.streaming.running import running_means, to_store


def test_store_appends_only_newer_rows(spark, tmp_path):
    store = FactorStore(spark, str(tmp_path))
    day = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    schema = "date date, code string, value double"
    store.save("f", spark.createDataFrame([(day[0], "a", 1.0), (day[1], "a", 2.0)], schema))
    store.append("f", spark.createDataFrame([(day[1], "a", 9.0), (day[2], "a", 3.0)], schema))
    assert [r.value for r in store.load("f").orderBy("date").collect()] == [1.0, 2.0, 3.0]
    note = store.catalog().first()
    assert note.n == 3 and note.last_date == day[2] and note.days == 1.0


def test_store_deletes_syncs_and_keeps_for_a_while(spark, tmp_path):
    here, there = FactorStore(spark, str(tmp_path / "a")), FactorStore(spark, str(tmp_path / "b"))
    made = lambda v: spark.createDataFrame([(dt.date(2024, 1, 1), "a", v), (dt.date(2024, 1, 2), "a", v)], "date date, code string, value double")
    assert here.catalog().count() == 0
    here.append("f", made(1.0))
    here.save("g", made(2.0))
    assert here.sync(there) == ["f", "g"] and here.sync(there) == []
    here.save("g", made(3.0))
    assert here.sync(there) == ["g"] and {r.value for r in there.load("g").collect()} == {3.0}
    here.delete("f")
    assert [r.name for r in here.catalog().collect()] == ["g"] and there.has("f")
    here.append("f", made(4.0))
    assert {r.value for r in here.load("f").collect()} == {4.0}
    assert {r.value for r in here.cached("f", lambda: made(5.0), 3600).collect()} == {4.0}
    assert {r.value for r in here.cached("f", lambda: made(5.0), -1).collect()} == {5.0}


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = event_bars(stream).writeStream.format("memory").queryName("bars_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("bars_out").collect())) == sorted(map(tuple, event_bars(events).collect()))


FACTOR = "date date, code string, value double"


def factor(spark, *values, first=1):
    return spark.createDataFrame([(dt.date(2024, 1, first + i), "a", v) for i, v in enumerate(values)], FACTOR)


def test_versions_stay_readable_until_pruned(spark, tmp_path):
    store = FactorStore(spark, str(tmp_path))
    of = lambda **k: [r.value for r in store.load("f", **k).orderBy("date").collect()]
    store.save("f", factor(spark, 1.0, 2.0))
    store.append("f", factor(spark, 9.0, 9.0, 3.0))
    store.save("f", factor(spark, 7.0))
    assert [of(version=v) for v in (1, 2, 3)] == [[1.0, 2.0], [1.0, 2.0, 3.0], [7.0]] and of() == [7.0]
    assert [r.version for r in store.versions("f").orderBy("version").collect()] == [1, 2, 3]
    store.delete("f")
    assert not store.has("f") and of(version=2) == [1.0, 2.0, 3.0]
    with pytest.raises(KeyError):
        store.load("f")
    store.append("f", factor(spark, 5.0))
    assert of() == [5.0] and store.catalog().first().version == 5
    assert len(store.prune("f")) == 3 and of() == [5.0] and store.prune("f") == []


def test_a_write_that_fails_before_its_note_changes_nothing(spark, tmp_path, monkeypatch):
    store = FactorStore(spark, str(tmp_path))
    store.save("f", factor(spark, 1.0, 2.0))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(FactorStore, "_note", fails)
        for write in (store.save, store.append):
            with pytest.raises(OSError, match="lost"):
                write("f", factor(spark, 8.0, 8.0, 8.0))
    assert [r.value for r in store.load("f").orderBy("date").collect()] == [1.0, 2.0] and store.catalog().count() == 1
    assert len(store.prune("f")) == 2
    store.append("f", factor(spark, 8.0, 8.0, 3.0))
    assert [r.value for r in store.load("f").orderBy("date").collect()] == [1.0, 2.0, 3.0]


def test_a_batch_is_taken_once(spark, tmp_path):
    store = FactorStore(spark, str(tmp_path))
    store.append("f", factor(spark, 1.0, first=5), batch="q:0")
    store.append("f", factor(spark, 2.0, first=3), batch="q:1")
    store.append("f", factor(spark, 2.0, first=3), batch="q:1")
    assert sorted(r.value for r in store.load("f").collect()) == [1.0, 2.0] and store.catalog().first().version == 2


def test_results_are_kept_by_code_and_content(spark, tmp_path):
    store, calls = FactorStore(spark, str(tmp_path)), []

    def double(df, by=2.0):
        calls.append(by)
        return df.withColumn("value", F.col("value") * by)

    one, same, other = factor(spark, 1.0, 2.0), factor(spark, 1.0, 2.0).repartition(3), factor(spark, 1.0, 3.0)
    values = lambda df: sorted(r.value for r in df.collect())
    twice = lambda df, by=2.0: df.withColumn("value", F.col("value") * by)
    assert values(store.remembered(twice, one)) == [2.0, 4.0]
    assert panels.call_hash(twice, one) == panels.call_hash(twice, same) != panels.call_hash(twice, other)
    assert panels.call_hash(twice, one) != panels.call_hash(twice, one, by=3.0)
    assert panels.call_hash(twice, one) != panels.call_hash(lambda df, by=2.0: df.withColumn("value", F.col("value") - by), one)
    before = store.catalog().count()
    assert values(store.remembered(twice, same)) == [2.0, 4.0] and store.catalog().count() == before
    assert values(store.remembered(twice, one, by=3.0)) == [3.0, 6.0] and store.catalog().count() == before + 1
    assert values(store.remembered(double, one)) == [2.0, 4.0] and calls == [2.0]
    odd = spark.createDataFrame([(1, None, [1.0, None])], "`a.b` int, t string, v array<double>")
    assert panels.content_hash(odd) != panels.content_hash(odd.withColumn("t", F.lit(""))) and panels.content_hash(odd.limit(0)) != panels.content_hash(odd)


def test_running_means_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Rows arrive shuffled within the allowed lateness and some of them twice; later ones are left out."""
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randint(0, 2000)), rng.choice("abc"), float(rng.randint(1, 90))) for i in range(300)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    batch = running_means(spark.createDataFrame(rows + rows[:20], schema), {"m_5": 5, "m_12": 12})
    expected = sorted(tuple(r) for r in batch.collect())
    assert len(expected) == 300
    arriving = sorted(rows + rng.sample(rows, 60), key=lambda r: r[1] + dt.timedelta(minutes=rng.randint(0, 50)))
    files = [arriving[i : i + 130] for i in range(0, len(arriving), 130)] + [[(10_000, start + dt.timedelta(days=90), "end", 1.0)], [(10_001, start, "a", 1e9), (10_002, start + dt.timedelta(days=91), "end", 1.0)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k:02d}"))
    store = FactorStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "k=*"))
    means = running_means(stream, {"m_5": 5, "m_12": 12}, late="1 hour")
    q = to_store(means.select(F.col("ts").alias("date"), F.col("event_type").alias("code"), F.col("m_5").alias("value")), store, "m_5", str(tmp_path / "check"))
    q.awaitTermination()
    text = lambda rows: sorted(f"{ts} {code} {'' if m is None else round(m, 6)}" for ts, code, m in rows)
    assert text(tuple(r) for r in store.load("m_5").filter("code <> 'end'").collect()) == text((ts, code, m) for _, ts, code, _, m, _ in expected)


def test_running_means_of_many_rows_of_one_day_are_summed_by_blocks(spark):
    from tidepanel.operators.scan import span_of

    n = 3 * span_of(1 - 2 / 4)  # some blocks of the shorter mean
    events = spark.range(n).selectExpr("id as event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as ts", "'a' as event_type", "cast(pmod(id * 7919, 1000) as double) as value")
    out = running_means(events, {"m3": 3, "m20": 20})
    found = {r.event_id: (r.m3, r.m20) for r in out.collect()}
    means = [0.0, 0.0]
    for k in range(1, n + 1):
        v = float((k - 1) * 7919 % 1000)
        means = [m + v / p if k <= p else m * (1 - 2 / (p + 1)) + v * (2 / (p + 1)) for m, p in zip(means, (3, 20), strict=True)]
        assert found[k - 1] == tuple(pytest.approx(m, rel=1e-12) if k >= p else None for m, p in zip(means, (3, 20), strict=True))
    # A bucket's rows are never one array, which a fold would copy for each row.
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
