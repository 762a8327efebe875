"""Streams over several runs: what is late, what expires, and where a run goes on."""

import json
from datetime import datetime, timedelta

from citemill.sources import readers
from citemill.streaming import state

DAY0 = datetime(2024, 1, 1)


def _rows(spark, folder, batch, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{batch}")


def _run(spark, folder, make, schema):
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    q = make(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def test_cache_entries_expire(spark, tmp_path):
    """Hits up to the last microsecond of an entry's life; expired entries leave the state; lookups behind the watermark are left out."""
    folder, schema = f"file://{tmp_path}", "id long, ts timestamp, doi string"
    make = lambda rows: state.cache_lookups(rows, "doi", 21, "1 day")
    at = lambda days, micros=0: DAY0 + timedelta(days=days, microseconds=micros)
    batches = [
        [(1, at(0), "a"), (3, at(21, 1), "a"), (2, at(21), "a"), (4, at(5), "b")],
        [(5, at(22), "a"), (6, at(60), "c"), (7, at(1), "b")],  # 7 is late
        [(8, at(61), "a"), (9, at(62), "b"), (10, at(63), "c")],
    ]
    with state.keyed_state(spark):
        for i, rows in enumerate(batches):
            _rows(spark, tmp_path, i, rows, schema)
            _run(spark, folder, make, schema)
    got = {r.id: r.hit for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 8: False, 9: False, 10: True}


def test_waves_end_once(spark, tmp_path):
    """A wave goes on over batches while calls come within the gap, and comes out once; a call behind the watermark is left out."""
    folder, schema = f"file://{tmp_path}", "user_id long, ts timestamp, cost double"
    make = lambda rows: state.waves(rows, "user_id", "30 minutes", "1 hour")
    at = lambda minutes: DAY0 + timedelta(minutes=minutes)
    batches = [[(1, at(0), 1.0), (1, at(29), 1.0), (2, at(5), 1.0)], [(1, at(50), 1.0), (1, at(200), 1.0)], [(2, at(10), 9.0), (1, at(231), 1.0), (3, at(600), 1.0)], [(3, at(900), 1.0)]]
    for i, rows in enumerate(batches):
        _rows(spark, tmp_path, i, rows, schema)
        _run(spark, folder, make, schema)
    got = sorted((r.key, int((r.start - DAY0).total_seconds() // 60), r.calls, r.cost) for r in spark.read.parquet(f"{folder}/out").collect())
    assert got == [(1, 0, 3, 3.0), (1, 200, 1, 1.0), (1, 231, 1, 1.0), (2, 5, 1, 1.0), (3, 600, 1, 1.0)]


def test_landed_pages_are_read_once(spark, tmp_path):
    """A second run reads only what has landed since; one without news reads nothing; an empty folder is no error."""
    spark.dataSource.register(readers.landing_source())
    (tmp_path / "in").mkdir()

    def run():
        q = spark.readStream.format("landing_works").option("folder", f"{tmp_path}/in").load().writeStream.format("parquet")
        q = q.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return [p.numInputRows for p in q.recentProgress if p.numInputRows]

    def land(*names):
        for n in names:
            (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"results": [{"id": n, "title": n}]}))

    assert run() == []
    land("001", "002")
    assert sum(run()) == 2
    land("003")
    assert sum(run()) == 1 and sum(run()) == 0
    out = spark.read.schema("name string, body string").parquet(f"{tmp_path}/out")
    assert sorted(r.name for r in out.collect()) == ["001.json", "002.json", "003.json"]
    assert sorted(r.title for r in readers.works_from_json(out, "body").collect()) == ["001", "002", "003"]
