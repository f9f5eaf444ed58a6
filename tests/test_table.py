import pytest

from tidemill.operators import lww, series
from tidemill.schema import POINT_SEQ
from tidemill.sources.manifest import Conflict, Snapshot, Store
from tidemill.sources.table import Table


def rows(df):
    return [tuple(r) for r in df.collect()]


def batch(spark, pairs):
    return spark.createDataFrame([(t, float(v), k) for k, (t, v) in enumerate(pairs)], POINT_SEQ)


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}/t", capacity=1 << 20)


def test_pending_and_stored_points_are_one_series(spark, table):
    table.write_batch(batch(spark, [(i * 1000, i) for i in range(50)]))
    table.flush()
    table.write_batch(batch(spark, [(i * 1000, i) for i in range(50, 100)]))
    found = rows(table.scan_range(25_000, 75_000))
    assert len(found) == 51 and found[0] == (25_000, 25.0) and found[-1] == (75_000, 75.0)
    assert rows(table.scan_range(10, 5)) == []
    assert table.pending_count() == 50 and table.run_count() == 1


def test_newest_write_wins_before_and_after_compaction(spark, table):
    table.write_batch(batch(spark, [(100, 1), (200, 1), (200, 2)]))
    table.flush()
    table.write_batch(batch(spark, [(150, 3), (100, 5)]))
    table.flush()
    table.write(150, 9.0)
    want = [(100, 5.0), (150, 9.0), (200, 2.0)]
    assert rows(table.scan_all()) == want
    table.compact()
    assert table.run_count() == 1 and rows(table.scan_all()) == want
    assert rows(Table(spark, table.path).scan_all()) == want


def test_full_memtable_is_flushed_and_runs_are_compacted(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", capacity=128)
    for k in range(5):
        table.write_batch(batch(spark, [(k * 2000 + j * 1000, k) for j in range(2)]))
    assert table.run_count() < 4 and len(rows(table.scan_all())) == 10


def test_a_run_that_was_not_committed_is_invisible(spark, table):
    table.write_batch(batch(spark, [(1, 1)]))
    table.flush()
    table.write_batch(batch(spark, [(2, 2)]))
    table.flush()
    want = rows(table.scan_all())
    snapshot = table.store.read()
    table._store_run(lww.merged(table.runs(snapshot)), snapshot)  # as if the writer stopped here
    assert rows(table.scan_all()) == want and table.run_count() == 2
    table.compact()
    assert rows(table.scan_all()) == want


def test_one_of_two_writers_loses(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/m")
    store.commit(Snapshot())
    with pytest.raises(Conflict):
        store.commit(Snapshot())
    assert store.read().version == 1


def test_nulls_are_refused(spark, table):
    with pytest.raises(Exception, match="null in column"):
        table.write_batch(spark.sql("select 1L as timestamp, cast(null as double) as value, 1L as seq"))


def test_streaming_batches_are_committed_once(spark, table, tmp_path):
    from tidemill.streaming.ingest import ingest

    source = tmp_path / "in"
    spark.createDataFrame([(i % 60, float(i), i) for i in range(100)], POINT_SEQ).write.parquet(str(source))
    stream = lambda: spark.readStream.schema(POINT_SEQ).parquet(str(source))
    ingest(stream(), table, str(tmp_path / "checkpoint")).awaitTermination()
    want = [(t, float(t + 60 if t < 40 else t)) for t in range(60)]
    assert rows(table.scan_all()) == want and table.run_count() == 1
    # Run again from the start, as after a stop between the two commits.
    ingest(stream(), table, str(tmp_path / "other")).awaitTermination()
    assert table.run_count() == 1 and rows(table.scan_all()) == want


def test_array_kernels(spark):
    from pyspark.sql import functions as F

    data = spark.createDataFrame([([i * 1_000_000 + 3 * i * i for i in range(50)],), ([1, 2],), ([1],), ([],)], "a array<long>")
    d, dd, x = (rows(data.select(f(F.col("a")))) for f in (series.array_delta, series.array_delta_of_delta, series.array_xor))
    assert [len(r[0]) for r in d] == [49, 1, 0, 0] and set(dd[0][0]) == {6} and [len(r[0]) for r in dd] == [48, 0, 0, 0]
    assert x[1][0] == [3] and x[2][0] == x[3][0] == []


@pytest.mark.parametrize("width", [7, 1000, 10**9])
def test_series_operators_do_not_depend_on_slots(spark, width):
    t = sorted({(k * k * 37) % 5003 - 2500 for k in range(120)})
    df = spark.createDataFrame([(x, float(x)) for x in t], "timestamp long, value double")
    assert sorted(rows(series.delta(df, width=width))) == [(b, b - a) for a, b in zip(t, t[1:], strict=False)]
    assert sorted(rows(series.delta_of_delta(df, width))) == [(t[k], t[k] - 2 * t[k - 1] + t[k - 2]) for k in range(2, len(t))]
    assert sorted(rows(series.ranked(df, width).select("timestamp", "rank"))) == list(zip(t, range(len(t)), strict=True))
    assert sorted(rows(series.running_sum(df, "timestamp", width).select("timestamp", "running")))[-1][1] == sum(t)


def test_a_folder_of_files_becomes_a_table(spark, tmp_path):
    from tidemill.sources import files

    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "000001.sst").write_bytes(files.block_file([100, 200, 300], [1.0, 2.0, 3.0]))
    (folder / "000010.sst").write_bytes(files.block_file([200, 400], [20.0, 40.0], version=1))
    (folder / "000009.sst").write_bytes(files.block_file([200, 300], [9.0, 9.0]))
    (folder / "wal.bin").write_bytes(b"".join(files.log_record(*r) for r in ((400, 1.0), (400, 41.0), (50, 5.0))) + b"torn")
    table = Table.from_folder(spark, f"file://{folder}", f"file://{tmp_path}/t")
    assert rows(table.scan_all()) == [(50, 5.0), (100, 1.0), (200, 20.0), (300, 9.0), (400, 41.0)]
    assert table.run_count() == 1 and table.pending_count() == 2
    assert rows(Table.from_folder(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/u").scan_all()) == []


def test_fill_is_counted_when_it_may_be_reached(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", capacity=64 * 10)
    for k in range(4):
        table.write_batch(batch(spark, [(j, k) for j in range(4)]))  # four timestamps, again and again
    assert table.run_count() == 0 and table.pending_count() == 4
    table.write_batch(batch(spark, [(100 + j, 1) for j in range(6)]))
    assert table.run_count() == 1 and table.pending_count() == 0
    assert table.store.names(f"{table.path}/fill") == [] and table.store.read().consumed == (1, 2, 3, 4, 5)
    table.write_batch(batch(spark, [(100 + j, 2) for j in range(10)]))
    assert table.store.read().consumed == (6,) and len(rows(table.scan_all())) == 14


def test_readers_keep_their_runs_for_a_time(spark, tmp_path):
    for grace, left in ((3600, 3), (0, 1)):
        table = Table(spark, f"file://{tmp_path}/{grace}", grace=grace)
        for k in range(2):
            table.write_batch(batch(spark, [(k, k)]))
            table.flush()
        before = table.scan_all()
        table.compact()
        assert len(table.store.names(f"{table.path}/runs")) == left
        assert rows(table.scan_all()) == [(0, 0.0), (1, 1.0)]
        if grace:
            assert rows(before) == [(0, 0.0), (1, 1.0)]
        else:
            assert len(table.store.versions()) == 1


def test_slots_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(series, "SLOT_ROWS", 500)
    for t in ([1_700_000_000 + k for k in range(6000)], [k * k * k for k in range(6000)], [7] + [10**15 + k for k in range(6000)]):
        df = spark.createDataFrame([(x,) for x in t], "timestamp long")
        sizes = [r["n"] for r in series.slotted(df, series.slot_of(df)).groupBy(series.SLOT).agg({"timestamp": "count"}).toDF("slot", "n").collect()]
        assert sum(sizes) == len(t) and len(sizes) >= 8 and max(sizes) <= 1500
        assert sorted(rows(series.delta(df))) == [(b, b - a) for a, b in zip(t, t[1:], strict=False)]
        assert sorted(rows(series.ranked(df).select("timestamp", "rank"))) == list(zip(t, range(len(t)), strict=True))
    assert rows(series.delta(df.where("false"))) == []


def test_nulls_and_empty_tables(spark):
    from tidemill.operators import blocks, coded

    data = [(1, 1.0, 1), (None, 5.0, 2), (3, None, 3), (3, 2.0, None), (4, 4.0, 4), (None, None, None)]
    df = spark.createDataFrame(data, "timestamp long, value double, seq long")
    assert sorted(rows(lww.newest(df.where("timestamp is not null"), "seq")), key=str) == [(1, 1.0), (3, None), (4, 4.0)]
    assert lww.newest(df, "seq").where("timestamp is null").count() == 1
    assert rows(lww.between(df, 0, 9).select("timestamp").distinct().orderBy("timestamp")) == [(1,), (3,), (4,)]
    assert rows(lww.distinct_count(df, 192, 64)) == [(3, True, False)]
    one = df.where("timestamp is null or seq is not null")
    assert sorted(rows(series.delta(one))) == [(3, 2), (4, 1)]
    assert sorted(rows(series.running_sum(one, "timestamp").select("timestamp", "running"))) == [(1, 1), (3, 4), (4, 8)]
    assert rows(blocks.index(one)) == [(0, 1, 4, 3)] and rows(blocks.dod_bits(one)) == [(0, 64 + 64 + 9)]
    back = sorted(rows(coded.decode(coded.encode(one))))
    assert [t for t, _ in back] == [1, 3, 4] and back[0][1] == 1.0 and back[1][1] != back[1][1] and back[2][1] == 4.0
    empty = df.where("false")
    assert [x.count() for x in (lww.newest(empty, "seq"), series.delta(empty), series.delta_of_delta(empty), blocks.index(empty), blocks.dod_bits(empty), coded.decode(coded.encode(empty)))] == [0] * 6
    assert rows(blocks.header(empty)) == [(None, None, 0, 0)]


def test_a_table_with_repeats_keeps_every_write(spark, tmp_path):
    path, want = f"file://{tmp_path}/t", [(1, 2.0), (1, 2.0), (1, 3.0), (2, 1.0), (2, 1.0)]
    table = Table(spark, path, repeats=True)
    table.write_batch(batch(spark, [(1, 3), (1, 2), (2, 1)]))
    assert table.pending_count() == 3
    table.flush()
    table.write_batch(batch(spark, [(2, 1), (1, 2)]))
    assert rows(table.scan_all()) == want and rows(table.scan_range(2, 9)) == want[3:]
    table.flush()
    again = Table(spark, path)  # is still a table of that kind
    again.compact()
    assert again.run_count() == 1 and rows(again.scan_all()) == want
    assert again.add_run(batch(spark, [(2, 0), (2, 0)]), "q", 0) and rows(again.scan_range(2, 2)) == [(2, 0.0), (2, 0.0), *want[3:]]
    full = Table(spark, f"file://{tmp_path}/full", capacity=64 * 4, repeats=True)
    for k in range(2):
        full.write_batch(batch(spark, [(7, 1), (7, 1)]))
        assert full.run_count() == k
    unique = Table(spark, f"file://{tmp_path}/u")
    unique.write(1, 1.0)
    unique.flush()
    with pytest.raises(ValueError, match="one point"):
        Table(spark, unique.path, repeats=True)
