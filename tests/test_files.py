import numpy as np
import pytest

from tidemill.sources import files


def points(n, step=1000):
    i = np.arange(n)
    return i * step, i.astype(float)


def test_round_trip_and_index():
    t, v = 10**9 + np.arange(2500) * 10**6, 25 + 0.01 * np.arange(2500)
    data = files.block_file(t, v)
    assert [count for *_, count in files.block_index(data)[1]] == [1024, 1024, 452]
    a, b = files.read_block_file(data)
    assert a.tolist() == t.tolist() and b.view(np.uint64).tolist() == v.view(np.uint64).tolist()


def test_range_reads_only_its_blocks():
    t, v = points(5000)
    assert len(files.read_block_file(files.block_file(t, v), 1_000_000, 2_000_000)[0]) == 1001
    assert len(files.read_block_file(files.block_file(t, v), 10, 5)[0]) == 0


def test_bad_files():
    with pytest.raises(ValueError, match="magic"):
        files.read_block_file(bytes(100))
    with pytest.raises(ValueError, match="short"):
        files.read_block_file(b"")
    data = bytearray(files.block_file(*points(10)))
    data[40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        files.read_block_file(bytes(data))
    assert len(files.block_file([], [])) == 56


def test_log_replays_the_valid_start():
    rows = [(1000 * k, 25.5 + k) for k in range(5)]
    data = b"".join(files.log_record(*r) for r in rows)
    assert files.replay(data) == rows
    assert files.replay(data[:-10]) == rows[:4]
    broken = bytearray(data)
    broken[30] ^= 1
    assert files.replay(bytes(broken)) == rows[:1]
    assert files.replay(b"") == []


def test_readers(spark, tmp_path):
    t, v = points(3000)
    (tmp_path / "a.sst").write_bytes(files.block_file(t, v))
    (tmp_path / "b.sst").write_bytes(files.block_file(t + 10**8, v))
    assert files.read_block_files(spark, str(tmp_path), 5000, 9000).count() == 5
    assert files.read_block_files(spark, str(tmp_path)).count() == 6000
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/wal.bin").write_bytes(b"".join(files.log_record(k, k / 2) for k in range(7)) + b"torn")
    assert [tuple(r) for r in files.read_logs(spark, str(tmp_path / "logs")).orderBy("seq").collect()] == [(k, k / 2, k) for k in range(7)]


def test_log_on_disk(spark, tmp_path):
    log = files.Log(str(tmp_path / "data"))
    log.append(1000, 25.5)
    log.sync()
    log.append(2000, 26.0)
    log.close()
    again = files.Log(f"file://{tmp_path}/data")  # opened again, it goes on where it ended
    again.append(3000, 24.8)
    again.sync()
    assert files.replay((tmp_path / "data/wal.bin").read_bytes()) == [(1000, 25.5), (2000, 26.0), (3000, 24.8)]
    assert files.read_logs(spark, str(tmp_path / "data")).count() == 3
    again.discard()
    assert not (tmp_path / "data/wal.bin").exists()


def test_block_file_sink_and_ranges(spark, tmp_path):
    t, v = points(5000)
    frame = spark.createDataFrame(list(zip(t.tolist(), v.tolist(), strict=True)), "timestamp long, value double").repartition(3)
    folder = f"file://{tmp_path}/out"
    n = files.write_block_files(frame, folder, per_file=700)
    names = sorted(x.name for x in (tmp_path / "out").iterdir() if not x.name.startswith("."))
    assert names == [f"{k:06}.sst" for k in range(1, n + 1)] and n >= 8
    assert sorted(map(tuple, files.read_block_files(spark, folder).collect())) == list(zip(t.tolist(), v.tolist(), strict=True))
    assert files.read_block_files(spark, folder, 1_000_000, 2_000_000).count() == 1001
    assert files.read_block_files(spark, folder, 10, 5).count() == 0
    firsts = [files.read_block_file((tmp_path / "out" / x).read_bytes())[0][0] for x in names]
    assert firsts == sorted(firsts)
    assert files.write_block_files(frame.where("false"), f"{folder}-empty") == 0


def test_a_range_reads_no_more_than_it_needs(tmp_path):
    import pyarrow.fs

    t, v = points(50_000)
    (tmp_path / "a.sst").write_bytes(files.block_file(t, v))
    fs, path = files.opened(str(tmp_path / "a.sst"))
    size, read = fs.get_file_info(path).size, []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

    with fs.open_input_file(path) as file:
        found = files.read_block_file_range(Counted(file), size, 20_000_000, 20_100_000)
    assert found[0].tolist() == t[20_000:20_101].tolist() and sum(read) < size / 15
    read.clear()
    with fs.open_input_file(path) as file:
        assert len(files.read_block_file_range(Counted(file), size, 10**12, None)[0]) == 0
    assert sum(read) == 32  # the header
    assert isinstance(fs, pyarrow.fs.LocalFileSystem)
