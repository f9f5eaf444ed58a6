import pytest

from tests.compare import differences
from tidemill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, small, name):
    ours, theirs, _ = differences(catalogue.QUERIES[name](spark, small), catalogue.ORACLES[name], small)
    assert (ours, theirs) == ([], [])


def test_record_crc(spark):
    assert spark.sql("select crc32(cast('123456789' as binary))").first()[0] == 3421780262


DAY_START, DAY_END = "timestamp_ntz'2024-01-05 00:00:00'", "timestamp_ntz'2024-01-06 00:00:00'"


@pytest.mark.parametrize(
    ("rows", "found"),
    [
        ([(0, DAY_START, 1), (1, DAY_START, 1), (2, DAY_START, 2), (3, DAY_END, 3), (4, f"{DAY_END} + interval 1 microsecond", 4)], 4),  # events of one time
        ([(1, DAY_START, 1), (1, DAY_START, 1)], 2),  # one event twice
        ([(-1, DAY_START, 3), (-2, DAY_END, 4)], 2),  # ids below zero
        ([("null", DAY_START, 5), (1, DAY_END, 6)], 2),  # no id
        ([(1, "null", 7), (2, "null", 7), (3, DAY_END, 8)], 1),  # no time
    ],
)
def test_table_range_has_all_events(spark, tmp_path, rows, found):
    one = "select cast({} as bigint) as event_id, cast({} as timestamp_ntz) as ts, cast({} as double) as value"
    spark.sql(" union all ".join(one.format(*r) for r in rows)).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "events.parquet")
    ours, theirs, n = differences(catalogue.QUERIES["table_range"](spark, str(tmp_path)), catalogue.ORACLES["table_range"], str(tmp_path))
    assert (ours, theirs, n) == ([], [], found)
