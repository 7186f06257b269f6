"""Expiry by partition names: folders go, only the border is read."""

from datetime import datetime, timezone

import pytest

from lumenads.schemas import DAY_PARTITION, HOUR_PARTITION, struct_of
from lumenads.sources.files import expire_before, scan_hive_parquet, write_partitioned

SHAPE = struct_of("id string, timestamp bigint")


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


@pytest.fixture
def root(spark, tmp_path):
    times = [(2025, 12, 31, 23), (2026, 1, 1, 0), (2026, 1, 2, 3), (2026, 1, 2, 4), (2026, 1, 2, 5), (2026, 1, 10, 0)]
    rows = [(f"{k}", ms(*t), f"{t[0]}", f"{t[1]:02d}", f"{t[2]:02d}", f"{t[3]:02d}") for k, t in enumerate(times)]
    rows.append(("none", None, "2026", "01", "02", "04"))
    df = spark.createDataFrame(rows, "id string, timestamp long, year string, month string, day string, hour string")
    write_partitioned(df, str(tmp_path / "hours"))
    write_partitioned(df.drop("hour"), str(tmp_path / "days"), DAY_PARTITION)
    return tmp_path


def ids(spark, path, partitions):
    return sorted(r.id for r in scan_hive_parquet(spark, str(path), SHAPE, partitions).collect())


def test_days(spark, root):
    far = root / "days" / "year=2026" / "month=01" / "day=10"
    kept = sorted(p.name for p in far.iterdir())
    assert expire_before(spark, f"{root}/days", SHAPE, "2026-01-02 04:00:00", partitions=DAY_PARTITION) == {"dropped": 2, "border": 1}
    assert ids(spark, root / "days", DAY_PARTITION) == ["3", "4", "5"]
    assert sorted(p.name for p in far.iterdir()) == kept and not (root / "days" / "year=2025" / "month=12" / "day=31").exists()
    assert expire_before(spark, f"{root}/days", SHAPE, "2026-01-02 04:00:00", partitions=DAY_PARTITION) == {"dropped": 0, "border": 1}
    assert ids(spark, root / "days", DAY_PARTITION) == ["3", "4", "5"]


def test_hours_on_a_whole_hour(spark, root):
    assert expire_before(spark, f"{root}/hours", SHAPE, "2026-01-02 04:00:00") == {"dropped": 3, "border": 1}
    assert ids(spark, root / "hours", HOUR_PARTITION) == ["3", "4", "5"]


def test_border_without_rows_goes(spark, root):
    assert expire_before(spark, f"{root}/hours", SHAPE, "2026-01-02 05:30:00") == {"dropped": 4, "border": 1}
    assert ids(spark, root / "hours", HOUR_PARTITION) == ["5"]
    assert not (root / "hours" / "year=2026" / "month=01" / "day=02" / "hour=05").exists()


def test_other_folders_stay(spark, root):
    odd = root / "hours" / "year=__HIVE_DEFAULT_PARTITION__" / "month=01" / "day=01" / "hour=00"
    odd.mkdir(parents=True)
    assert expire_before(spark, f"{root}/hours", SHAPE, "2020-01-01 00:00:00") == {"dropped": 0, "border": 0}
    assert odd.exists() and len(ids(spark, root / "hours", HOUR_PARTITION)) == 7
