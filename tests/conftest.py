import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pollgauge.session import local_session, release

    session = local_session(cpus=4, shuffle_partitions=4, memory="6g")
    yield session
    release(session)


@pytest.fixture(scope="session")
def status_frame(spark):
    """Build status rows from (feed, station, minute, bikes, docks) tuples."""
    start = 1_767_225_600_000_000

    def build(rows, period=None):
        df = spark.createDataFrame(
            [(f, s, start + int(m * 60_000_000), b, d) for f, s, m, b, d in rows],
            "feed_id string, station_id string, us bigint, num_bikes_available int, num_docks_available int",
        )
        if period is not None:
            from pyspark.sql import functions as F

            df = df.withColumn("period_id", F.lit(period))
        return df

    build.start = start
    return build


@pytest.fixture(scope="session")
def feed_rows():
    """Three stations, sixty polls."""
    return [
        ("f", f"s{s}", i, 5 + (i + s) % 10, 15 - (i + s) % 10) for s in range(3) for i in range(60)
    ]
