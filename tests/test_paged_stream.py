"""The streaming source over pages landed from the events table: restarts, failures, no repeats."""

import json

import pytest
from pyspark.sql import functions as F

from mergewell.sources import paged_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture
def landed(spark, tmp_path):
    """(folder, events as (second, id), a function that lets the provider come as far as a place)."""
    paged_stream.register(spark)
    e = spark.read.parquet(f"{SF}/events.parquet").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "event_id").orderBy("s", "event_id").limit(500)
    rows = [tuple(r) for r in e.collect()]
    (tmp_path / "events.json").write_text(json.dumps(rows))
    (tmp_path / "now").write_text("0")
    return tmp_path, rows, lambda place: (tmp_path / "now").write_text(str(place))


def stream(spark, folder, **options):
    reader = spark.readStream.format("paged_stream").option("folder", str(folder)).option("newest", options.pop("newest", "tests.provider:newest"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def drain(df, folder, name="c"):
    """Runs what there is to its end, into a folder."""
    rows = df.select("page", "after", F.explode(F.from_json("body", "array<array<long>>")).alias("r"))
    rows = rows.select(F.timestamp_seconds(F.col("r")[0]).alias("played_at"), F.col("r")[1].alias("id"), "after")
    rows = paged_stream.within(rows) if "numbered" in name else rows
    q = rows.writeStream.format("parquet").option("path", str(folder / f"out-{name}")).option("checkpointLocation", str(folder / f"check-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(r.id for r in df.sparkSession.read.schema("played_at timestamp, id long").parquet(str(folder / f"out-{name}")).collect())


def test_a_stream_by_time_goes_on_where_it_stopped(spark, landed):
    folder, rows, come_to = landed
    ids = lambda a, b: sorted(i for s, i in rows if a < s <= b)
    first, second, last = rows[130][0], rows[300][0], rows[-1][0]
    make = lambda: stream(spark, folder, fetch="tests.provider:by_time", lanes="3")
    come_to(first)
    assert drain(make(), folder, "numbered") == ids(0, first)
    calls = [json.loads(x) for x in (folder / "calls").read_text().splitlines()]
    assert all((page == 1) == (start is not None) for page, start, _ in calls)  # only first pages are bounded below
    come_to(second)
    (folder / "down").touch()
    with pytest.raises(Exception, match="404"):
        drain(make(), folder, "numbered")
    (folder / "down").unlink()
    come_to(last)  # the provider has gone on before the stream comes back
    assert drain(make(), folder, "numbered") == ids(0, last)
    assert drain(make(), folder, "numbered") == ids(0, last)  # nothing new, nothing twice


def test_a_stream_begins_where_it_is_told(spark, landed):
    folder, rows, come_to = landed
    begin, end = rows[20][0], rows[300][0]
    make = lambda: stream(spark, folder, fetch="tests.provider:by_time", **{"from": str(begin)})
    come_to(rows[10][0])
    assert drain(make(), folder, "numbered") == []
    come_to(end)
    assert drain(make(), folder, "numbered") == sorted(i for s, i in rows if begin < s <= end)


def test_streams_by_offset_and_cursor(spark, landed):
    folder, rows, come_to = landed
    for place in (90, 90, 333):
        come_to(place)
        assert drain(stream(spark, folder, fetch="tests.provider:by_offset", paging="offset", limit="40"), folder, "offset") == sorted(i for _, i in rows[:place])
    for place in (90, 500):
        come_to(place)
        got = drain(stream(spark, folder, fetch="tests.provider:by_cursor", paging="cursor", newest="tests.provider:last_cursor"), folder, "cursor")
        assert got == sorted(i for _, i in rows[: place // 40 * 40])
