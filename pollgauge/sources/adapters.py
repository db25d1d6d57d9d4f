"""Views of the driver tables as feed data.

An area is 240 neighbouring users.  Its readings reach six of its eight stations each,
and its stations form three feeds of one, three and four stations, named alike in every
feed.  So stations and feeds grow with the data, the density of a station stays the same,
and most rows lie in periods long enough for the longest lag.  Polls, logs and documents
need no such density: their feeds are two groups of thirty users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollgauge.config import BIKES, DOCKS, FEED, SECOND_US, STATION, US
from pollgauge.functions.columns import floor_to, hash32, hour_us, micros

USERS_PER_AREA = 240
STATIONS_PER_AREA = 8
REACH = 6  # stations of its area that a reading reaches
USERS_PER_STATION = 30
STATIONS_PER_FEED = 2
CAPACITY = 20
POLL_US = 900 * SECOND_US
ABSENT = "absent"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _group_of_users(size: int) -> Column:
    return F.expr(f"cast(user_id div {size} as string)")


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading at each station that it reaches, with the station's feed."""
    places = F.sequence(F.col("event_id"), F.col("event_id") + (REACH - 1))
    place = F.explode(F.transform(places, lambda p: p % STATIONS_PER_AREA)).alias("place")
    # The first place is a feed, the next three are one, and the last four.
    feed = F.when(F.col("place") == 0, 0).when(F.col("place") < 4, 1).otherwise(2)
    first = F.when(F.col("place") == 0, 0).when(F.col("place") < 4, 1).otherwise(4)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "value", place)
    return rows.select(
        (F.expr(f"user_id div {USERS_PER_AREA}") * 3 + feed).cast("string").alias(FEED),
        (F.col("place") - first).cast("string").alias(STATION), "ts", "value",
    )


def status(spark: SparkSession, sf_dir: str, station: Column | None = None, feed: Column | None = None) -> DataFrame:
    """Quarter-hourly status rows: the fullest reading of the slot, capacity 20."""
    if station is None:
        rows = received(spark, sf_dir)
    else:
        rows = table(spark, sf_dir, "events").select(feed.alias(FEED), station.alias(STATION), "ts", "value")
    bikes = F.least(F.lit(CAPACITY), F.floor(F.max("value") / 5)).cast("int")
    return (
        rows.groupBy(FEED, STATION, floor_to(micros("ts"), POLL_US).alias(US))
        .agg(bikes.alias(BIKES))
        .withColumn(DOCKS, F.lit(CAPACITY) - F.col(BIKES))
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading before the slots are reduced to one row: a slot may come several times."""
    return table(spark, sf_dir, "events").select(
        _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED), _group_of_users(USERS_PER_STATION).alias(STATION),
        floor_to(micros("ts"), POLL_US).alias(US),
    )


def feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per poll of a feed: request time, the feed's own clock, payload hash."""
    request = micros("ts")
    return table(spark, sf_dir, "events").select(
        _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED),
        "event_id",
        request.alias("request_us"),
        (request - (F.floor("value").cast("bigint") * SECOND_US)).alias("last_updated_us"),
        F.md5("event_type").alias("payload_sha256"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every station of the feed, one that never reports, and their capacity."""
    seen = received(spark, sf_dir).select(FEED, STATION).distinct()
    absent = seen.select(FEED, F.concat_ws("-", F.lit(ABSENT), FEED).alias(STATION)).distinct()
    return (
        seen.unionByName(absent)
        .withColumn("name", F.concat(F.lit("Station "), F.col(STATION)))
        .withColumn("capacity", F.lit(CAPACITY))
    )


def typed_counts(df: DataFrame) -> DataFrame:
    """Status rows with a vehicle-type breakdown that is one short on about half of them."""
    short = (hash32("typed", F.col(STATION), F.col(US)) % 2).cast("int")
    return df.withColumn("bike", F.col(BIKES) - short).withColumn("ebike", F.lit(0)).withColumn(
        "ebike_with_childseat", F.lit(None).cast("int")
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly weather: mean value as temperature, count as rain; one hour in seven is missing."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour_us(micros("ts")).alias("hour_us"))
        .agg(F.avg("value").alias("temp_c"), F.count(F.lit(1)).cast("double").alias("precip_mm"))
        .filter(hash32("weather", F.col("hour_us")) % 7 != 0)
    )


def acquisition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collector's log: one line per poll, with the error text in the hash column."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("ts"),
        F.when(failed, "ERROR").otherwise("200").alias("status"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        (F.floor("value") * 100).cast("int").alias("bytes"),
        F.when(failed, F.lit(None)).otherwise(F.lit(300) + F.col("user_id") % 20).cast("int").alias("n_stations"),
        F.when(failed, F.concat(F.lit("Timeout"), F.col("user_id") % 3, F.lit(": no answer")))
        .otherwise(F.substring(F.md5("event_type"), 1, 16))
        .alias("sha16"),
        "event_id",
        micros("ts").alias(US),
        _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED),
    )


def station_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset between the feed's clock (end of slot) and the station's last report, in seconds."""
    slot = floor_to(micros("ts"), POLL_US)
    last = F.max(micros("ts"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED),
            _group_of_users(USERS_PER_STATION).alias(STATION),
            slot.alias(US),
        )
        .agg(last.alias("_last"))
        .select(FEED, STATION, US, F.floor((F.col(US) + POLL_US - F.col("_last")) / 1_000_000).alias("offset_s"))
    )


def snapshot_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly snapshots of each feed as JSON texts; some repeat the last state, some are cut off."""
    feed = _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED)
    bikes = F.least(F.lit(CAPACITY), F.floor(F.max("value") / 5)).cast("int")
    rows = (
        table(spark, sf_dir, "events")
        .groupBy(feed, _group_of_users(USERS_PER_STATION).alias(STATION), hour_us(micros("ts")).alias(US))
        .agg(bikes.alias(BIKES), F.floor(F.max(micros("ts")) / SECOND_US).alias("last_reported"))
    )
    entry = F.struct(STATION, BIKES, (F.lit(CAPACITY) - F.col(BIKES)).alias(DOCKS), "last_reported")
    # A snapshot document holds the stations of one feed, two here.
    docs = rows.groupBy(FEED, US).agg(F.sort_array(F.collect_list(entry)).alias("stations"))
    late = F.when(hash32("late", F.col(FEED), F.col(US)) % 5 == 0, 3600).otherwise(0)
    updated = ((F.col(US) / SECOND_US).cast("bigint") - late).alias("last_updated")
    docs = docs.select(
        FEED,
        F.date_format(F.timestamp_micros(F.col(US) + 7 * SECOND_US), "yyyyMMdd'T'HHmmss'Z'").alias("request"),
        updated,
        F.struct("stations").alias("data"),
        (hash32("cut", F.col(FEED), F.col(US)) % 50 == 0).alias("cut"),
    )
    text = F.to_json(F.struct("last_updated", "data"))
    return docs.withColumn("value", F.when(F.col("cut"), F.substring(text, 1, 40)).otherwise(text))


def poll_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the hourly polls, with their request names."""
    feed = _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED)
    polls = table(spark, sf_dir, "events").groupBy(feed, hour_us(micros("ts")).alias(US)).agg(
        F.count(F.lit(1)).alias("n")
    )
    failed = hash32("fail", F.col(FEED), F.col(US)) % 10 == 0
    return polls.select(
        FEED,
        F.date_format(F.timestamp_micros(F.col(US) + 7 * SECOND_US), "yyyyMMdd'T'HHmmss'Z'").alias("ts"),
        F.when(failed, "ERROR").otherwise("200").alias("status"),
        F.lit(120).alias("latency_ms"),
        (F.col("n") * 100).cast("int").alias("bytes"),
        F.lit(STATIONS_PER_FEED).alias("n_stations"),
        F.when(failed, "Timeout: no answer").otherwise(F.substring(F.md5(F.col("n").cast("string")), 1, 16)).alias("sha16"),
    )


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily station lists as JSON texts: the stations seen that day."""
    feed = _group_of_users(USERS_PER_STATION * STATIONS_PER_FEED).alias(FEED)
    day = F.date_format(F.timestamp_micros(micros("ts")), "yyyyMMdd").alias("day")
    seen = (
        table(spark, sf_dir, "events")
        .select(feed, _group_of_users(USERS_PER_STATION).alias(STATION), day)
        .distinct()
    )
    entry = F.struct(STATION, F.concat(F.lit("Station "), STATION, F.lit(" "), "day").alias("name"), F.lit(CAPACITY).alias("capacity"))
    docs = seen.groupBy(FEED, "day").agg(F.sort_array(F.collect_list(entry)).alias("stations"))
    return docs.select(
        FEED, F.concat("day", F.lit("T000000Z")).alias("request"), F.to_json(F.struct(F.struct("stations").alias("data"))).alias("value")
    )


def answers(flagged: DataFrame) -> DataFrame:
    """Replies to every flagged row under each condition and configuration; some are malformed."""
    spots = flagged.filter("jump_flag").select(
        F.concat_ws("-", FEED, STATION, US).alias("scenario_id"), F.col(BIKES).alias("b"), F.col(DOCKS).alias("d")
    )
    cells = (
        spots.withColumn("model", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
        .withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in ("clean", "corrupted", "corrupted_flagged")])))
        .withColumn("config", F.explode(F.array(F.lit("blind"), F.lit("aware"))))
    )
    h = hash32("answer", *[F.col(c) for c in ("model", "rep", "scenario_id", "condition", "config")])
    cells = cells.withColumn("h", h).withColumn("p", hash32("p", F.col("scenario_id")) % 100)
    odd = F.col("h")
    decision = F.when(odd % 11 == 0, "maybe").when(odd % 3 == 0, "dispatch").when(odd % 3 == 1, "no_dispatch").otherwise("abstain")
    warning = F.when(odd % 17 == 0, '"true"').when(F.expr("(h div 3) % 2") == 1, "true").otherwise("false")
    share = F.concat(F.lit("0."), F.lpad(F.col("p").cast("string"), 2, "0"))
    why = F.when(odd % 7 == 0, "about 40.5 bikes").otherwise(
        F.concat(F.lit("Probability "), share, F.lit(" ("), F.col("p"), F.lit("%) with bikes "), F.col("b"))
    )
    body = F.concat(
        F.lit('{"decision": "'), decision, F.lit('", "data_quality_warning": '), warning, F.lit(', "rationale": "'), why, F.lit('"}')
    )
    reply = F.when(odd % 13 == 0, "I cannot decide.").when(
        odd % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    ).otherwise(body)
    drawn = hash32("flip", F.col("scenario_id"))
    return cells.select(
        "model", "rep", "scenario_id", "condition", "config", (drawn % 2 == 0).alias("flip"),
        F.when(drawn % 3 == 0, "dispatch").otherwise("no_dispatch").alias("true_decision"),
        F.concat(F.lit("bikes "), F.col("b"), F.lit(" docks "), F.col("d"), F.lit(" p = "), share).alias("tool_output"),
        reply.alias("reply"),
    )


def cell_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicates in a two-factor layout: factor a (5) x factor b (4) x replicate (5)."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("class"),
            (F.col("user_id") % 4).cast("int").alias("intensity_idx"),
            (F.expr("user_id div 4") % 5).cast("int").alias("seed"),
        )
        .agg(
            F.round(F.avg("value"), 6).alias("delta_cost"),
            F.round(F.avg(F.col("value") * (F.expr("event_id % 3") / F.lit(3.0))), 6).alias("delta_cost_recovered"),
        )
    )
