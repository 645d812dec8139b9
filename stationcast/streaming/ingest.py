"""The hourly ingest as a stream: landed payloads -> readings -> keyed table.

Nothing that lands is lost. Air and weather hours that land within ``WAIT`` of each other meet in a stream join. An hour
whose partner has not come by then leaves the join alone and goes to the quarantine table, where it meets its partner
when that one leaves the join in turn, however late.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from stationcast import schema as S
from stationcast.plans.ingest import feed_readings, merged_readings
from stationcast.session import materialize, remove, scratch_path
from stationcast.sources import manifest as M
from stationcast.sources import payloads
from stationcast.sources.manifest import EVENT_DATE, Batch
from stationcast.sources.tables import VERSION, table_path, upsert_features

DELAY = "2 hours"
#: How long after one payload has landed its partner may land.
WAIT = "2 days"


def stream_feed(spark: SparkSession, landing: str, now: Column | None = None) -> DataFrame:
    """Station-feed envelopes as they land, one reading per accepted envelope."""
    envelopes = spark.readStream.schema(S.ENVELOPE).json(landing)
    return feed_readings(payloads.accepted(envelopes), now)


def _landed_hours(spark: SparkSession, folder: str, arrays: dict[str, str], parse, landed: Column | None,
                  files: int | None) -> DataFrame:
    landing = spark.readStream.schema(S.hourly_schema(arrays))
    landing = landing if files is None else landing.option("maxFilesPerTrigger", files)
    # Reading time by default: it never goes back, so no file is late, and files that lie there together meet.
    landed = F.current_timestamp() if landed is None else landed
    return parse(landing.json(folder).withColumn("landed", landed), ("landed",))


def stream_pairs(spark: SparkSession, air: str, weather: str, wait: str = WAIT, landed: Column | None = None,
                 files: int | None = None) -> DataFrame:
    """Hours (city, time, air, weather) as they land; ``air`` and ``weather`` are structs with the measures and ``landed``.

    An hour waits ``wait`` for its partner, whatever its own time is; then it comes out with the other side null. The
    watermark follows the time at which payloads are read, or ``landed`` of the payload's file, such as its modification
    time; a file whose time is more than ``wait`` behind the newest one would then be late. Neither side comes out
    alone while the other's folder is silent: its watermark stands still. ``files`` bounds a micro-batch.
    """
    def side(folder: str, arrays: dict[str, str], parse, name: str) -> DataFrame:
        rows = _landed_hours(spark, folder, arrays, parse, landed, files).withWatermark("landed", wait)
        return rows.select(F.col(S.STATION).alias(f"{name}_city"), F.col("time").alias(f"{name}_time"),
                           F.col("landed").alias(f"{name}_landed"), F.struct(*arrays.values(), "landed").alias(name))
    left = side(air, S.AIR_ARRAYS, payloads.air_rows, "air")
    right = side(weather, S.WEATHER_ARRAYS, payloads.weather_rows, "weather")
    near = F.expr(f"weather_landed between air_landed - interval {wait} and air_landed + interval {wait}")
    joined = left.join(right, F.expr("air_city = weather_city and air_time = weather_time") & near, "full_outer")
    return joined.select(F.coalesce("air_city", "weather_city").alias(S.STATION),
                         F.coalesce("air_time", "weather_time").alias("time"), "air", "weather")


def paired_readings(pairs: DataFrame, fill: bool = True) -> DataFrame:
    """The hours with both sides, as readings."""
    both = pairs.where("air is not null and weather is not null")
    return merged_readings(both.select(S.STATION, "time", *(F.col(f"air.{c}") for c in S.AIR_ARRAYS.values()),
                                       *(F.col(f"weather.{c}") for c in S.WEATHER_ARRAYS.values())), fill)


def stream_readings(spark: SparkSession, air: str, weather: str, wait: str = WAIT, fill: bool = True) -> DataFrame:
    """Readings of the hours that find their partner within ``wait``. :func:`stream_ingest` keeps the others too."""
    return paired_readings(stream_pairs(spark, air, weather, wait), fill)


def quarantine_path(root: str) -> str:
    return f"{root}/quarantine"


def _measures(arrays: dict[str, str]) -> T.StructType:
    return T.StructType([*(T.StructField(c, T.DoubleType()) for c in arrays.values()), T.StructField("landed", T.TimestampType())])


PAIR = T.StructType([T.StructField(S.STATION, T.StringType()), T.StructField("time", T.TimestampType()),
                     T.StructField("air", _measures(S.AIR_ARRAYS)), T.StructField("weather", _measures(S.WEATHER_ARRAYS))])


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Hours that still wait for their partner: (city, time, air, weather), one of the two sides null.

    Hours without a station or a time have no partner and stay there.
    """
    path = quarantine_path(root)
    return M.read(spark, path, M.current(spark, path), PAIR).select(PAIR.names)


def _meeting(alone: DataFrame) -> DataFrame:
    """Pairs of the two sides of one hour among hours that have one side each."""
    air = alone.where("air is not null").select(S.STATION, "time", "air")
    weather = alone.where("weather is not null").select(S.STATION, "time", "weather")
    return air.join(weather, [S.STATION, "time"])


def ingest_pairs(pairs: DataFrame, root: str, version: int = VERSION, mode: str = "keep", fill: bool = True,
                 batch: Batch | None = None) -> None:
    """Store what a batch of :func:`stream_pairs` brought: hours with both sides as readings, the others in quarantine.

    Hours that come alone meet those in quarantine first, of their days only. The readings are committed before the
    quarantine gives up its side, and each of the two commits holds the batch's number, so a batch that runs again
    after any failure finishes what is missing and repeats nothing. A lone hour that lands again after its pair was
    stored stays out of the quarantine: its reading is there.
    """
    spark, path = pairs.sparkSession, quarantine_path(root)
    scratch = scratch_path(spark, "pairs")
    try:
        rows = materialize(pairs.select(PAIR.names), f"{scratch}/batch")
        day = F.coalesce(F.to_date("time"), F.lit("1970-01-01").cast("date"))
        alone = rows.where("air is null or weather is null").withColumn(EVENT_DATE, day)
        days = [str(r[0]) for r in alone.select(EVENT_DATE).distinct().collect()]
        state = {}

        def waiting(now: M.Manifest) -> DataFrame:
            held = M.read(spark, path, now, PAIR, days).select(*PAIR.names, EVENT_DATE)
            return materialize(alone.unionByName(held), f"{scratch}/waiting-{now.number}")

        now = M.current(spark, path)
        met = rows.where("air is not null and weather is not null").select(PAIR.names)
        if days and not now.holds(batch):
            state[now.number] = waiting(now)
            met = met.unionByName(_meeting(state[now.number]).select(PAIR.names))
        upsert_features(paired_readings(met, fill), root, version, mode=mode, refresh=True, batch=batch)

        def change(now: M.Manifest) -> tuple[M.Manifest, str | None]:
            # The state the readings were made from, unless another writer has changed it since.
            open_ = state.get(now.number)
            open_ = waiting(now) if open_ is None else open_
            stored = _stored_hours(spark, root, version, days)
            left = open_.join(stored, [S.STATION, "time"], "left_anti")
            commit, written = M.write_commit(left.select(*PAIR.names, EVENT_DATE).hint("rebalance", EVENT_DATE), path)
            return now.replacing(commit, written, days), commit
        if days:
            M.committed(spark, path, batch, change)
    finally:
        remove(spark, scratch)


def _stored_hours(spark: SparkSession, root: str, version: int, days: list[str]) -> DataFrame:
    path = table_path(root, version)
    stored = M.read(spark, path, M.current(spark, path), S.READING, days)
    return stored.select(S.STATION, F.col(S.TIME).alias("time"))


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity a stream got with its checkpoint: a new checkpoint counts its batches from 0 under a new name."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def stream_ingest(pairs: DataFrame, root: str, checkpoint: str, version: int = VERSION, mode: str = "keep",
                  available_now: bool = False, interval: str = "1 hour", partitions: int | None = None) -> StreamingQuery:
    """Every batch of :func:`stream_pairs` into the reading table, the latest rows and the quarantine."""
    spark = pairs.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        ingest_pairs(batch, root, version, mode, batch=(stream_id(spark, checkpoint), number))
    return _start_batches(pairs, write, checkpoint, available_now, interval, partitions)


def stream_dedup(readings: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first row of each key; state is kept only as long as the watermark needs it."""
    return readings.withWatermark(S.TIME, delay).dropDuplicatesWithinWatermark(S.KEY)


#: A first row of each key, and what was set aside with the reason: late, duplicate or no key.
KEPT, ASIDE = "kept", "aside"


def _first_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key, values before nulls in column order: an aggregate, so a hot key sends one row per task."""
    rest = [c for c in columns if c not in S.KEY]
    ranks = [x for c in rest for x in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = rows.groupBy(*S.KEY).agg(F.min(F.struct(*ranks, "_row")).alias("_first"))
    return first.select(*S.KEY, *(F.col(f"_first.{c}").alias(c) for c in rest), "_first._row")


def keep_on_time(batch: DataFrame, root: str, delay: str = DELAY, number: Batch | None = None) -> None:
    """The first row of each key to the table ``kept`` below ``root``, every other row of the batch to ``aside``.

    A row is late when its time is not after the watermark, the newest time of all earlier batches less ``delay``.
    Both tables hold the batch's number. What is set aside is committed first, and the watermark and the stored keys
    are those of ``kept``, so a batch that runs again after any failure sorts its rows in the same way and adds what is
    missing: kept and aside together are what landed. Columns must be orderable.
    """
    spark, kept, aside = batch.sparkSession, f"{root}/{KEPT}", f"{root}/{ASIDE}"
    now = M.current(spark, kept)
    if now.holds(number):
        return
    columns, schema = batch.columns, batch.schema
    scratch = scratch_path(spark, "on-time")
    try:
        day = F.coalesce(F.to_date(S.TIME), F.lit("1970-01-01").cast("date"))
        rows = materialize(batch.withColumn(EVENT_DATE, day).withColumn("_row", F.monotonically_increasing_id()),
                           f"{scratch}/batch")
        keyless = F.col(S.STATION).isNull() | F.col(S.TIME).isNull()
        newest = _newest(spark, kept, now, schema)
        late = F.lit(False) if newest is None else F.col(S.TIME) <= F.lit(newest) - F.expr(f"interval {delay}")
        reason = F.when(keyless, "no key").when(late, "late")
        on_time = rows.where(reason.isNull())
        days = [str(r[0]) for r in on_time.select(EVENT_DATE).distinct().collect()]
        stored = M.read(spark, kept, now, schema, days).select(*S.KEY)
        new = materialize(_first_rows(on_time, [*columns, EVENT_DATE]).join(stored, S.KEY, "left_anti"), f"{scratch}/new")
        rest = (rows.join(new.select("_row"), "_row", "left_anti")
                .withColumn("reason", F.coalesce(reason, F.lit("duplicate"))).drop("_row"))
        for path, part in ((aside, rest), (kept, new.select(*columns, EVENT_DATE))):
            def change(now: M.Manifest) -> tuple[M.Manifest, str | None]:
                commit, written = M.write_commit(part.hint("rebalance", EVENT_DATE), path)
                return now.adding(commit, written), commit
            M.committed(spark, path, number, change)
    finally:
        remove(spark, scratch)


def _newest(spark: SparkSession, path: str, now: M.Manifest, schema: T.StructType) -> datetime | None:
    """The newest time of a table, from the folders of its newest day."""
    if not now.days:
        return None
    return M.read(spark, path, now, schema, [max(now.days)]).agg(F.max(S.TIME)).first()[0]


def stream_on_time(rows: DataFrame, root: str, checkpoint: str, delay: str = DELAY, available_now: bool = False,
                   interval: str = "1 hour", partitions: int | None = None) -> StreamingQuery:
    """:func:`stream_dedup` that loses nothing: late rows and repeated keys go to a table of their own."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        keep_on_time(batch, root, delay, (stream_id(spark, checkpoint), number))
    return _start_batches(rows, write, checkpoint, available_now, interval, partitions)


def read_kept(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    path = f"{root}/{KEPT}"
    return M.read(spark, path, M.current(spark, path), schema).select(schema.names)


def read_aside(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows set aside, with ``reason``."""
    path = f"{root}/{ASIDE}"
    full = T.StructType([*schema.fields, T.StructField("reason", T.StringType())])
    return M.read(spark, path, M.current(spark, path), full).select(full.names)


def stream_hourly(events: DataFrame, value: str = "value", delay: str = DELAY) -> DataFrame:
    """Events (city, ts, value) to one row per station and hour, emitted once the hour is closed."""
    hourly = (events.withWatermark("ts", delay)
              .groupBy(S.STATION, F.window("ts", "1 hour").alias("hour"))
              .agg(F.avg(value).alias("aqi"), F.max(value).alias("aqi_max"),
                   F.count(F.lit(1)).alias("n_events")))
    return hourly.select(S.STATION, F.col("hour.start").alias(S.TIME), "aqi", "aqi_max", "n_events")


def _start(writer: DataStreamWriter, spark: SparkSession, partitions: int | None) -> StreamingQuery:
    """Start with a given number of state partitions.

    A stream takes the number from the session when it first starts and its checkpoint keeps it, so it
    is worth choosing: about the cores the stream may use.
    """
    if partitions is None:
        return writer.start()
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def _start_batches(stream: DataFrame, write, checkpoint: str, available_now: bool, interval: str,
                   partitions: int | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return _start(writer.trigger(**trigger), stream.sparkSession, partitions)


def stream_upsert(readings: DataFrame, root: str, checkpoint: str, version: int = VERSION,
                  available_now: bool = False, interval: str = "1 hour",
                  partitions: int | None = None, mode: str = "keep") -> StreamingQuery:
    """Keyed write of every micro-batch, and a refresh of the latest rows.

    The table's manifest holds the last batch of the stream: one that runs again after a failure changes nothing, in
    mode ``replace`` as in ``keep``.
    """
    spark = readings.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        upsert_features(batch, root, version, mode, refresh=True, batch=(stream_id(spark, checkpoint), number))
    return _start_batches(readings, write, checkpoint, available_now, interval, partitions)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> None:
    """Process everything that has landed, append it to parquet files and stop."""
    writer = (stream.writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    _start(writer, stream.sparkSession, partitions).awaitTermination()
