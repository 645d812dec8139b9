"""The versioned reading table, its latest-row snapshot, the CSV cache, model runs and archives.

Readings are stored per event date and sorted by station and time inside each file: a date range
prunes folders, a station filter skips row groups, and a station with many rows is many files. A manifest says which
folders are the table (see ``manifest``): every write shows at once and whole, and disturbs no reader.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationcast import schema as S
from stationcast.functions.cleaning import KEY_FORMAT, conform, with_key
from stationcast.operators.dedup import append_dedup, dedup_readings, latest_row
from stationcast.session import materialize, remove, scratch_path
from stationcast.sources import manifest as M
from stationcast.sources.manifest import EVENT_DATE, Batch

log = logging.getLogger(__name__)

GROUP = "aqi_features"
VERSION = 6
CHUNK_ROWS = 500


def table_path(root: str, version: int = VERSION, group: str = GROUP) -> str:
    return f"{root}/{group}/v={version}"


def _laid_out(df: DataFrame) -> DataFrame:
    """Even files per date: small ones are merged, a date with very many rows is split."""
    return (df.hint("rebalance", EVENT_DATE).sortWithinPartitions(EVENT_DATE, S.STATION, S.TIME))


def _prepared(df: DataFrame) -> DataFrame:
    rows = with_key(conform(df)).withColumn(S.TIME, F.date_trunc("second", F.col(S.TIME)))
    return dedup_readings(rows).withColumn(EVENT_DATE, F.to_date(S.TIME))


# --- sources -------------------------------------------------------------------------------

def read_features(spark: SparkSession, root: str, version: int = VERSION, group: str = GROUP,
                  days: list[str] | None = None) -> DataFrame:
    """The whole history of one table version as it is now, or the folders of some days of it.

    What is written later does not show in the result, and does not disturb it.
    """
    path = table_path(root, version, group)
    now = M.current(spark, path)
    if now.number == 0:
        # Spark's own error of a missing table.
        return spark.read.schema(S.READING).parquet(f"{path}/data")
    return M.read(spark, path, now, S.READING, days).select(S.READING.names)


def read_recent(spark: SparkSession, root: str, rows: int, version: int = VERSION, group: str = GROUP) -> DataFrame:
    """The newest ``rows`` readings of every station and the rest of the oldest of their days.

    The rows per station and day that the sink keeps say how far back each station has to go, so only the folders
    of those days are opened. A station that has fallen silent is read from the days on which it last reported.
    """
    path = table_path(root, version, group)
    now = M.current(spark, path)
    if now.number == 0:
        return read_features(spark, root, version, group)
    newer = Window.partitionBy(S.STATION).orderBy(F.col(EVENT_DATE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    reached = (M.day_counts(spark, path, now, S.READING[S.STATION])
               .withColumn("newer", F.coalesce(F.sum("count").over(newer), F.lit(0)))
               .where(F.col("newer") < rows).select(S.STATION, EVENT_DATE))
    days = [str(r[0]) for r in reached.select(EVENT_DATE).distinct().collect()]
    stored = M.read(spark, path, now, S.READING, days)
    return stored.join(reached, [S.STATION, EVENT_DATE], "left_semi").select(S.READING.names)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.READING).csv(path, header=True, timestampFormat=KEY_FORMAT)


def _snapshots(root: str) -> str:
    return f"{root}/{GROUP}_latest"


def _sequences(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished snapshots, ascending. One folder listing, no file is opened."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("seq=")]
    return sorted(int(p.getName().removeprefix("seq=")) for p in found
                  if files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _last_sequence(spark: SparkSession, path: str) -> int:
    return max(_sequences(spark, path), default=0)


def _drop_old(spark: SparkSession, path: str, keep: int) -> None:
    for number in _sequences(spark, path)[:-keep]:
        remove(spark, f"{path}/seq={number}")


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of every station, from the snapshot the sink keeps."""
    path = _snapshots(root)
    return spark.read.schema(S.READING).parquet(f"{path}/seq={_last_sequence(spark, path)}")


def first_available(readers: list[Callable[[], DataFrame]]) -> DataFrame | None:
    """The first source that can be read and is not empty."""
    for read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except (PySparkException, Py4JJavaError) as e:
            log.warning("source skipped: %s", str(e).partition("\n")[0])
    return None


def read_past_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PAST_PREDICTION).json(path, multiLine=True)


def read_last_prediction(spark: SparkSession, path: str) -> DataFrame:
    """One row per horizon, each with the conditions at prediction time."""
    snapshot = spark.read.schema(S.LAST_PREDICTION).json(path, multiLine=True)
    # A document per folder (such as city=...) keeps the folder's columns.
    folders = [c for c in snapshot.columns if c not in S.LAST_PREDICTION.names]
    return snapshot.select(*folders, "timestamp", "model_name", "current_conditions.*", F.inline("predictions"))


def read_feature_list(spark: SparkSession, path: str) -> list[str] | None:
    try:
        row = spark.read.schema("features array<string>").parquet(path).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return list(row["features"]) if row else None


# --- sinks ---------------------------------------------------------------------------------

def upsert_features(df: DataFrame, root: str, version: int = VERSION, mode: str = "keep",
                    group: str = GROUP, refresh: bool = False, batch: Batch | None = None) -> None:
    """Write by key (station, time to the second); the table is created if it is missing.

    ``keep`` appends only the keys the table lacks, so nothing stored is rewritten and running a batch
    again adds nothing. ``replace`` lets the new row win and rewrites the dates the batch touches.
    Both read only those dates, and days that have come into many small commits are merged on the way. One new manifest
    makes the write visible, so readers see all of it or nothing. ``batch``, a stream's identity and batch number, is
    written with it: a batch that is there is not written again, in either mode. ``refresh`` folds what was written, and
    nothing else, into the latest-row snapshot. Rows without a key cannot be stored; ``without_key`` finds them.
    """
    if mode not in ("keep", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, path = df.sparkSession, table_path(root, version, group)
    # Written out first: the batch is read twice and must be the same both times.
    scratch = scratch_path(spark, "upsert")
    try:
        rows, days = None, []

        def change(now: M.Manifest) -> tuple[M.Manifest, str | None]:
            nonlocal rows, days
            if rows is None:
                rows = materialize(_prepared(df), f"{scratch}/batch")
                # One value per day of the batch: they prune the folders that are read.
                days = [str(r[0]) for r in rows.select(EVENT_DATE).distinct().collect()]
            if not days:
                return now, None
            stored = M.read(spark, path, now, S.READING, days)
            if mode == "replace":
                commit, written = M.write_commit(_laid_out(append_dedup(rows, stored)), path, S.STATION)
                return now.replacing(commit, written, days), commit
            new = rows.join(stored.select(*S.KEY), S.KEY, "left_anti")
            merged = [d for d in M.compactable(now) if d in set(days)]
            if merged:
                # Keys are apart already, so the old rows of a crowded day just join the new ones.
                new = new.unionByName(M.read(spark, path, now, S.READING, merged))
            commit, written = M.write_commit(_laid_out(new), path, S.STATION)
            apart = [d for d in written if d not in set(merged)]
            return now.replacing(commit, [d for d in written if d in set(merged)], merged).adding(commit, apart), commit

        commit = M.committed(spark, path, batch, change)
        if refresh and commit is not None:
            # From the commit itself: a batch whose snapshot was not written yet is folded in when it comes again.
            refresh_latest(M.read_commit(spark, path, commit, S.READING), root)
    finally:
        remove(spark, scratch)


def recreate_version(df: DataFrame, root: str, version: int, group: str = GROUP) -> None:
    """Write one version anew; readers of the old rows keep them, and the other versions stay."""
    spark, path = df.sparkSession, table_path(root, version, group)

    def change(now: M.Manifest) -> tuple[M.Manifest, str | None]:
        commit, written = M.write_commit(_laid_out(_prepared(df)), path, S.STATION)
        return now.replacing(commit, written, list(now.days)), commit
    M.committed(spark, path, None, change)


def refresh_latest(df: DataFrame, root: str, keep: int = 3) -> None:
    """Fold stored readings into the latest-row snapshot; a row given here replaces one of its key.

    Each refresh writes a new numbered folder, so a reader never sees a half-written one; the newest
    ``keep`` folders stay for readers that have already started.
    """
    spark, path = df.sparkSession, _snapshots(root)
    last = _last_sequence(spark, path)
    rows = _prepared(df).drop(EVENT_DATE)
    if last:
        before = spark.read.schema(S.READING).parquet(f"{path}/seq={last}")
        rows = latest_row(rows)
        rows = before.join(rows.select(*S.KEY), S.KEY, "left_anti").select(S.READING.names).unionByName(rows)
    latest_row(rows).write.mode("overwrite").parquet(f"{path}/seq={last + 1}")
    _drop_old(spark, path, keep)


def overwrite_cache(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, timestampFormat=KEY_FORMAT)


def write_chunked(df: DataFrame, path: str, rows: int = CHUNK_ROWS) -> None:
    """At most ``rows`` rows per file."""
    df.write.mode("append").option("maxRecordsPerFile", rows).parquet(path)


def write_feature_list(spark: SparkSession, names: list[str], path: str) -> None:
    """The training columns in their order, as one row."""
    (spark.createDataFrame([(names,)], "features array<string>").coalesce(1)
     .write.mode("overwrite").parquet(path))


def model_path(root: str, name: str, version: int) -> str:
    return f"{root}/models/{name}/version={version}"


def feature_list_path(root: str, name: str, version: int) -> str:
    return f"{model_path(root, name, version)}/feature_names"


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(S.MODEL_RUN).parquet(f"{root}/model_runs")


def register_run(spark: SparkSession, root: str, name: str, metrics: dict[str, float], description: str,
                 models: list[Model]) -> int:
    """Save one model per horizon and append the run; returns its version (highest so far + 1)."""
    try:
        known = read_runs(spark, root).where(F.col("name") == name).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = 0
    # A version belongs to the writer that creates its claim: two writers never share one.
    version = known + 1
    while not M.create_exclusive(spark, f"{root}/models/{name}/_claims/{version}"):
        version += 1
    path = model_path(root, name, version)
    for horizon, model in zip(S.HORIZONS, models):
        model.write().save(f"{path}/horizon={horizon}")
    run = [(name, version, description, {k: float(v) for k, v in metrics.items()}, path)]
    spark.createDataFrame(run, S.MODEL_RUN).coalesce(1).write.mode("append").parquet(f"{root}/model_runs")
    return version


def archive_predictions(forecast: DataFrame, path: str) -> None:
    """Keep a forecast under its run date; running a date again replaces it."""
    (forecast.hint("rebalance", "run_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path))
