"""Declared schemas and the readers and writers of published tables and raw documents."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LISTING = (
    "id string, venue_id string, title string, description string, event_type string, event_types array<string>, start string, `end` string, "
    "all_day boolean, url string, image string, location_override string, artists array<string>, audience array<string>, source string, "
    "scraped_at string, is_free boolean, price_text string"
)
VENUE = (
    "id string, name string, short_name string, type string, description string, website string, events_url string, address string, "
    "lat double, lng double, region string, neighborhood string, socials map<string,string>, aliases array<string>"
)
HEALTH = "venue_id string, zero_streak int, last_success string"
WARNING = "venue_id string, title string, reason string, at string"
RAW_DOCUMENT = "source_id string, kind string, url string, page_no int, body string, fetched_at string"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, one array or object a file; a missing, empty or corrupt file gives an empty table."""
    try:
        found = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return found.where(F.col("_corrupt").isNull()).drop("_corrupt").where(F.coalesce(*[F.col(c).isNotNull() for c in found.columns[:1]]))


def write_json(df: DataFrame, path: str) -> None:
    """Overwrites a JSON table; text stays UTF-8."""
    df.write.mode("overwrite").json(path)


def publish(tables: dict[str, DataFrame], folder: str, dry_run: bool = False) -> dict[str, int]:
    """Writes all tables as the next version below ``folder``, or only counts them in a dry run.

    A version is a folder of its own, and it counts once its list of tables is
    written, last of all. So a run may read the version before while it makes
    the next one, and a run that dies leaves that one in place.
    """
    counts = {}
    for name, df in tables.items():
        if dry_run:
            counts[name] = df.count()
    if dry_run or not tables:
        return counts
    spark = next(iter(tables.values())).sparkSession
    version = (latest_version(spark, folder) or 0) + 1
    for name, df in tables.items():
        told = Observation()
        df.observe(told, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/version={version}/{name}")
        counts[name] = told.get["n"]
    done = spark.createDataFrame([(k, v) for k, v in counts.items()], "name string, n long")
    done.coalesce(1).write.mode("overwrite").json(f"{folder}/version={version}/_tables_done")
    return counts


def latest_version(spark: SparkSession, folder: str) -> int | None:
    """The newest whole version below ``folder``; None if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/version=*/_tables_done/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    versions = [int(str(f.getPath().getParent().getParent().getName()).removeprefix("version=")) for f in found]
    return max(versions, default=None)


def published(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table of the newest version; empty before the first one."""
    version = latest_version(spark, folder)
    return spark.createDataFrame([], schema) if version is None else spark.read.parquet(f"{folder}/version={version}/{name}")


def corrupt_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path): the files that hold no readable JSON."""
    rows = spark.read.text(paths, wholetext=True).withColumn("path", F.input_file_name())
    return rows.where(F.expr("try_parse_json(value)").isNull()).select("path")


def require_json(spark: SparkSession, paths: list[str]) -> None:
    """Fails, naming a few of them, if any file holds no readable JSON."""
    bad = corrupt_files(spark, paths)
    if found := [r.path for r in bad.limit(5).collect()]:
        raise ValueError(f"no readable JSON: {', '.join(found)}")


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed source documents; fetching them is outside Spark's plans."""
    return read_json(spark, path, RAW_DOCUMENT)


@dataclass(frozen=True)
class Source:
    """How one source is read: the extension point of the engine.

    ``year_policy`` and ``past_days`` tell dialects.parse_range() what to do about years that its pages lack;
    ``parser`` names the function that extract.custom() reads its pages with. The rest tells write_side.publishable()
    what isn't published: whole titles in any case, a pattern found in a title, types, rows that are past, rows without a time.
    """

    venue_id: str
    label: str
    default_event_type: str = "other"
    reshape: bool = True
    id_salt: str = ""
    year_policy: str = "same"
    past_days: int = 14
    parser: str = ""
    skip_titles: tuple[str, ...] = ()
    skip_pattern: str = ""
    skip_types: tuple[str, ...] = ()
    drop_past: bool = False
    require_time: bool = False


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    schema = "venue_id string, label string, default_event_type string, reshape boolean, id_salt string, year_policy string, past_days int, parser string, skip_titles array<string>, skip_pattern string, skip_types array<string>, drop_past boolean, require_time boolean"
    return spark.createDataFrame([tuple(asdict(s).values()) for s in sources], schema)


def chosen(sources: DataFrame, venues: DataFrame, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(to run, unknown): sources of known venues, of ``only`` if given, and those whose venue isn't known."""
    wanted = sources.where(F.col("venue_id").isin(only)) if only else sources
    ids = venues.select(F.col("id").alias("venue_id")).distinct()
    return wanted.join(ids, "venue_id", "left_semi"), wanted.join(ids, "venue_id", "left_anti")
