"""Feature banks, event features and shard consolidation."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import parse_bool
from ..operators.sampling import assign_rows, dedupe_times


def read_bank(spark: SparkSession, path: str, form: str = "parquet", eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """The usable clip index ``(video_id, t_end_s, row)`` and the counts of clips left out."""
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    raw = reader.format(form).load(path)
    index = raw.select("video_id", F.col("t_end_s").try_cast("double").alias("t_end_s"), F.col("row").try_cast("long").alias("row"))
    return dedupe_times(index, eps)


def event_feature_index(raw: DataFrame) -> DataFrame:
    """Typed event-feature index. The clip end must be the STA one; an ambiguous older column is
    refused. A negative end or a set prior flag means that there is no clip."""
    if "sta_clip_end_s" not in raw.columns:
        raise ValueError("the event feature index needs an sta_clip_end_s column")
    flag = parse_bool("sta_use_prior") if "sta_use_prior" in raw.columns else F.lit(False)
    end = F.col("sta_clip_end_s").try_cast("double")
    out = raw.withColumn("sta_clip_end_s", end).withColumn("use_prior", flag)
    return out.withColumn("row", F.col("row").try_cast("long")).withColumn(
        "has_clip", F.coalesce(~((F.col("sta_clip_end_s") < 0) | F.col("use_prior")), F.lit(False)))


def read_event_features(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.option("header", True) if form == "csv" else spark.read
    return event_feature_index(reader.format(form).load(path))


def consolidate(shards: DataFrame, path: str, order: tuple[str, ...] = ("video_id", "t_end_s"), meta: dict | None = None) -> DataFrame:
    """Number the rows of all shards contiguously, write them with a metadata row (written last, so it
    marks a complete folder), and return the metadata."""
    rows = assign_rows(shards, list(order))
    rows.write.mode("errorifexists").parquet(f"{path}/rows")
    spark = shards.sparkSession
    stored = spark.read.parquet(f"{path}/rows")
    info = stored.agg(F.count(F.lit(1)).alias("total_rows"), F.countDistinct("video_id").alias("num_videos"),
                      *[F.lit(v).alias(k) for k, v in (meta or {}).items()])
    info.coalesce(1).write.mode("errorifexists").json(f"{path}/meta")
    return spark.read.json(f"{path}/meta")
