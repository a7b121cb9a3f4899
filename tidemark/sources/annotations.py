"""Annotation tables, manifests and summaries as files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import parse_seconds
from ..operators.checks import check_events, check_unique, enforce, failing
from ..operators.events import check_supplied_cutoff, manifest_rows, validate_manifest, with_cutoff
from ..session import checkpointed
from .records import read_csv

# Column names of the stored formats.
REQUIRED = ("narration_id", "participant_id", "video_id", "start_timestamp", "stop_timestamp")
LABELS = ("verb_class", "noun_class")
SUPPLIED = "sta_observation_end_seconds"

MANIFEST = T.StructType([
    T.StructField("narration_id", T.StringType()), T.StructField("participant_id", T.StringType()),
    T.StructField("video_id", T.StringType()), T.StructField("start", T.DoubleType()),
    T.StructField("stop", T.DoubleType()), T.StructField("sta_cutoff", T.DoubleType()),
    T.StructField("verb", T.IntegerType()), T.StructField("noun", T.IntegerType()),
    T.StructField("observation", T.StructType([
        T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()),
        T.StructField("inclusive_end", T.BooleanType()), T.StructField("empty", T.BooleanType())])),
    T.StructField("subset", T.StringType()), T.StructField("split", T.StringType()), T.StructField("task", T.StringType())])


def read_events(spark: SparkSession, path: str, labeled: bool = True, gap: float = 1.0, num_verbs: int = 97,
                num_nouns: int = 300, validate: bool = True, splittable: bool = True) -> DataFrame:
    """Typed events from an annotation CSV. Columns are found by name, others ignored; identifiers are
    trimmed. With ``validate``, broken rows raise with their count and first ids. Files are read block by block, fields with line feeds
    included; ``splittable=False`` reads each file in one task and takes quotes inside unquoted fields as they are."""
    raw = read_csv(spark, path) if splittable else spark.read.csv(
        path, header=True, inferSchema=False, encoding="UTF-8", quote='"', escape='"', multiLine=True)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    needed = REQUIRED + (LABELS if labeled else ())
    missing = sorted(set(needed) - set(raw.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    given = F.trim(F.coalesce(F.col(SUPPLIED), F.lit(""))) if SUPPLIED in raw.columns else F.lit("")
    label = [(F.trim(c).try_cast("int") if labeled else F.lit(None).cast("int")).alias(n) for c, n in zip(LABELS, ("verb", "noun"))]
    typed = raw.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in REQUIRED[:3]],
                       parse_seconds("start_timestamp").alias("start"), parse_seconds("stop_timestamp").alias("stop"),
                       *label, parse_seconds(F.when(given != "", given)).alias("_given"), (given != "").alias("_has_given"))
    events = with_cutoff(typed, gap, "_given")
    if validate:
        events = checkpointed(events)  # the checks and all that follows read the parsed rows, not the files
        unreadable = failing(events, "narration_id", {"bad_supplied_cutoff": F.col("_has_given") & F.col("_given").isNull()})
        enforce(check_events(events, num_verbs, num_nouns, labeled), check_supplied_cutoff(events, "_given", gap), unreadable)
        if events.isEmpty():
            raise ValueError("empty event table")
    return events.select("narration_id", "participant_id", "video_id", "start", "stop", "sta_cutoff", "verb", "noun")


def write_manifests(split: DataFrame, path: str, context: float = 5.0, form: str = "json") -> None:
    """One row per event and task, in folders ``split=.../task=...``; never overwrites. ``subset``
    values other than train and test belong to split ``val``."""
    side = F.when(F.col("subset").isin("train", "test"), F.col("subset")).otherwise("val")
    rows = manifest_rows(split.withColumn("split", side), context)
    cols = [f.name for f in MANIFEST.fields]
    rows.select(*cols).write.mode("errorifexists").partitionBy("split", "task").format(form).save(path)


def read_manifest(spark: SparkSession, path: str, gap: float = 1.0, num_verbs: int = 97, num_nouns: int = 300,
                  form: str = "json", validate: bool = True) -> DataFrame:
    """Manifest rows, revalidated in full. NULL labels are kept for hidden tests."""
    rows = spark.read.schema(MANIFEST).format(form).load(path)
    if validate:
        key = F.concat_ws("/", "split", "task", "narration_id")
        enforce(validate_manifest(rows, gap, num_verbs, num_nouns),
                check_unique(rows.withColumn("key", key), "key", "duplicate_event"))
        if rows.isEmpty():
            raise ValueError("empty manifest")
    return rows


def write_split(split: DataFrame, path: str) -> None:
    """The split table as CSV: event, participant, video, subset."""
    split.select("narration_id", "participant_id", "video_id", "subset").write.mode("errorifexists").csv(path, header=True)


def write_summary(path: str, **tables: DataFrame) -> None:
    """One folder of JSON rows per named table, ``table=<name>``."""
    for name, df in tables.items():
        df.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/table={name}")


def read_summary(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table written by ``write_summary``."""
    return spark.read.schema(schema).json(f"{path}/table={name}")
