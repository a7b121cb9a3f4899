"""CSV records with quoted line feeds, read by as many tasks as the file has blocks.

A line begins a record when an even number of quotes stands before it in its file. Quotes are added up per block, a prefix scan over the blocks (one
row each) tells with which parity a block begins, and running sums inside the block do the rest. Lines that are whole records stay where they are;
only pieces of records over several lines meet, by the line that begins their record, also across blocks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed value: fields as RFC 4180 has them, quoted or without any quote.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
RECORD = f"^{FIELD}(?:,{FIELD})*+$"


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """value, header: the records of all files, each as text; the first of a file is its header. Blank lines are no records. A file that ends inside
    quotes, and a quote inside a field that isn't quoted, are errors: no other answer would keep all rows."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), quotes.alias("quotes"))
    block = Window.partitionBy("file", "block").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("sum"))
    total = F.sum("sum").over(Window.partitionBy("file"))
    broken = F.raise_error(F.concat(F.lit("a quoted field never ends in "), F.col("file"))).cast("long")
    opened = blocks.select("file", "block", F.when(total % 2 == 1, broken).otherwise(F.coalesce(F.sum("sum").over(earlier), F.lit(0))).alias("opened"))
    before = F.coalesce(F.sum("quotes").over(block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = (lines.join(opened, ["file", "block"]).withColumn("starts", (F.col("opened") + before) % 2 == 0)
            .withColumn("header", (F.col("block") == 0) & (F.row_number().over(block) == 1))
            .withColumn("owner", F.max(F.when(F.col("starts"), F.col("at"))).over(block.rowsBetween(Window.unboundedPreceding, 0))))
    whole = F.col("starts") & (F.col("quotes") % 2 == 0)
    last = seen.groupBy("file", "block").agg(F.max(F.when(F.col("starts"), F.col("at"))).alias("last"))
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    pieces = seen.where(~whole).join(carried, ["file", "block"]).withColumn("owner", F.coalesce("owner", "carried"))
    joined = pieces.groupBy("owner").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda p: p["value"]), "\n").alias("value"),
        F.max("header").alias("header"))
    records = seen.where(whole).select("value", "header").unionByName(joined.select("value", "header"))
    records = records.withColumn("value", F.regexp_replace("value", "\r$", "")).where("header OR trim(value) <> ''")
    stray = F.raise_error(F.concat(F.lit("a quote inside a field that is not quoted: "), F.substring("value", 1, 200))).cast("string")
    sound = ~F.contains(F.col("value"), F.lit('"')) | F.col("value").rlike(RECORD)
    return records.withColumn("value", F.when(F.col("header") | sound, F.col("value")).otherwise(stray))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, named by the header; every block is parsed by its own task."""
    names = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", quote='"', escape='"', multiLine=True).columns
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = csv_records(spark, path).where("NOT header").select(F.from_csv("value", fields, {"quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("r.*").toDF(*names)
