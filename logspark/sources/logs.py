"""Read and write log tables, archives and exports."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import abbreviate
from ..operators.spans import as_datetime
from ..operators.windows import latest_per_key
from ..schema import JSON_OPTIONS, LOG_COLUMNS, LOG_SCHEMA, PARTITION_COLUMNS
from .stream_table import StreamTable

TABLE_DDL = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields], "log_date DATE"])
SHEET_ROWS = 1_000_000
# A file tells by its bloom filter that it does not hold a trace, without its rows being read.
TRACE_FILTER = {"parquet.bloom.filter.enabled#trace_id": "true", "parquet.bloom.filter.expected.ndv#trace_id": "1000000"}
# Columns of the tabular export, in order.
SHEET_COLUMNS = (
    "id", "trace_id", "tenant_id", "system_id", "ts", "level", "module", "operation",
    "class_name", "method_name", "line_number", "message", "exception", "user_id",
    "user_name", "request_url", "request_method", "response_time", "ip", "thread", "tags",
)


def safe_name(value: Column, default: str) -> Column:
    """Name that is fit for a label: lower case, ``[a-z0-9-]``, at most 50 characters."""
    name = F.substring(F.regexp_replace(F.trim(F.lower(value)), "[^a-z0-9-]", ""), 1, 50)
    return F.when(F.coalesce(name, F.lit("")) == "", default).otherwise(name)


def partition_label() -> Column:
    """Readable name of the partition a row belongs to."""
    tenant, system = safe_name(F.col("tenant_id"), "default"), safe_name(F.col("system_id"), "unknown")
    return F.concat_ws("-", tenant, system, F.date_format("ts", "yyyy.MM.dd"))


def content_hash(columns) -> Column:
    """Hash of the named columns; nulls keep their place, so different rows do not share one."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def document_id(by_span: bool = False) -> Column:
    """Identity of a row: its id, else trace and span, else a hash of the content."""
    span = F.when(
        F.col("trace_id").isNotNull() & F.col("span_id").isNotNull(),
        F.concat_ws("-", "trace_id", "span_id"),
    )
    content = content_hash([c for c in LOG_COLUMNS if c != "id"])
    return F.coalesce(span, content) if by_span else F.coalesce(F.col("id"), span, content)


def latest_documents(df: DataFrame, key: str) -> DataFrame:
    """One row per document: the last written wins, as an overwrite by id would have it."""
    return latest_per_key(df, [key], [F.col("ts").desc(), F.col("id").desc()])


def with_partitions(df: DataFrame) -> DataFrame:
    """Partition columns. Ids are stored as they are (Spark escapes them in paths), so that a
    reader finds what a writer wrote; only missing ones get a default."""
    given = lambda c, default: F.when(F.coalesce(F.trim(c), F.lit("")) == "", default).otherwise(F.col(c))
    return df.withColumns(
        {
            "tenant_id": given("tenant_id", "default"),
            "system_id": given("system_id", "unknown"),
            "log_date": F.to_date("ts"),
        }
    )


def _balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gather rows by target partition before a write. Adaptive execution merges small
    partitions into one task and splits a hot one over several, by measured size."""
    return df.hint("rebalance", *keys)


def write_logs(df: DataFrame, path: str, mode: str = "append", max_records_per_file: int = 5_000_000) -> None:
    """Write by tenant, system and day."""
    (
        _balanced(with_partitions(df), PARTITION_COLUMNS)
        .sortWithinPartitions(*PARTITION_COLUMNS, "ts")
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .options(**TRACE_FILTER)
        .partitionBy(*PARTITION_COLUMNS)
        .parquet(path)
    )


def read_logs(spark: SparkSession, path: str, tenant_id: str | None = None, system_ids=(),
              first_day=None, last_day=None) -> DataFrame:
    """Log table; every argument prunes partitions before a file is opened. Of a table that a
    stream writes, the committed rows."""
    if StreamTable.is_one(spark, path):
        df = StreamTable(spark, path).read(TABLE_DDL)
    else:
        df = spark.read.schema(TABLE_DDL).parquet(path)
    if tenant_id is not None:
        df = df.filter(F.col("tenant_id") == tenant_id)
    if system_ids:
        df = df.filter(F.col("system_id").isin(*system_ids))
    if first_day is not None:
        df = df.filter(F.col("log_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        df = df.filter(F.col("log_date") <= F.lit(last_day).cast("date"))
    return df


def export_json(df: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """JSON lines with the document id and the table partition of each row."""
    named = df.withColumns({"_id": document_id(), "_index": partition_label()})
    writer = named.write.mode("overwrite").options(**JSON_OPTIONS)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.json(path)


def write_archive(df: DataFrame, path: str, mode: str = "append") -> None:
    """Gzip JSON by tenant, system and day. The keys are kept inside the rows too.

    With ``mode="overwrite"`` only the partitions present in ``df`` are replaced.
    """
    keys = [f"archive_{c}" for c in PARTITION_COLUMNS]
    named = df.withColumns(
        {"archive_tenant_id": F.col("tenant_id"), "archive_system_id": F.col("system_id"),
         "archive_log_date": F.to_date("ts")}
    )
    (
        _balanced(named.drop("log_date"), keys)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys).option("compression", "gzip").options(**JSON_OPTIONS).json(path)
    )


def read_archive(spark: SparkSession, path: str, tenant_id: str | None = None,
                 system_id: str | None = None, day=None) -> DataFrame:
    keys = "archive_tenant_id STRING, archive_system_id STRING, archive_log_date DATE"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA.fields)
    df = spark.read.schema(f"{fields}, {keys}").options(**JSON_OPTIONS).json(path)
    if tenant_id is not None:
        df = df.filter(F.col("archive_tenant_id") == tenant_id)
    if system_id is not None:
        df = df.filter(F.col("archive_system_id") == system_id)
    if day is not None:
        df = df.filter(F.col("archive_log_date") == F.lit(day).cast("date"))
    return df.withColumn("log_date", F.col("archive_log_date")).drop(
        "archive_tenant_id", "archive_system_id", "archive_log_date"
    )


def manifest_of_files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Files and bytes per partition, from file names and sizes alone; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return (
        manifest_rows(files, prefix)
        .groupBy(*PARTITION_COLUMNS)
        .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    )


def manifest_rows(files: DataFrame, prefix: str = "", *more: str) -> DataFrame:
    """Partition names of files (path, length), decoded as they were written; a date that does not parse is null."""
    def part(key: str) -> Column:
        raw = F.regexp_extract("path", f"/{prefix}{key}=([^/]+)/", 1)
        return F.when((raw != "") & (raw != NULL_PARTITION), decoded_name(raw))

    return files.select(
        part("tenant_id").alias("tenant_id"), part("system_id").alias("system_id"),
        part("log_date").try_cast("date").alias("log_date"), F.col("length"), *more,
    )


# Fixed value: folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def decoded_name(value: Column) -> Column:
    """Partition value of a folder name. Pluses are plain there, unlike in the URL form that the decoder knows."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")), value)


def sheet(df: DataFrame) -> DataFrame:
    """Tabular export: 21 columns, long texts cut, tags joined."""
    special = {
        "message": abbreviate(F.col("message")),
        "exception": abbreviate(F.col("exception")),
        "tags": F.array_join("tags", ", "),
    }
    return df.select(*[special.get(c, F.col(c)).alias(c) for c in SHEET_COLUMNS])


def export_sheets(df: DataFrame, path: str, rows_per_sheet: int = SHEET_ROWS) -> None:
    sheet(df).write.mode("overwrite").options(header="true", escape='"', **JSON_OPTIONS).option(
        "maxRecordsPerFile", rows_per_sheet
    ).csv(path)


def export_days(df: DataFrame, path: str, first_day, last_day, max_days: int = 7) -> None:
    """One folder per day of the range; days without rows leave none."""
    length = as_datetime(last_day) - as_datetime(first_day)
    if length.days < 0 or length.days > max_days:
        raise ValueError(f"an export must cover 0 to {max_days} days")
    days = df.filter(F.to_date("ts").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    (
        sheet(days).withColumn("log_date", F.to_date("ts"))
        .write.mode("overwrite").options(header="true", escape='"', **JSON_OPTIONS)
        .option("maxRecordsPerFile", SHEET_ROWS).partitionBy("log_date").csv(path)
    )


def batch_export(logs: DataFrame, tasks: DataFrame, path: str) -> DataFrame:
    """Export many partitions in one job. Returns rows exported per task; 0 where there were none."""
    keys = PARTITION_COLUMNS
    wanted = logs.join(tasks.select(*keys).distinct(), keys, "left_semi")
    write_archive(wanted, path, mode="overwrite")
    done = (
        logs.sparkSession.read.schema(
            "archive_tenant_id STRING, archive_system_id STRING, archive_log_date DATE"
        ).json(path)
        .groupBy(*[F.col(f"archive_{k}").alias(k) for k in keys])
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    return tasks.join(done, keys, "left").withColumns(
        {"rows": F.coalesce("rows", F.lit(0)), "succeeded": F.col("rows").isNotNull()}
    )


def success_rate(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if("succeeded").alias("succeeded"),
        (F.floor(F.count_if("succeeded") / F.count(F.lit(1)) * 10000 + 0.5) / 100).alias("success_rate"),
    )
