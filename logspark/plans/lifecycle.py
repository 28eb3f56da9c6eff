"""Nightly retention: plan, archive, verify, then remove what is safely archived."""

import re
import sys
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import retention as ret, spans
from ..schema import LOG_COLUMNS, PARTITION_COLUMNS
from ..session import cut_lineage, send_code_of
from ..sources.commits import CommitLog
from ..sources.logs import manifest_of_files, manifest_rows, read_archive, read_logs, write_archive


def lifecycle_plan(parts: DataFrame, archived: DataFrame, as_of, hot_days: int = ret.HOT_DAYS,
                   cold_days: int = ret.COLD_DAYS) -> DataFrame:
    """What tonight's run will do with each partition: archive it, drop it, expire it or keep it."""
    limit = spans.day(spans.start_of_day(as_of) - timedelta(days=hot_days))
    expiry = spans.day(spans.start_of_day(as_of) - timedelta(days=cold_days))
    here = parts.select(*PARTITION_COLUMNS, F.lit(True).alias("hot"))
    there = archived.select(*PARTITION_COLUMNS, F.lit(True).alias("archived"))
    both = here.join(there, PARTITION_COLUMNS, "full").fillna(False, ["hot", "archived"])
    old = F.col("log_date") <= limit
    action = (
        F.when(F.col("log_date") < expiry, "EXPIRE")
        .when(F.col("hot") & old & F.col("archived"), "DROP_HOT")
        .when(F.col("hot") & old, "ARCHIVE")
        .otherwise("KEEP")
    )
    return both.withColumn("action", action).select(*PARTITION_COLUMNS, "hot", "archived", "action")


def run_lifecycle(spark: SparkSession, table: str, archive: str, as_of, dry_run: bool = True, journal: str | None = None) -> DataFrame:
    """Archive old partitions in one job and return the plan with verified row counts.

    The plan comes from file listings alone; rows are counted only in the partitions that
    move. With ``dry_run`` nothing is written. Otherwise a partition is deleted from the
    table once its archived rows equal its own, by number and content, and expired ones on both sides.

    Deletes have two phases. The files to go are written to the journal and committed; then tasks delete them, and the
    entry is closed. A run that was killed in between is completed by the next one, before it plans anything: it
    deletes the files that were named, and no file that came later.
    """
    if dry_run:
        return lifecycle_plan(_parts(spark, table), _parts(spark, archive, "archive_"), as_of).withColumn("verified", F.lit(False))
    book = Journal(spark, journal or f"{archive.rstrip('/')}_journal")
    book.complete()
    # files are named before rows are counted: what arrives later is neither counted as gone nor deleted
    files = cut_lineage(_files(spark, table, "").unionByName(_files(spark, archive, "archive_")))
    parts = lambda side: files.filter(F.col("side") == side).groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("files"))
    plan = cut_lineage(lifecycle_plan(parts(""), parts("archive_"), as_of))
    logs = read_logs(spark, table)
    todo = plan.filter("action = 'ARCHIVE'").select(*PARTITION_COLUMNS)
    write_archive(logs.join(todo, PARTITION_COLUMNS, "left_semi"), archive, mode="overwrite")
    moving = plan.filter("action in ('ARCHIVE', 'DROP_HOT')").select(*PARTITION_COLUMNS)
    result = (
        plan.join(_rows(logs, moving, "rows"), PARTITION_COLUMNS, "left")
        .join(_rows(read_archive(spark, archive), moving, "archived_rows"), PARTITION_COLUMNS, "left")
        .withColumn("verified", F.coalesce((F.col("rows") == F.col("archived_rows")) & (F.col("rows_sum") == F.col("archived_rows_sum")), F.lit(False)))
        .drop("rows_sum", "archived_rows_sum")
    )
    result = cut_lineage(result)
    gone = result.filter("verified or action = 'EXPIRE'").select(*[F.col(c).alias(f"_{c}") for c in PARTITION_COLUMNS], "action")
    same = F.lit(True)
    for c in PARTITION_COLUMNS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    # archives go only when they expire
    paths = files.join(gone, same & ((F.col("side") == "") | (F.col("action") == "EXPIRE"))).select("path")
    book.note(paths)
    book.complete()
    return result


def _files(spark: SparkSession, path: str, side: str) -> DataFrame:
    """Files with the partition that their names say: (side, path, partition columns)."""
    target = _path(spark, path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], "side STRING, path STRING, tenant_id STRING, system_id STRING, log_date DATE")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return manifest_rows(files, side, "path").withColumn("side", F.lit(side)).select("side", "path", *PARTITION_COLUMNS)


class Journal:
    """Files that are to be deleted, noted before the first of them is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def open_entries(self) -> list[str]:
        names = set(self.log.names())
        return sorted(n for n in names if not n.endswith("-done") and f"{n}-done" not in names)

    def note(self, paths: DataFrame) -> None:
        """Phase one: the files are written down, then the entry is committed."""
        name = uuid.uuid4().hex
        paths.select("path").write.parquet(f"{self.path}/{name}")
        self.log.add(name, {"files": name})

    def complete(self) -> None:
        """Phase two, for every open entry: tasks delete its files, then it is closed."""
        for name in self.open_entries():
            paths = self.spark.read.schema("path STRING").parquet(f"{self.path}/{self.log.read(name)['files']}")
            first = paths.mapInPandas(_delete_files, "path STRING, error STRING").filter("error is not null").orderBy("path").limit(1).collect()
            first = first[0] if first else None
            if first is not None:
                raise OSError(f"cannot delete {first.path}: {first.error}")
            self.log.add(f"{name}-done", {})


def _delete_files(batches):
    """Delete files, those already gone included, and folders that are empty then."""
    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        errors = []
        for path in batch["path"]:
            try:
                system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)).replace("%", "%25").replace(" ", "%20"))
                if system.get_file_info(name).type != fs.FileType.NotFound:
                    system.delete_file(name)
                folder = name.rpartition("/")[0]
                for beside in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                    if beside.base_name.startswith(".") and beside.base_name.endswith(".crc"):
                        if f".{name.rpartition('/')[2]}.crc" == beside.base_name:
                            system.delete_file(beside.path)
                if system.get_file_info(folder).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(folder)):
                    system.delete_dir(folder)
                errors.append(None)
            except FileNotFoundError:
                errors.append(None)  # another task came first
            except Exception as failure:  # noqa: BLE001  (reported with the path it belongs to)
                errors.append(f"{type(failure).__name__}: {failure}")
        yield pd.DataFrame({"path": batch["path"], "error": pd.Series(errors, dtype=object)})


def _rows(rows: DataFrame, parts: DataFrame, name: str) -> DataFrame:
    """Row counts of some partitions, and a sum over their contents; the semi-join on partition columns prunes the scan."""
    return rows.join(parts, PARTITION_COLUMNS, "left_semi").groupBy(*PARTITION_COLUMNS).agg(
        F.count(F.lit(1)).alias(name), F.sum(F.xxhash64(*LOG_COLUMNS).cast("decimal(38,0)")).alias(f"{name}_sum")
    )


def _parts(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    target = _path(spark, path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        empty = "tenant_id STRING, system_id STRING, log_date DATE, files BIGINT, bytes BIGINT"
        return spark.createDataFrame([], empty)
    return manifest_of_files(spark, path, prefix)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


send_code_of(sys.modules[__name__])
