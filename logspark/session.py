"""Session settings for running outside a cluster's own launcher, and lineage cuts."""

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitted session is used as it is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logspark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # recording a call site per column expression doubles the time to build a large plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LOGSPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def send_code_of(module) -> None:
    """Ship the functions of a module inside the tasks, so workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(module)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a scratch folder of a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _scratch.get("of") != spark.sparkContext.applicationId:
        _scratch.update(of=spark.sparkContext.applicationId, path=tempfile.mkdtemp(prefix="logspark-checkpoint-"))
    return _scratch["path"]


_scratch: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so lost executors cost no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
