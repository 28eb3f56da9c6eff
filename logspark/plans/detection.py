"""Detection as a batch job: hits and alerts of a span of the log table."""

from pyspark.sql import DataFrame, functions as F

from ..operators import alerts, rules as rule_ops, silence, spans
from ..sources.states import RunStates


def run_detection(logs: DataFrame, rules: DataFrame, start, end, hits_path: str, alerts_path: str,
                  state_path: str | None = None) -> dict[str, DataFrame]:
    """Write hits and alerts of the span and return both with the per-rule execution record.

    Hits are written first and read back: silencing passes over them more than once, and a table
    in shared storage survives the loss of executors where a cache would not.

    With ``state_path``, counts, runs and silences go on from the run before, as if there had been one long run; runs
    must follow one another in time. A run may be repeated: it reads what it read the first time.
    """
    spark = logs.sparkSession
    rows = spans.within(logs, start, end)
    states = RunStates(spark, state_path) if state_path else None
    earlier = states.before(start) if states else {}
    if states:
        hits, counted, runs = rule_ops.detect_run(rows, rules, earlier.get("counted"), earlier.get("runs"), end)
    else:
        hits = rule_ops.detect(rows, rules)
    hits.write.mode("overwrite").parquet(hits_path)
    hits = spark.read.parquet(hits_path)
    keyed = silence.with_silence_key(hits)
    if states:
        fired, silences = silence.fired_and_state(keyed, earlier.get("silences"))
        silences = silence.still_needed(silences, end)
    else:
        fired = silence.fired(keyed)
    alerts.alert_rows(fired, keyed).write.mode("overwrite").parquet(alerts_path)
    if states:
        states.write(end, {"counted": counted, "runs": runs, "silences": silences})
    written = spark.read.parquet(alerts_path)
    return {
        "hits": hits,
        "alerts": written,
        "executions": execution_record(rows, rules, hits, written, end),
        "rules": alerts.trigger_counts(rules, hits),
    }


def execution_record(logs: DataFrame, rules: DataFrame, hits: DataFrame, fired: DataFrame, at) -> DataFrame:
    """Per rule: rows of its system, hits and alerts of one run."""
    keys = ["tenant_id", "system_id"]
    seen = logs.groupBy(*keys).agg(F.count(F.lit(1)).alias("log_count"))
    matched = hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("match_count"))
    alerted = fired.groupBy("rule_id").agg(F.count(F.lit(1)).alias("alert_count"))
    return (
        rules.filter("status = 1").select(F.col("id").alias("rule_id"), *keys)
        .join(seen, keys, "left").join(matched, "rule_id", "left").join(alerted, "rule_id", "left")
        .fillna(0, ["log_count", "match_count", "alert_count"])
        .withColumn("execution_time", spans.instant(at))
    )
