"""Health scores: all systems and days in one aggregate."""

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import clamp, growth_rate, percent, round_half_up
from . import dims, spans
from .stats import is_error

MAX_RESPONSE_MS = 5000.0
RESOURCE_SCORE = 100.0
# Lower bound and name of each health level.
HEALTH_LEVELS = ((95.0, "优秀"), (85.0, "良好"), (75.0, "一般"), (60.0, "较差"))
WORST_LEVEL = "危险"
# Per-system factors as score column, name, bound of HIGH, advice.
SYSTEM_FACTORS = (
    ("availability", "可用性", 80, "系统请求成功率偏低，建议检查接口稳定性"),
    ("performance", "性能", 70, "响应时间偏高，建议优化性能瓶颈"),
    ("exception", "异常率", 80, "错误日志占比较高，建议排查异常原因"),
)
GOOD_FACTOR = ("系统运行良好", "LOW", "所有指标均正常，继续保持")
# Fleet factors as score column, name, bound, impact, advice.
FLEET_FACTORS = (
    ("availability", "可用性", 90, "HIGH", "失败请求较多，建议检查系统接口稳定性和错误处理机制"),
    ("performance", "性能", 80, "MEDIUM", "响应时间过长，建议优化数据库查询、添加缓存或增加服务器资源"),
    ("exception", "异常率", 90, "HIGH", "异常日志较多，建议排查错误原因并修复相关问题"),
)


def health_level(score: Column) -> Column:
    out = F
    for bound, name in HEALTH_LEVELS:
        out = out.when(score >= bound, name)
    return out.otherwise(WORST_LEVEL)


def metrics(logs: DataFrame, keys: list, approx: bool = False) -> DataFrame:
    """Requests, errors, failures, mean and p99 response time per group.

    The exact percentile aggregates value counts, so a hot group costs one entry per
    distinct millisecond and not one per row.
    """
    failed = is_error() | (F.col("status_code") >= 500)
    p99 = F.percentile_approx("response_time", 0.99) if approx else F.percentile("response_time", 0.99)
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(is_error()).alias("errors"),
        F.count_if(failed).alias("failed"),
        F.avg("response_time").alias("avg_ms"),
        p99.cast("double").alias("p99_ms"),
    )


def scores(total: Column, errors: Column, failed: Column, avg_ms: Column) -> dict[str, Column]:
    """The three part scores and the weighted overall score; groups without rows score 100."""
    part = {
        "availability": F.when(total == 0, 100.0).otherwise(clamp((total - failed) / total * 100.0, 0.0, 100.0)),
        "performance": F.when(avg_ms.isNull() | (avg_ms <= 0), 100.0).otherwise(
            clamp((1.0 - avg_ms / MAX_RESPONSE_MS) * 100.0, 0.0, 100.0)
        ),
        "exception": F.when(total == 0, 100.0).otherwise(clamp((1.0 - errors / total) * 100.0, 0.0, 100.0)),
    }
    overall = (
        part["availability"] * 0.4 + part["performance"] * 0.3
        + part["exception"] * 0.2 + F.lit(RESOURCE_SCORE * 0.1)
    )
    return {**part, "overall": overall}


def with_scores(df: DataFrame) -> DataFrame:
    total = F.coalesce(F.col("total"), F.lit(0))
    return df.withColumns(scores(total, F.col("errors"), F.col("failed"), F.col("avg_ms")))


def system_health(logs: DataFrame, systems: DataFrame, start, end, approx: bool = False) -> DataFrame:
    """Rounded scores and level of every enabled system, silent ones included."""
    per_system = metrics(spans.within(logs, start, end, inclusive_end=True), dims.SYSTEM_KEY, approx)
    every = with_scores(dims.for_every_system(systems, per_system, ["total", "errors", "failed"]))
    return every.select(
        *dims.SYSTEM_KEY, "system_name", "total", "errors", "failed",
        round_half_up(F.coalesce("avg_ms", F.lit(0.0))).alias("avg_ms"),
        round_half_up(F.coalesce("p99_ms", F.lit(0.0))).alias("p99_ms"),
        *[
            round_half_up(F.col(c)).alias(f"{c}_score")
            for c in ("availability", "performance", "exception")
        ],
        F.lit(RESOURCE_SCORE).alias("resource_score"),
        round_half_up(F.col("overall")).alias("health_score"),
        health_level(F.col("overall")).alias("health_level"),
    )


def recent_health(logs: DataFrame, systems: DataFrame, as_of, hours: int = 24) -> DataFrame:
    now = spans.as_datetime(as_of)
    return system_health(logs, systems, now - timedelta(hours=hours), now)


def health_trend(logs: DataFrame, systems: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Score per enabled system and day; days without rows score 100."""
    start, end = spans.last_days(as_of, days)
    per_day = metrics(
        spans.within(logs, start, end), [*dims.SYSTEM_KEY, F.to_date("ts").alias("day")]
    )
    first, last = F.lit(start.date()), F.lit((end - timedelta(days=1)).date())
    grid = dims.enabled(systems).select(
        *dims.SYSTEM_KEY, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("day")
    )
    joined = grid.join(per_day, [*dims.SYSTEM_KEY, "day"], "left").fillna(
        0, subset=["total", "errors", "failed"]
    )
    return with_scores(joined).select(
        *dims.SYSTEM_KEY, "day", F.date_format("day", "MM-dd").alias("label"),
        round_half_up(F.col("overall")).alias("health_score"),
        F.col("total").alias("log_count"), F.col("errors").alias("exception_count"),
    )


def fleet_summary(health: DataFrame) -> DataFrame:
    """Mean score and distribution over the five levels."""
    score = F.col("health_score")
    return health.agg(
        F.coalesce(round_half_up(F.avg(score)), F.lit(0.0)).alias("overall_health"),
        F.count_if(score >= 95).alias("excellent"),
        F.count_if((score >= 85) & (score < 95)).alias("good"),
        F.count_if((score >= 75) & (score < 85)).alias("fair"),
        F.count_if((score >= 60) & (score < 75)).alias("poor"),
        F.count_if(score < 60).alias("critical"),
    ).withColumns(
        {
            "healthy_systems": F.col("excellent") + F.col("good"),
            "warning_systems": F.col("fair"),
            "critical_systems": F.col("poor") + F.col("critical"),
        }
    )


def fleet_factors(health: DataFrame) -> DataFrame:
    """What pulls the fleet down: a row per mean score below its bound."""
    means = health.agg(*[F.avg(f"{c}_score").alias(c) for c, *_ in FLEET_FACTORS])
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c) < bound,
                    F.struct(F.lit(name).alias("factor"), F.lit(impact).alias("impact"),
                             F.lit(advice).alias("suggestion")),
                )
                for c, name, bound, impact, advice in FLEET_FACTORS
            ]
        )
    )
    return means.select(F.inline(found))


def system_factors(health: DataFrame) -> DataFrame:
    """Factors of each system, or one row saying that all is well."""
    fields = ("factor", "impact", "suggestion")
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"{c}_score") < 95,
                    F.struct(
                        F.concat(F.lit(f"{name} ("), F.col(f"{c}_score").cast("string"), F.lit("分)")).alias("factor"),
                        F.when(F.col(f"{c}_score") < high, "HIGH").otherwise("MEDIUM").alias("impact"),
                        F.lit(advice).alias("suggestion"),
                    ),
                )
                for c, name, high, advice in SYSTEM_FACTORS
            ]
        )
    )
    good = F.array(F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, GOOD_FACTOR)]))
    return health.select(
        *dims.SYSTEM_KEY, F.inline(F.when(F.size(found) > 0, found).otherwise(good))
    )


def system_status(logs: DataFrame, systems: DataFrame, as_of) -> DataFrame:
    """Today's rows and exception rate next to the score of the last 24 hours."""
    today = spans.start_of_day(as_of)
    per_system = (
        spans.within(logs, today, today + timedelta(days=1))
        .groupBy(*dims.SYSTEM_KEY)
        .agg(
            F.count(F.lit(1)).alias("today_log_count"),
            F.count_if(is_error()).alias("_errors"),
        )
    )
    health = recent_health(logs, systems, as_of).select(
        *dims.SYSTEM_KEY, "system_name", "health_score", "health_level"
    )
    return (
        health.join(per_system, dims.SYSTEM_KEY, "left")
        .fillna(0, subset=["today_log_count", "_errors"])
        .withColumn("exception_rate", percent(F.col("_errors"), F.col("today_log_count")))
        .drop("_errors")
    )


def overview(logs: DataFrame, systems: DataFrame, as_of) -> DataFrame:
    """Headline figures; today, yesterday and both health spans come from one grouped scan."""
    now = spans.as_datetime(as_of)
    today, one = spans.start_of_day(now), timedelta(days=1)
    ts = F.col("ts")

    def span(start, end, closed=False) -> Column:
        upper = ts <= spans.instant(end) if closed else ts < spans.instant(end)
        return (ts >= spans.instant(start)) & upper

    recent, previous = span(now - one, now, True), span(now - 2 * one, now - one, True)
    failed = is_error() | (F.col("status_code") >= 500)
    low = min(today - one, now - 2 * one)
    sums = spans.within(logs, low, today + one).groupBy(*dims.SYSTEM_KEY).agg(
        F.count_if(span(today, today + one)).alias("today_n"),
        F.count_if(span(today - one, today)).alias("yesterday_n"),
        *[
            agg.alias(f"{name}_{tag}")
            for tag, cond in (("now", recent), ("old", previous))
            for name, agg in (
                ("total", F.count_if(cond)),
                ("errors", F.count_if(cond & is_error())),
                ("failed", F.count_if(cond & failed)),
                ("avg_ms", F.avg(F.when(cond, F.col("response_time")))),
            )
        ],
    )
    counts = [c for c in sums.columns if c not in (*dims.SYSTEM_KEY, "avg_ms_now", "avg_ms_old")]
    every = dims.for_every_system(systems, sums, counts)

    def rounded(tag: str) -> Column:
        columns = (F.col(f"{c}_{tag}") for c in ("total", "errors", "failed", "avg_ms"))
        return round_half_up(scores(*columns)["overall"])

    mean = lambda c: F.coalesce(round_half_up(F.avg(c), 1), F.lit(0.0))
    current = every.withColumns({"now": rounded("now"), "old": rounded("old")}).agg(
        F.count(F.lit(1)).alias("total_systems"),
        F.coalesce(F.sum("today_n"), F.lit(0)).alias("today_log_count"),
        F.coalesce(F.sum("yesterday_n"), F.lit(0)).alias("yesterday_log_count"),
        F.count_if(F.col("now") < 60).alias("abnormal_system_count"),
        mean("now").alias("avg_health_score"),
        mean("old").alias("previous_score"),
    )
    new = dims.enabled(systems).filter(
        (F.col("create_time") >= F.date_trunc("month", spans.instant(now)))
    ).agg(F.count(F.lit(1))).scalar()
    return current.select(
        "total_systems", new.alias("new_systems_this_month"), "today_log_count",
        growth_rate(F.col("today_log_count"), F.col("yesterday_log_count")).alias("log_count_growth"),
        "abnormal_system_count", "avg_health_score",
        round_half_up(F.col("avg_health_score") - F.col("previous_score"), 1).alias("health_score_change"),
    )
