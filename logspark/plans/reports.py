"""Reports made of several operators over one filtered frame."""

from pyspark.sql import DataFrame

from ..operators import exceptions, health, search, spans


def exception_monitor(logs: DataFrame, systems: DataFrame, as_of, start, end, days: int = 7,
                      limit: int = 10) -> dict[str, DataFrame]:
    """Headline, trend, and exceptions by system, by type and by frequency.

    Each part is a lazy frame of its own, so a caller pays for what it shows.
    """
    return {
        "headline": exceptions.exception_headline(logs, systems, as_of, start, end),
        "trend": exceptions.exception_trend(logs, systems, as_of, days),
        "by_system": exceptions.exceptions_by_system(logs, systems, start, end),
        "by_type": exceptions.exceptions_by_type(logs, systems, start, end),
        "frequent": exceptions.frequent_exceptions(logs, systems, limit, start, end),
    }


def monitor_overview(logs: DataFrame, systems: DataFrame, as_of) -> dict[str, DataFrame]:
    """Headline figures and the twenty best systems."""
    return {
        "overview": health.overview(logs, systems, as_of),
        "systems": search.system_list(health.system_status(logs, systems, as_of), size=20),
    }


def health_report(logs: DataFrame, systems: DataFrame, as_of, hours: int = 24) -> dict[str, DataFrame]:
    """Scores of every system, the fleet's summary and factors, and a week of daily scores."""
    now = spans.as_datetime(as_of)
    scores = health.recent_health(logs, systems, now, hours)
    return {
        "systems": scores,
        "fleet": health.fleet_summary(scores),
        "factors": health.fleet_factors(scores),
        "trend": health.health_trend(logs, systems, now),
    }
