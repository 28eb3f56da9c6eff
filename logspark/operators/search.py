"""Search over log tables: filters, keyword match, sorting and paging."""

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from . import dims, spans
from .windows import top_n_per_group

# Request name of each sortable field and its column.
SORT_FIELDS = {
    "timestamp": "ts", "level": "level", "module": "module", "operation": "operation",
    "userId": "user_id", "responseTime": "response_time", "createTime": "ts",
}
MAX_PAGE_SIZE = 1000
MAX_RESULT_WINDOW = 10_000


@dataclass(frozen=True)
class LogQuery:
    """One search request. Every given condition must hold."""

    tenant_id: str | None = None
    system_ids: tuple[str, ...] = ()
    start: datetime | str | None = None
    end: datetime | str | None = None
    level: str | None = None
    user_id: str | None = None
    user_name: str | None = None
    module: str | None = None
    operation: str | None = None
    trace_id: str | None = None
    request_url: str | None = None
    request_method: str | None = None
    tags: tuple[str, ...] = ()
    keyword: str | None = None
    fuzzy: bool = True
    min_response_time: int | None = None
    max_response_time: int | None = None
    sort_field: str = "timestamp"
    sort_order: str = "desc"
    page: int = 1
    size: int = 20
    max_days: int = field(default=30, repr=False)
    max_keyword: int = field(default=200, repr=False)

    def check(self) -> "LogQuery":
        """Raise ValueError for requests that must not run."""
        if self.start is not None and self.end is not None:
            start, end = spans.as_datetime(self.start), spans.as_datetime(self.end)
            if start > end:
                raise ValueError("start must not be after end")
            if end - start >= timedelta(days=self.max_days + 1):
                raise ValueError(f"time range must not exceed {self.max_days} days")
        if self.keyword and len(self.keyword) > self.max_keyword:
            raise ValueError(f"keyword must not exceed {self.max_keyword} characters")
        low, high = self.min_response_time, self.max_response_time
        if (low is not None and low < 0) or (high is not None and high < 0):
            raise ValueError("response time bounds must not be negative")
        if low is not None and high is not None and low > high:
            raise ValueError("minimum response time must not exceed the maximum")
        if self.page < 1:
            raise ValueError("page must be at least 1")
        if not 1 <= self.size <= MAX_PAGE_SIZE:
            raise ValueError(f"page size must be between 1 and {MAX_PAGE_SIZE}")
        if self.page * self.size > MAX_RESULT_WINDOW:
            raise ValueError(f"only the first {MAX_RESULT_WINDOW} hits can be paged")
        if self.sort_field not in SORT_FIELDS:
            raise ValueError(f"cannot sort by {self.sort_field}")
        if self.sort_order.lower() not in ("asc", "desc"):
            raise ValueError("sort order must be asc or desc")
        return self

    def without_keyword(self) -> "LogQuery":
        return replace(self.check(), keyword=None)


def keyword_terms(keyword: str) -> list[str]:
    """Cleaned lower-case words of a keyword; runs on the request, not on data."""
    import re

    cleaned = re.sub(r"\s+", " ", re.sub(text.SEARCH_META, " ", keyword).strip()).lower()
    return [t for t in re.split(r"[\W]+", cleaned) if t]


def search(logs: DataFrame, query: LogQuery) -> DataFrame:
    """All matching rows, unsorted. Plain predicates come first, so they reach the scan."""
    query.check()
    df = spans.within(logs, query.start, query.end, inclusive_end=True)
    equal = {
        "tenant_id": query.tenant_id, "level": query.level, "user_id": query.user_id,
        "module": query.module, "operation": query.operation, "trace_id": query.trace_id,
        "request_url": query.request_url, "request_method": query.request_method,
    }
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if query.system_ids:
        df = df.filter(F.col("system_id").isin(*query.system_ids))
    if query.min_response_time is not None:
        df = df.filter(F.col("response_time") >= query.min_response_time)
    if query.max_response_time is not None:
        df = df.filter(F.col("response_time") <= query.max_response_time)
    if query.tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in query.tags])))
    if query.user_name:
        df = df.filter(text.matches_any(F.col("user_name"), keyword_terms(query.user_name)))
    if query.keyword:
        terms = keyword_terms(query.keyword)
        match = text.matches_fuzzy if query.fuzzy else text.matches_any
        df = df.filter(match(F.col("message"), terms)) if terms else df
    return df


def search_page(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One page in total order; a bounded top-k, so nothing but the page is ever sorted whole."""
    column = F.col(SORT_FIELDS[query.check().sort_field])
    order = column.asc() if query.sort_order.lower() == "asc" else column.desc()
    return (
        search(logs, query)
        .orderBy(order, F.col("id").asc())
        .offset((query.page - 1) * query.size)
        .limit(query.size)
    )


def search_total(logs: DataFrame, query: LogQuery) -> DataFrame:
    return search(logs, query).agg(F.count(F.lit(1)).alias("total"))


def trace(logs: DataFrame, trace_id: str, tenant_id: str | None = None, start=None, end=None) -> DataFrame:
    """All rows of a trace in time order. A tenant or a span, where known, keeps other partitions closed."""
    rows = spans.within(logs, start, end, inclusive_end=True).filter(F.col("trace_id") == trace_id)
    if tenant_id is not None:
        rows = rows.filter(F.col("tenant_id") == tenant_id)
    return rows.orderBy("ts", "id")


def _cross_system_matches(logs: DataFrame, systems: DataFrame, query: LogQuery) -> DataFrame:
    """Matches in enabled systems, with the catalogue's name; a system is a tenant and an id."""
    from dataclasses import replace

    return dims.of_enabled_systems(search(logs, replace(query, fuzzy=False)), systems)


def cross_system_page(logs: DataFrame, systems: DataFrame, query: LogQuery) -> DataFrame:
    """One page over the newest ``size`` matches of each enabled system."""
    newest = top_n_per_group(
        _cross_system_matches(logs, systems, query), dims.SYSTEM_KEY, [F.col("ts").desc(), F.col("id").asc()],
        query.size, spread_by="id",
    )
    return (
        newest.orderBy(F.col("ts").desc(), F.col("id").asc(), *dims.SYSTEM_KEY)
        .offset((query.page - 1) * query.size)
        .limit(query.size)
    )


def cross_system_stats(logs: DataFrame, systems: DataFrame, query: LogQuery) -> DataFrame:
    """Counts over all matches of each enabled system, not only those on a page."""
    return _cross_system_matches(logs, systems, query).groupBy(*dims.SYSTEM_KEY).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(F.col("level") == "ERROR").alias("error_count"),
        F.count_if(F.col("level") == "WARN").alias("warn_count"),
    )


def system_list(status: DataFrame, keyword: str | None = None, health_level: str | None = None,
                page: int = 1, size: int = 20) -> DataFrame:
    """Page of the system status report, best score first."""
    if keyword:
        status = status.filter(
            F.col("system_name").contains(keyword) | F.col("system_id").contains(keyword)
        )
    if health_level:
        status = status.filter(F.col("health_level") == health_level)
    return (
        status.orderBy(F.col("health_score").desc(), F.col("system_id"))
        .offset((page - 1) * size)
        .limit(size)
    )
