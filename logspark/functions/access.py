"""Classification of gateway requests and method calls."""

from pyspark.sql import Column, functions as F

SLOW_MS = 5000
# Message endings of failed, slow and finished method calls.
CALL_FAILED, CALL_SLOW, CALL_DONE = "执行异常: ", "执行缓慢", "执行完成"
# Paths that produce no access log.
EXCLUDED_PREFIXES = ("/actuator", "/health", "/favicon.ico")


def access_level(status: Column, response_time: Column, slow_ms: int = SLOW_MS) -> Column:
    return (
        F.when(status >= 500, "ERROR")
        .when(status >= 400, "WARN")
        .when(response_time > slow_ms, "WARN")
        .otherwise("INFO")
    )


def access_tags(status: Column, response_time: Column, slow_ms: int = SLOW_MS) -> Column:
    return F.array_compact(
        F.array(
            F.lit("gateway"),
            F.when(response_time > slow_ms, "slow-request"),
            F.when((status >= 400) & (status < 500), "client-error"),
            F.when(status >= 500, "server-error"),
        )
    )


def access_message(method: Column, path: Column, status: Column, response_time: Column) -> Column:
    return F.format_string("%s %s -> %d (%dms)", method, path, status, response_time)


def call_level(exception: Column, response_time: Column, slow_ms: int = SLOW_MS) -> Column:
    return (
        F.when(exception.isNotNull(), "ERROR")
        .when(response_time > slow_ms, "WARN")
        .otherwise("INFO")
    )


def call_tags(layer: Column, exception: Column, response_time: Column, slow_ms: int = SLOW_MS) -> Column:
    return F.array_compact(
        F.array(
            F.lower(layer),
            F.when(response_time > slow_ms, "slow-request"),
            F.when(exception.isNotNull(), "exception"),
        )
    )


def call_message(cls: Column, method: Column, exception: Column, response_time: Column,
                 slow_ms: int = SLOW_MS) -> Column:
    call = F.concat(cls, F.lit("."), method, F.lit("() "))
    took = F.concat(F.lit(" ("), response_time.cast("string"), F.lit("ms)"))
    return (
        F.when(exception.isNotNull(), F.concat(call, F.lit(CALL_FAILED), exception))
        .when(response_time > slow_ms, F.concat(call, F.lit(CALL_SLOW), took))
        .otherwise(F.concat(call, F.lit(CALL_DONE), took))
    )


def is_excluded(path: Column, paths=(), prefixes=EXCLUDED_PREFIXES) -> Column:
    out = path.isin(*paths) if paths else F.lit(False)
    for prefix in prefixes:
        out = out | path.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def client_ip(headers: list[Column], remote: Column) -> Column:
    """First usable proxy header, and of a comma list its first item."""
    usable = [
        F.when(
            (h != "") & (F.lower(h) != "unknown"),
            F.when(h.contains(","), F.trim(F.split(h, ",")[0])).otherwise(h),
        )
        for h in headers
    ]
    return F.coalesce(*usable, remote, F.lit("unknown"))


def module_of(class_name: Column, class_map: dict, package_map: dict, default: str) -> Column:
    """Module of a class: exact mapping, else the longest matching package prefix."""
    out = F
    for name, module in class_map.items():
        out = out.when(class_name == name, module)
    for prefix in sorted(package_map, key=len, reverse=True):
        out = out.when(class_name.startswith(prefix), package_map[prefix])
    return out.otherwise(default) if out is not F else F.lit(default)
