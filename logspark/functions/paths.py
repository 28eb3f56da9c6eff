"""Read a rule's field path, such as ``extra.order.items[0].price``, from a log row."""

import re

from pyspark.sql import Column, functions as F

# Client spelling of each log field and its column.
FIELD_COLUMNS = {
    "id": "id", "traceId": "trace_id", "spanId": "span_id", "tenantId": "tenant_id",
    "systemId": "system_id", "systemName": "system_name", "timestamp": "ts", "level": "level",
    "logger": "logger", "thread": "thread", "className": "class_name",
    "methodName": "method_name", "lineNumber": "line_number", "message": "message",
    "exception": "exception", "userId": "user_id", "userName": "user_name", "module": "module",
    "operation": "operation", "requestUrl": "request_url", "requestMethod": "request_method",
    "requestParams": "request_params", "responseTime": "response_time",
    "statusCode": "status_code", "ip": "ip", "userAgent": "user_agent",
}
NUMERIC_FIELDS = ("lineNumber", "responseTime", "statusCode")
_STEP = re.compile(r"^([A-Za-z_][\w-]*)((?:\[\d+\])?)$")


def json_path(path: str) -> str | None:
    """JSON path inside ``extra``, or None when the path is no such thing."""
    steps = path.split(".")
    if steps[0] != "extra" or len(steps) < 2:
        return None
    out = "$"
    for step in steps[1:]:
        match = _STEP.match(step)
        if not match:
            return None
        out += f"['{match[1]}']{match[2]}"
    return out


def _tag_index(path: str) -> int | None:
    match = re.match(r"^tags\[(\d+)\]$", path)
    return int(match[1]) if match else None


def text_sql(path: str) -> str:
    """SQL of the value as text; null where the path leads nowhere."""
    if path in FIELD_COLUMNS:
        return f"CAST({FIELD_COLUMNS[path]} AS STRING)"
    if _tag_index(path) is not None:
        return f"get(tags, {_tag_index(path)})"
    inner = json_path(path)
    if inner is None:
        return "CAST(NULL AS STRING)"
    return f"""try_variant_get(try_parse_json(extra), "{inner}", 'string')"""


def number_sql(path: str) -> str:
    """SQL of the value as a number; null where it is missing or is not numeric JSON."""
    if path in NUMERIC_FIELDS:
        return f"CAST({FIELD_COLUMNS[path]} AS DOUBLE)"
    inner = json_path(path)
    if inner is None:
        return "CAST(NULL AS DOUBLE)"
    leaf = f"""try_variant_get(try_parse_json(extra), "{inner}", 'variant')"""
    return (
        f"CASE WHEN schema_of_variant({leaf}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' "
        f"THEN try_variant_get({leaf}, '$', 'double') END"
    )


def text_at(path: str) -> Column:
    return F.expr(text_sql(path))


def number_at(path: str) -> Column:
    return F.expr(number_sql(path))


def exists_at(path: str) -> Column:
    """True if the path is present, even when its value is null."""
    if path in FIELD_COLUMNS:
        return F.col(FIELD_COLUMNS[path]).isNotNull()
    if _tag_index(path) is not None:
        return F.coalesce(F.size("tags") > _tag_index(path), F.lit(False))
    inner = json_path(path)
    if inner is None:
        return F.lit(False)
    return F.try_variant_get(F.try_parse_json("extra"), inner, "variant").isNotNull()


# --- paths that are columns ---


def place_sql(path: str) -> str:
    """SQL of where a path column leads: the number of a log field, an index into the tags, or a JSON path in ``extra``.

    Worked out once a rule, so that a log row only has to follow it.
    """
    fields = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(FIELD_COLUMNS))
    return f"""named_struct(
        'field', CASE {path} {fields} END,
        'tag', try_cast(nullif(regexp_extract({path}, '^tags\\\\[(\\\\d+)\\\\]$', 1), '') AS INT),
        'json', CASE WHEN {path} RLIKE '^extra(\\\\.[A-Za-z_][\\\\w-]*(\\\\[\\\\d+\\\\])?)+$'
            THEN concat('$', regexp_replace(substr({path}, 6), '\\\\.([A-Za-z_][\\\\w-]*)', "['$1']")) END)"""


def text_behind(place: str) -> str:
    """SQL of the value behind a place, as text; null where it leads nowhere."""
    fields = " ".join(f"WHEN {i} THEN CAST({column} AS STRING)" for i, column in enumerate(FIELD_COLUMNS.values()))
    return f"""CASE WHEN {place}.field IS NOT NULL THEN CASE {place}.field {fields} END
        WHEN {place}.tag IS NOT NULL THEN get(tags, {place}.tag)
        WHEN {place}.json IS NOT NULL THEN try_variant_get(try_parse_json(extra), {place}.json, 'string') END"""


def number_behind(place: str) -> str:
    """SQL of the value behind a place, as a number; null where it is missing or is not numeric JSON."""
    names = list(FIELD_COLUMNS)
    fields = " ".join(f"WHEN {names.index(n)} THEN CAST({FIELD_COLUMNS[n]} AS DOUBLE)" for n in NUMERIC_FIELDS)
    leaf = f"try_variant_get(try_parse_json(extra), {place}.json, 'variant')"
    return f"""CASE WHEN {place}.field IS NOT NULL THEN CASE {place}.field {fields} END
        WHEN {place}.json IS NOT NULL AND schema_of_variant({leaf}) RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)'
        THEN try_variant_get({leaf}, '$', 'double') END"""
