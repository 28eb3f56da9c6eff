"""Turn the timestamp forms clients send into an instant."""

from pyspark.sql import Column, functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)?(\[[^\]]+\])?$"
_DASHED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{3})?$"
_SLASHED = r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"
_INT_MAX = 2**31 - 1
_MILLIS_MAX = 253402300799999  # last millisecond of the year 9999


def from_epoch_millis(value: Column) -> Column:
    return F.when(F.abs(value) <= _MILLIS_MAX, F.timestamp_millis(value))


def parse_text(text: Column) -> Column:
    """Digits (ten of them are seconds, any other count milliseconds) or a date pattern."""
    digits = F.when(text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("bigint"))
    dated = F.when(
        text.rlike(_ISO), F.regexp_replace(text, r"\[[^\]]+\]$", "")
    ).when(text.rlike(_DASHED), text).when(text.rlike(_SLASHED), F.replace(text, F.lit("/"), F.lit("-")))
    return (
        F.when(digits.isNull(), dated.try_cast("timestamp"))
        .when(F.length(text) == 10, F.timestamp_seconds(digits))
        .otherwise(from_epoch_millis(digits))
    )


def parse_variant(value: str) -> Column:
    """Same for a JSON value in a VARIANT column: small integers are seconds, larger ones milliseconds."""
    kind = F.schema_of_variant(F.col(value))
    number = F.expr(f"try_variant_get({value}, '$', 'bigint')")
    text = F.expr(f"try_variant_get({value}, '$', 'string')")
    return (
        F.when((kind == "BIGINT") & (F.abs(number) <= _INT_MAX), F.timestamp_seconds(number))
        .when(kind == "BIGINT", from_epoch_millis(number))
        .when(kind == "STRING", parse_text(text))
    )
