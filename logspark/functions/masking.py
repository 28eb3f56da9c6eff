"""Masking of personal data and secrets."""

from pyspark.sql import Column, functions as F

# Pattern and replacement of each mask, in the order they must run.
MASKS = {
    "phone": (r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2"),
    "national_id": (r"(?<!\d)(\d{3})\d{11}(\d{3}[\dXx])(?!\d)", "$1***********$2"),
    "email": (r"\b([\w.%-])[\w.%-]++(@[\w.-]+\.[A-Za-z]{2,}\b)", "$1***$2"),
    "bank_card": (r"(?<!\d)(\d{4})\d{5,11}(\d{4})(?!\d)", "$1 **** **** $2"),
    "ipv4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "*.*.*.*"),
}
# Keys of ``extra`` whose values are never stored.
SECRET_KEYS = (
    "password", "pwd", "token", "secret", "key", "authorization", "auth", "apikey", "api_key",
)


def mask_text(text: Column, kinds=tuple(MASKS)) -> Column:
    """Masked text. The costly e-mail pattern runs only on texts with an ``@``; no mask adds one."""
    masked = text
    for kind in MASKS:
        if kind in kinds:
            done = F.regexp_replace(masked, *MASKS[kind])
            masked = F.when(text.contains("@"), done).otherwise(masked) if kind == "email" else done
    return masked


def mask_user_name(name: Column) -> Column:
    return F.when(F.length(name) > 1, F.concat(F.substring(name, 1, 1), F.lit("**"))).otherwise(name)


def redact_secrets(variant: str) -> Column:
    """JSON text of a VARIANT column with secret top-level keys replaced; other shapes pass."""
    keys = ", ".join(f"'{k}'" for k in SECRET_KEYS)
    return F.expr(
        f"""coalesce(
            to_json(transform_values(
                try_variant_get({variant}, '$', 'map<string,variant>'),
                (k, v) -> if(lower(k) in ({keys}), parse_json('"***"'), v))),
            to_json({variant}))"""
    )


def mask_api_key(key: Column) -> Column:
    """Only the last eight characters of the stored hash are shown."""
    return F.concat(F.lit("sk_****"), F.right(F.md5(key), F.lit(8)))
