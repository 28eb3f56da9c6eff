"""Log level names and their order."""

from pyspark.sql import Column, functions as F

# Accepted spellings of each level.
LEVEL_NAMES = {
    "WARN": ("WARN", "WARNING"),
    "ERROR": ("ERR", "ERROR", "SEVERE"),
    "FATAL": ("FATAL", "CRITICAL"),
    "TRACE": ("TRACE", "FINEST"),
    "DEBUG": ("DEBUG", "FINE"),
}
# Alert levels, most urgent first.
ALERT_PRIORITY = {"CRITICAL": 1, "WARNING": 2, "INFO": 3}
OTHER_PRIORITY = 999


def canonical_level(level: Column) -> Column:
    name = F.upper(F.trim(level))
    out = F
    for canonical, names in LEVEL_NAMES.items():
        out = out.when(name.isin(*names), canonical)
    return out.otherwise("INFO")


def alert_priority(level: Column) -> Column:
    out = F
    for name, rank in ALERT_PRIORITY.items():
        out = out.when(F.upper(level) == name, rank)
    return out.otherwise(OTHER_PRIORITY)


def alert_level_or_info(level: Column) -> Column:
    name = F.upper(level)
    return F.when(name.isin(*ALERT_PRIORITY), name).otherwise("INFO")
