"""Names and targets made fit to be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detectors import ScanConfig
from textwarden.operators import redact, scan

LOOKED_AT, KEPT, LABEL = 512, 120, 120


def display_label(name: Column, fallback: str = "unknown") -> Column:
    """A printable, non-blank name of at most 120 characters, else the fallback."""
    fit = (F.length(name) <= LABEL) & ~name.rlike(r"[\p{Cntrl}]") & name.rlike(r"\S")
    return F.when(F.coalesce(fit, F.lit(False)), name).otherwise(fallback)


def base_name(target: Column) -> Column:
    """The last part of a path; URLs whole."""
    return F.when(F.contains(target, F.lit("://")), target).otherwise(F.element_at(F.split(F.regexp_replace(target, r"[/\\]+$", ""), r"[/\\]"), -1))


def scrub(df: DataFrame, name: str, config: ScanConfig | None = None) -> DataFrame:
    """``df`` with ``name`` redacted: each different name is scanned once."""
    distinct = df.select(F.col(name).alias("_name")).distinct().where("_name is not null")
    found = scan.scan(distinct.withColumn("_text", F.col("_name")), "_text", ["_name"], config).withColumn("value", F.expr("substring(_name, value_start + 1, value_end - value_start)"))
    clean = redact.redact(distinct, "_name", ["_name"], redact.number_values(found, ["_name"], ["start"]))
    return df.join(clean, F.col(name) == F.col("_name"), "left").withColumn(name, F.coalesce("redacted", name)).select(*df.columns)


def scrub_target(df: DataFrame, target: str = "target", config: ScanConfig | None = None) -> DataFrame:
    """``df`` with targets as they may be kept: the last 512 printable characters, redacted, the last 120 of those after an ellipsis."""
    printable = F.right(F.regexp_replace(target, r"[\p{Cntrl}]", ""), F.lit(LOOKED_AT))
    scrubbed = scrub(df.withColumn(target, printable), target, config)
    return scrubbed.withColumn(target, F.when(F.length(target) > KEPT, F.concat(F.lit("…"), F.right(target, F.lit(KEPT)))).otherwise(F.col(target)))
