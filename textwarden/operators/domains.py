"""Registrable domains of hosts by public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.functions.detectors import SUFFIXES


def suffix_table(df: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """The rules as rows: ``rule``; ``*.`` and ``!`` forms as they are written."""
    return df.sparkSession.createDataFrame([(s,) for s in sorted(suffixes)], "rule string")


def registrable_domain(hosts: DataFrame, host: str, keys: list[str], rules: DataFrame | None = None) -> DataFrame:
    """``hosts`` with ``domain``: the label before the longest fitting suffix and that suffix, or null.

    Every tail of a host is probed by an equi-join; an exception rule (``!``)
    makes its own tail the domain, a wildcard rule stands for one more label.
    """
    rules = suffix_table(hosts) if rules is None else rules
    labels = F.split(F.col(host), r"\.")
    tails = hosts.select(*keys, host, labels.alias("labels"), F.posexplode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("skipped", "tail"))
    kind = F.when(F.col("rule").startswith("!"), 2).when(F.col("rule").startswith("*."), 1).otherwise(0)
    known = rules.select(kind.alias("kind"), F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("tail"))
    hits = tails.join(known, "tail")
    # Labels before the domain: one before a plain suffix, two before a wildcard's base, none before an exception.
    first = F.col("skipped") - F.element_at(F.array(F.lit(1), F.lit(2), F.lit(0)), F.col("kind") + 1)
    best = hits.groupBy(*keys).agg(F.max_by(F.struct("labels", first.alias("first")), F.struct(F.col("kind") == 2, F.lit(-1) * F.col("skipped") + F.when(F.col("kind") == 1, 1).otherwise(0))).alias("b"))
    domain = F.when(F.col("b.first") >= 0, F.array_join(F.slice("b.labels", F.col("b.first") + 1, F.size("b.labels")), "."))
    return hosts.join(best.select(*keys, domain.alias("domain")), keys, "left")
