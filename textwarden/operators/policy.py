"""What may be done with an event: direction, mode, action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.operators.records import session_lives
from textwarden.operators.sweep import inside_one

# The directions, the modes and what each mode of a direction leads to.
MODES = ("observe", "warn", "enforce")
DEFAULT_MODES = {"prompt": "enforce", "inbound": "enforce", "local": "observe", "executable": "warn", "local_write": "warn", "outbound": "enforce", "model_output": "observe"}
#: Tools of a client and the direction of their calls; a job passes its own.
TOOLS = (("Read", "local"), ("Glob", "local"), ("Grep", "local"), ("Question", "local"), ("Bash", "executable"), ("Write", "local_write"), ("Edit", "local_write"), ("WebFetch", "outbound"), ("WebSearch", "outbound"))


def direction_of(events: DataFrame, tools: DataFrame, event: str = "event", tool: str = "tool_name") -> DataFrame:
    """``events`` with ``direction``: a prompt, a result (inbound), or by its tool; unknown and remote tools are outbound."""
    known = tools.select(F.col("tool").alias(tool), F.col("direction").alias("_kind"))
    joined = events.join(known, tool, "left")
    remote = F.col(tool).startswith("mcp__")
    direction = (
        F.when(F.col(event) == "prompt", "prompt")
        .when((F.col(event) == "result") & (F.col(tool) == "Question"), "local")
        .when(F.col(event) == "result", "inbound")
        .when(F.col(event) == "output", "model_output")
        .when(remote | F.col("_kind").isNull(), "outbound")
        .otherwise(F.col("_kind"))
    )
    return joined.withColumn("direction", direction).drop("_kind")


def mode_of(direction: Column, tool: Column, event: Column, modes: dict[str, str]) -> Column:
    """The first mode set for the tool, the event, the direction, ``default``; else that of the direction as shipped."""
    given = F.create_map(*[F.lit(x) for pair in (modes or {"": ""}).items() for x in pair])
    shipped = F.create_map(*[F.lit(x) for pair in DEFAULT_MODES.items() for x in pair])
    return F.coalesce(F.element_at(given, tool), F.element_at(given, event), F.element_at(given, direction), F.element_at(given, F.lit("default")), F.element_at(shipped, direction))


def action_of(direction: Column, mode: Column, can_rewrite: Column) -> Column:
    """allow, report, mask or deny; what can't be rewritten is denied where it would be masked."""
    wanted = F.when(mode == "observe", "allow").when(mode == "warn", "report").when(direction.isin("prompt", "executable"), "deny").when(direction == "model_output", "report").otherwise("mask")
    return F.when((wanted == "mask") & ~can_rewrite, "deny").otherwise(wanted)


def weakened_modes(modes: dict[str, str]) -> list[str]:
    """Directions shipped as enforce that a lower ``default`` replaces."""
    default = modes.get("default")
    if default in (None, "enforce"):
        return []
    return sorted(d for d, m in DEFAULT_MODES.items() if m == "enforce" and d not in modes)


def entity_scope(findings: DataFrame, scopes: DataFrame, everywhere: list[str]) -> DataFrame:
    """Findings of the types that are enabled: for their tool, else for their event, else everywhere.

    ``scopes``: ``kind`` (tool or event), ``name``, ``entities``.
    """
    of = lambda kind: scopes.where(F.col("kind") == kind).select(F.col("name").alias(f"_{kind}"), F.col("entities").alias(f"{kind}_entities"))
    joined = findings.join(of("tool"), F.col("tool_name") == F.col("_tool"), "left").join(of("event"), F.col("event") == F.col("_event"), "left")
    enabled = F.coalesce("tool_entities", "event_entities", F.array(*[F.lit(e) for e in everywhere]))
    return joined.where(F.array_contains(enabled, F.col("entity"))).select(*findings.columns)


def write_back_check(written: DataFrame, issued: DataFrame) -> DataFrame:
    """Placeholders (``session_id, entity, number``) that were issued in their session (``first`` to ``last``)."""
    return inside_one(written, issued, ["session_id", "entity"], "number", "number", "first", "last")


def issue_new_runs(new: DataFrame, kept: DataFrame) -> DataFrame:
    """Runs of numbers that lie in no run already kept."""
    return inside_one(new, kept, ["session_id", "entity"], "first", "last", "first", "last", inside=False)


#: Numbers are found through blocks of this to the power of a level, and of so many levels: 16 ** 5 numbers and beyond in blocks of the last.
FAN, LEVELS = 16, 6


def _blocks_of_run(level: int) -> Column:
    """Blocks of one level that a run covers and whose own block, a level up, it does not."""
    size = FAN**level
    low, high = F.ceil(F.col("first") / size), F.floor((F.col("last") + 1) / size)
    if level == LEVELS - 1:
        return _range(low, high)
    up_low, up_high = F.ceil(F.col("first") / (size * FAN)) * FAN, F.floor((F.col("last") + 1) / (size * FAN)) * FAN
    return F.when(up_low < up_high, F.concat(_range(low, up_low), _range(up_high, high))).otherwise(_range(low, high))


def _range(low: Column, high: Column) -> Column:
    return F.when(low < high, F.sequence(low.cast("long"), (high - 1).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))


def refusals(events: DataFrame, idle_minutes: int = 24 * 60) -> DataFrame:
    """The verdict on each placeholder that a session writes: refused if it was issued in the session before, else free.

    ``events``: ``session_id, ts, seq, kind`` (issue, write, session_end),
    ``entity, first, last``; a write has its number in ``first``. After a run that can't be
    read (a null, or an end before its start) the writes of the session are unchecked.
    A session's end, or a pause longer than ``idle_minutes``, forgets its runs. Different events may share
    ``ts`` and ``seq``: all count, in the order of kind, entity, first and last; only equal ones are one.

    Runs become blocks of aligned numbers, at most 30 a level, each with the moment that
    first covered it; a write looks its number up at each level. No join is on a range.
    """
    lives = session_lives(events, idle_minutes, ("kind", "entity", "first", "last")).select("session_id", "life", "_pos", "ts", "seq", "kind", "entity", "first", "last")
    issues = lives.where("kind = 'issue'")
    readable = F.coalesce(F.col("entity").isNotNull() & (F.col("first") <= F.col("last")), F.lit(False))
    place = F.flatten(F.array(*[F.transform(_blocks_of_run(level), _at_level(level)) for level in range(LEVELS)]))
    blocks = issues.where(readable).select("session_id", "life", "entity", "_pos", F.explode(place).alias("place")).groupBy("session_id", "life", "entity", "place").agg(F.min("_pos").alias("issued_at"))
    damaged = issues.where(~readable).groupBy("session_id", "life").agg(F.min("_pos").alias("damaged_at"))
    writes = lives.where("kind = 'write'").drop("kind", "last")
    asked = F.array(*[_at_level(level)(F.floor(F.col("first") / FAN**level).cast("long")) for level in range(LEVELS)])
    looked = writes.select("*", F.explode(asked).alias("place")).join(blocks, ["session_id", "life", "entity", "place"], "left")
    found = looked.groupBy("session_id", "life", "_pos", "ts", "seq", "entity", "first").agg(F.min("issued_at").alias("issued_at"))
    judged = found.join(damaged, ["session_id", "life"], "left")
    verdict = F.when(F.col("damaged_at") < F.col("_pos"), "unchecked").when(F.col("issued_at") < F.col("_pos"), "refused").otherwise("free")
    return judged.select("session_id", "seq", F.col("ts").alias("at"), "entity", F.col("first").alias("number"), verdict.alias("verdict"))


def _at_level(level: int):
    return lambda block: F.struct(F.lit(level).alias("level"), block.alias("block"))
