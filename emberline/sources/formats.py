"""Line formats: each turns a frame of raw lines into log entries.

Input frames have ``value`` (one line) and, for the formats that name the host
after a file, ``host``. Other columns pass through. A line is matched once: the
wanted groups are joined with newlines (a line holds none) and split again.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F

from ..functions import levels, text, times
from ..schemas import ENTRY_FIELDS

# --- Fixed values: line patterns. (?Ud): Unicode classes, only \n ends a line. ---
LINUX_PATTERN = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+(\S+?)(?:\[\d+\])?:\s+(.*)$"
SSH_PATTERN = r"^(\w+\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+sshd\[(\d+)\]:\s+(.*)$"
JAVA_APP_PATTERN = (
    r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\s+(INFO|WARN|ERROR|FATAL|DEBUG)\s+\[([^\]]+)\]\s+(\S+):\s+(.*)$"
)
BGL_TAIL = (
    r"\s+\d+\s+\S+\s+\S+\s+(\d{4}-\d{2}-\d{2}-\d{2}\.\d{2}\.\d{2}\.\d+)\s+(\S+)\s+\S+\s+\S+\s+"
    r"(INFO|WARN|WARNING|ERROR|FATAL|SEVERE)\s+(.*)$"
)
BGL_PATTERN = "^-" + BGL_TAIL
BGL_PATTERN_WITH_ALERTS = r"^\S+" + BGL_TAIL
ANDROID_PATTERN = (
    r"^(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+\d+\s+\d+\s+([VDIWEF])\s+(\S+?)\s*:\s+(.*)$"
)
BGL_COMPONENT = "RAS_KERNEL"
ANDROID_HOST = "android-device"
HDFS_HOST = "hdfs-cluster"
EMPTY_TRACE = "empty trace"
TRACE_EVENTS_SHOWN = 5
# --- End of fixed values. ---

JAVA_FLAGS = "(?Ud)"


def _matched(lines: DataFrame, pattern: str, groups: list[int], flags: str = JAVA_FLAGS) -> DataFrame:
    """Adds ``_line`` (trimmed) and ``_part`` (wanted groups); drops lines that do not match.

    A line that does not match keeps its one part, so its parts are too few. The row is made by a generator, which
    keeps the optimizer from pulling the match into both a filter and a projection.
    """
    joined = "\n".join(f"${g}" for g in groups)
    made = F.transform(F.array(text.right_trimmed(F.col("value"))), lambda line: F.struct(
        line.alias("_line"), F.split(F.regexp_replace(line, flags + pattern, joined), "\n", len(groups)).alias("_part")))
    return lines.select("*", F.inline(F.filter(made, lambda m: F.size(m["_part"]) == len(groups))))


def _entries(matched: DataFrame, **columns: Column) -> DataFrame:
    kept = [c for c in matched.columns if c not in ("_line", "_part", "value", *ENTRY_FIELDS)]
    made = {**columns, "raw": F.col("_line")}
    return matched.select(*kept, *[made[name].alias(name) for name in ENTRY_FIELDS])


def _part(i: int) -> Column:
    return F.get("_part", F.lit(i))


def parse_linux(lines: DataFrame, reference_year: int) -> DataFrame:
    rows = _matched(lines, LINUX_PATTERN, [1, 2, 3, 4])
    return _entries(
        rows, timestamp=times.syslog_time(_part(0), reference_year), source=F.lit("linux"), host=_part(1),
        level=levels.linux_level(_part(3)), component=_part(2), message=_part(3),
    )


def parse_ssh(lines: DataFrame, reference_year: int) -> DataFrame:
    rows = _matched(lines, SSH_PATTERN, [1, 2, 3, 4])
    return _entries(
        rows, timestamp=times.syslog_time(_part(0), reference_year), source=F.lit("ssh"), host=_part(1),
        level=levels.ssh_level(_part(3)), component=F.concat(F.lit("sshd["), _part(2), F.lit("]")),
        message=_part(3),
    )


def _parse_java_app(lines: DataFrame, source: str) -> DataFrame:
    rows = _matched(lines, JAVA_APP_PATTERN, [1, 2, 4, 5])
    return _entries(
        rows, timestamp=times.comma_time(_part(0)), source=F.lit(source), host=F.col("host"),
        level=_part(1), component=_part(2), message=_part(3),
    )


def parse_hadoop(lines: DataFrame) -> DataFrame:
    return _parse_java_app(lines, "hadoop")


def parse_spark_app(lines: DataFrame) -> DataFrame:
    return _parse_java_app(lines, "spark")


def parse_bgl(lines: DataFrame, include_alerts: bool = False) -> DataFrame:
    """Lines tagged with an alert label are dropped unless ``include_alerts``."""
    pattern = BGL_PATTERN_WITH_ALERTS if include_alerts else BGL_PATTERN
    rows = _matched(lines, pattern, [1, 2, 3, 4], "(?iUd)")
    return _entries(
        rows, timestamp=times.bgl_time(_part(0)), source=F.lit("supercomputer"), host=_part(1),
        level=levels.bgl_level(_part(2)), component=F.lit(BGL_COMPONENT), message=_part(3),
    )


def parse_android(lines: DataFrame, reference_year: int) -> DataFrame:
    rows = _matched(lines, ANDROID_PATTERN, [1, 2, 3, 4])
    return _entries(
        rows, timestamp=times.android_time(_part(0), reference_year), source=F.lit("android"),
        host=F.lit(ANDROID_HOST), level=levels.android_level(_part(1)), component=_part(2), message=_part(3),
    )


def trace_summary(names: list[str]) -> Column:
    """First five events with a positive count as ``event=count``, in column order."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("event"), F.col(f"`{name}`").try_cast("double").alias("n")) for name in names
    ])
    shown = F.slice(F.filter(pairs, lambda p: p["n"] > 0), 1, TRACE_EVENTS_SHOWN)
    text_of = F.transform(shown, lambda p: F.concat(p["event"], F.lit("="), p["n"].cast("bigint").cast("string")))
    joined = F.array_join(text_of, "; ")
    return F.when(joined == "", F.lit(EMPTY_TRACE)).otherwise(joined)


def parse_hdfs_trace(rows: DataFrame, task_column: str, event_columns: list[str], batch_time: str,
                     failure: Column) -> DataFrame:
    """One entry per task row of event counts; cells that are no numbers count as absent."""
    kept = [c for c in rows.columns if c not in (task_column, *event_columns, *ENTRY_FIELDS)]
    cells = F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in [task_column, *event_columns]])
    made = {
        "timestamp": F.lit(batch_time), "source": F.lit("hdfs"), "host": F.lit(HDFS_HOST),
        "level": F.when(failure, F.lit("ERROR")).otherwise(F.lit("INFO")),
        "component": F.concat(F.lit("task:"), F.col(f"`{task_column}`")),
        "message": trace_summary(event_columns), "raw": F.array_join(cells, ","),
    }
    return rows.select(*kept, *[made[name].alias(name) for name in ENTRY_FIELDS])


def unparsed(lines: DataFrame, pattern: str, flags: str = JAVA_FLAGS) -> DataFrame:
    """Non-blank lines no pattern matched, kept so that losses can be counted."""
    line = text.right_trimmed(F.col("value"))
    return lines.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").rlike(flags + pattern))


