"""Logs, report sections, result tables and configuration."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Peak FLOPs by parts of a device's name, the more specific first.
PEAK_FLOPS = [
    (("gb200",), 2.5e15), (("grace blackwell",), 2.5e15), (("b200",), 2.25e15), (("b100",), 1.8e15), (("h200", "nvl"), 836e12), (("h200", "pcie"), 836e12), (("h200",), 989e12), (("h100", "nvl"), 835e12), (("h100", "pcie"), 756e12), (("h100",), 989e12), (("h800", "nvl"), 989e12), (("h800",), 756e12),
    (("a100",), 312e12), (("a800",), 312e12), (("a40",), 149.7e12), (("a30",), 165e12), (("l40s",), 362e12), (("l40-s",), 362e12), (("l40 s",), 362e12), (("l4",), 121e12), (("mi355",), 2.5e15), (("mi325",), 1.3074e15), (("mi300x",), 1.3074e15), (("mi300a",), 980.6e12), (("mi250x",), 383e12), (("mi250",), 362.1e12),
    (("5090",), 209.5e12), (("4090",), 165.2e12), (("3090",), 71e12),
]
#: Hourly rates by device, and of any other.
HOURLY_RATES, OTHER_RATE = [("H100", 3.00), ("A100", 1.79), ("V100", 0.55)], 2.0


def peak_flops(device: Column) -> Column:
    """Of the first row of the table whose parts all stand in the name; infinite for an unknown device."""
    name, out = F.lower(device), None
    for parts, flops in PEAK_FLOPS:
        found = F.lit(True)
        for part in parts:
            found &= name.contains(part)
        out = F.when(found, flops) if out is None else out.when(found, flops)
    return out.otherwise(F.lit(float("inf")))


def hourly_rate(device: Column, count: Column) -> Column:
    out = None
    for name, rate in HOURLY_RATES:
        out = F.when(device.contains(name), rate) if out is None else out.when(device.contains(name), rate)
    return out.otherwise(OTHER_RATE) * count


def value_text(value: Column, is_float: Column) -> Column:
    """Four decimals for floats, commas for whole numbers from 10,000."""
    return F.when(is_float, F.format_string("%.4f", value)).when(value >= 10000, F.format_number(value, 0)).otherwise(value.cast("long").cast("string"))


def last_values(lines: DataFrame, keys: list[str], by: list[str], line_no: str, line: str) -> DataFrame:
    """(by, key, value): of each key the text after the first colon of the last line that holds it, up to the next colon."""
    hits = lines.select(*by, line_no, line, F.explode(F.array(*map(F.lit, keys))).alias("key")).where(F.expr(f"contains({line}, key)"))
    return hits.groupBy(*by, "key").agg(F.max_by(F.trim(F.get(F.split(line, ":"), 1)), line_no).alias("value"))


def stamp(text: Column, prefix: str) -> Column:
    """The time after a prefix and a colon, on the first line that begins so and can be read; else null."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith(prefix))
    times = F.transform(lines, lambda x: F.try_to_timestamp(F.trim(F.substring_index(F.concat(x, F.lit("")), ":", -3)), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.get(F.filter(times, lambda t: t.isNotNull()), 0)


def last_stamp(sections: DataFrame, by: list[str], place: str, name: str, text: str) -> DataFrame:
    """(by, end): the time of the last section, in order of ``place``, that has one, those of reinforcement learning left out."""
    own = sections.where(~F.contains(F.col(name), F.lit("rl"))).withColumn("_t", stamp(F.col(text), "timestamp:"))
    return own.groupBy(*by).agg(F.max_by(F.when(F.col("_t").isNotNull(), F.col("_t")), F.when(F.col("_t").isNotNull(), F.col(place))).alias("end"))


_STAMP = re.compile(r"^(.*?): *(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) *$", re.MULTILINE)


def _time(text: str, prefix: str) -> datetime | None:
    for name, value in _STAMP.findall(text):
        if name == prefix:
            try:
                return datetime.strptime(value, "%Y-%m-%d %H:%M:%S")
            except ValueError:
                continue
    return None


def metric_order(names: set[str]) -> list[str]:
    """CORE first, ChatCORE last, the others by name."""
    return sorted(names, key=lambda n: (n != "CORE", n == "ChatCORE", n))


def assembled(sections: dict[str, str], expected: list[str], stages: dict[str, tuple[str, list[str]]]) -> str:
    """The text of a report: its header, its sections in the expected order, the code's size, metrics by stage, and the wall clock.

    A report has a few sections of a page each; this is the driver's work.
    """
    header = sections.get("header.md")
    there = [name for name in expected if name in sections]
    ends = [t for name in there if "rl" not in name and (t := _time(sections[name], "timestamp"))]
    start = _time(header, "Run started") if header is not None else None
    size = re.search(r"### Bloat\n(.*?)\n\n", header, re.DOTALL) if header is not None else None
    values = {stage: {k: v for k in names if (v := _value(sections[name], k))} for stage, (name, names) in stages.items() if name in sections}
    row = lambda cells: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(cells, [15] + [8] * len(stages), strict=True)) + "|\n"
    table = [row(["Metric", *(s.upper() for s in stages)]), "|" + "|".join("-" * (w + 2) for w in [15] + [8] * len(stages)) + "|\n"]
    table += [row([name, *(values.get(s, {}).get(name, "-") for s in stages)]) for name in metric_order({k for v in values.values() for k in v})]
    clock = "unknown"
    if start and ends:
        hours, rest = divmod(int((ends[-1] - start).total_seconds()), 3600)
        clock = f"{hours}h{rest // 60}m"
    bloat = (size[1] if size else "") if header is not None else "[bloat data missing]"
    return "".join([header or "", *(sections[name] + "\n" for name in there), "## Summary\n\n", bloat, "\n\n", *table, "\n", f"Total wall clock time: {clock}\n"])


def _value(section: str, key: str) -> str | None:
    """What follows a key's colon on the last line that holds the key, up to the next colon."""
    found = None
    for line in section.split("\n"):
        if key in line and ":" in line:
            found = line.split(":")[1].strip()
    return found


def wall_clock(start: Column, end: Column) -> Column:
    """Hours and minutes, ``unknown`` without both ends."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return F.when(seconds.isNull(), "unknown").otherwise(F.format_string("%dh%dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)))


def scraped(lines: DataFrame, by: list[str], line_no: str, line: str, patterns: dict[str, tuple[str, float | None]]) -> DataFrame:
    """One number per pattern: its last match without commas, or a fallback."""
    found = []
    for name, (pattern, fallback) in patterns.items():
        got = F.regexp_replace(F.regexp_extract(line, pattern, 1), ",", "")
        value = F.max_by(F.when(got != "", got), F.when(got != "", F.col(line_no))).cast("double")
        found.append((F.coalesce(value, F.lit(fallback)) if fallback is not None else value).alias(name))
    return lines.groupBy(*by).agg(*found)


def result_lines(results: DataFrame, core: str = "core") -> DataFrame:
    """(n, line): a padded table of task, accuracy and centred result, the mean of the centred ones last, without an accuracy."""
    from quern.operators.order import running

    rows = running(results, [F.col("task")]).select((F.col("pos") + 1).alias("n"), F.concat(F.rpad("task", 35, " "), F.lit(", "), F.rpad(F.format_string("%.6f", "accuracy"), 10, " "), F.lit(", "), F.rpad(F.format_string("%.6f", "centered"), 10, " ")).alias("line"))
    last = results.agg((F.count("*") + 1).alias("n"), F.concat(F.rpad(F.lit("CORE"), 35, " "), F.lit(", "), F.lit(" " * 10), F.lit(", "), F.rpad(F.format_string("%.6f", F.avg("centered")), 10, " ")).alias("line"))
    return rows.unionByName(last)


def parsed_results(lines: DataFrame, line: str) -> DataFrame:
    """(task, accuracy, centered) of such a table: cells trimmed, blanks null, rows without numbers skipped."""
    cells = F.split(line, ",")
    cell = lambda k: F.nullif(F.trim(F.get(cells, k)), F.lit(""))
    return lines.select(cell(0).alias("task"), F.expr("1").alias("_"), cell(1).try_cast("double").alias("accuracy"), cell(2).try_cast("double").alias("centered")).drop("_").where("centered is not null")


def merged_setting(given: Column, stored: Column, default: Column) -> tuple[Column, Column]:
    """The value given, else the stored, else the default; and which of them it is."""
    return F.coalesce(given, stored, default), F.when(given.isNotNull(), "given").when(stored.isNotNull(), "stored").otherwise("default")
