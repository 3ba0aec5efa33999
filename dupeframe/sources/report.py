"""Report sinks and readers.

Every report starts as a table of lines or rows in report order, so a large one is written by
many tasks: the part files of a text, CSV or JSON document, taken in order, are the document.
"""

from __future__ import annotations

import datetime
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dupeframe import hadoop
from dupeframe.functions.fingerprint import LABELS
from dupeframe.operators.groups import report_order
from dupeframe.operators.skew import skew_join
from dupeframe.schemas import REPORT_DOCUMENT, REPORT_ROWS, SUMMARY
from dupeframe.staging import stage, stage_path, with_global_index

SUFFIXES = (".txt", ".json", ".csv")

# Texts of the report, in its language.
SCAN_TIME = "扫描时间: "
SCAN_FOLDERS = "扫描目录: "
NONE_FOUND = "扫描完成：未发现内容重复的文件。"
FOUND = "扫描完成：共发现 {} 组重复文件。"
RULE = "=========================================="
ELAPSED = "执行总耗时: {:.2f} 秒"
CSV_HEADER = ("Group", "Hash", "FilePath")


@dataclass
class Summary:
    total_files: int
    duplicate_groups: int
    elapsed_seconds: float = 0.0
    scan_folders: list[str] = field(default_factory=list)
    algorithm: str = "xxh3"
    scan_time: str = field(
        default_factory=lambda: datetime.datetime.now().strftime("%Y-%m-%d %H:%M:%S")
    )

    def as_row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.scan_time, round(self.elapsed_seconds, 2), self.total_files,
              self.duplicate_groups, list(self.scan_folders), self.algorithm)], SUMMARY
        )


@dataclass
class Report:
    summary: DataFrame
    members: DataFrame


def _lines(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(
        [(section, 0, number, line) for number, line in enumerate(lines)],
        "section int, group_idx long, line_no long, line string",
    )


def _member_lines(members: DataFrame, lines: Column) -> DataFrame:
    """Lines of section 1; ``lines`` is an array of (line_no, line) structs, NULLs dropped."""
    return (
        members.select("group_idx", F.explode(F.array_compact(lines)).alias("item"))
        .select(F.lit(1).alias("section"), "group_idx", "item.line_no", "item.line")
    )


def _line(number: Column, text: Column) -> Column:
    return F.struct(number.cast("long").alias("line_no"), text.alias("line"))


def text_lines(members: DataFrame, summary: Summary, with_scan: bool = True) -> DataFrame:
    """The text report as ``section, group_idx, line_no, line``; sort by the first three.

    ``with_scan=False`` leaves out the time and folder lines, as piped output does.
    """
    spark = members.sparkSession
    head = [SCAN_TIME + summary.scan_time, SCAN_FOLDERS + ", ".join(summary.scan_folders)]
    head = head if with_scan else []
    tail = [ELAPSED.format(summary.elapsed_seconds)]
    if not summary.duplicate_groups:
        return _lines(spark, 0, [*head, NONE_FOUND]).unionByName(_lines(spark, 2, tail))
    label = LABELS.get(summary.algorithm, summary.algorithm.upper())
    first = F.col("member_pos") == 1
    body = _member_lines(members, F.array(
        F.when(first, _line(F.lit(-1), F.lit(""))),
        F.when(first, _line(F.lit(0), F.concat(F.lit(f"{label}: "), F.col("hash")))),
        _line(F.col("member_pos"), F.concat(F.lit("  - "), F.col("path"))),
    ))
    return (
        _lines(spark, 0, [*head, FOUND.format(summary.duplicate_groups), RULE])
        .unionByName(body)
        .unionByName(_lines(spark, 2, [RULE, *tail]))
    )


def csv_lines(members: DataFrame) -> DataFrame:
    """The CSV report as lines, with fields quoted only where needed."""
    quoted = F.when(
        F.col("path").rlike('[",\r\n]'),
        F.concat(F.lit('"'), F.replace(F.col("path"), F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(F.col("path"))
    line = F.concat_ws(",", F.col("group_idx").cast("string"), F.col("hash"), quoted)
    body = _member_lines(members, F.array(_line(F.col("member_pos"), line)))
    return _lines(members.sparkSession, 0, [",".join(CSV_HEADER)]).unionByName(body)


def json_lines(members: DataFrame, summary: Summary) -> DataFrame:
    """The single JSON document (indent 2, not ASCII-escaped) as lines."""
    import json

    spark = members.sparkSession
    document = {
        "summary": {
            "scan_time": summary.scan_time,
            "elapsed_seconds": round(summary.elapsed_seconds, 2),
            "total_files": summary.total_files,
            "duplicate_groups": summary.duplicate_groups,
            "scan_folders": list(summary.scan_folders),
            "algorithm": summary.algorithm,
        },
        "duplicates": {},
    }
    text = json.dumps(document, ensure_ascii=False, indent=2).split("\n")
    if not summary.duplicate_groups:
        return _lines(spark, 0, text)
    # the last two lines are `"duplicates": {}` and the closing brace
    head = [*text[:-2], text[-2][:-1]]

    def literal(value: Column) -> Column:
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    first = F.col("member_pos") == 1
    last = F.col("member_pos") == F.col("n_members")
    last_group = F.col("group_idx") == F.lit(summary.duplicate_groups)
    body = _member_lines(members, F.array(
        F.when(first, _line(F.lit(0), F.concat(F.lit("    "), literal(F.col("hash")), F.lit(": [")))),
        _line(F.col("member_pos"), F.concat(
            F.lit("      "), literal(F.col("path")), F.when(last, F.lit("")).otherwise(F.lit(",")))),
        F.when(last, _line(F.col("member_pos") + 1, F.when(
            last_group, F.lit("    ]")).otherwise(F.lit("    ],")))),
    ))
    return _lines(spark, 0, head).unionByName(body).unionByName(_lines(spark, 2, ["  }", "}"]))


@contextmanager
def publication(spark: SparkSession, path: str) -> Iterator[str]:
    """A place beside ``path`` to write to, which takes the place of ``path`` at the end.

    A reader finds the earlier report, whole, until the new one is complete. If writing fails, or
    the swap does, the earlier report stays. File or folder may replace either.
    """
    parent, name = os.path.split(path.rstrip("/"))
    if parent:
        hadoop.mkdirs(spark, parent)
    beside = os.path.join(parent, f".{name}.{uuid.uuid4().hex}")
    try:
        yield beside
        hadoop.swap(spark, beside, path)
    finally:
        hadoop.delete(spark, beside)


def write_lines(lines: DataFrame, path: str, single_file: bool = False, line_sep: str = "\n") -> None:
    """Write lines in order, replacing what ``path`` holds: a folder of parts, or one file.

    Many tasks sort and write parts either way; for one file the parts' bytes are then appended
    to each other, so no task and no row grows with the report. (They pass through the driver, a
    buffer at a time.)
    """
    spark = lines.sparkSession
    with publication(spark, path) as beside:
        parts = stage_path(spark, "report") if single_file else beside
        lines.orderBy("section", "group_idx", "line_no").select("line").write.option(
            "lineSep", line_sep).text(parts)
        if single_file:
            names = [name for name in hadoop.list_names(spark, parts) if name.startswith("part-")]
            hadoop.concatenate(spark, [f"{parts}/{name}" for name in names], beside)


def write_report_txt(members: DataFrame, summary: Summary, path: str, single_file: bool = False) -> None:
    write_lines(text_lines(members, summary), path, single_file)


def write_report_csv(members: DataFrame, summary: Summary, path: str, single_file: bool = False) -> None:
    """CSV with header ``Group,Hash,FilePath``; each part of a folder has the header."""
    if single_file:
        write_lines(csv_lines(members), path, True, "\r\n")
        return
    rows = report_order(members).select(
        F.col("group_idx").alias("Group"), F.col("hash").alias("Hash"),
        F.col("path").alias("FilePath"),
    )
    with publication(members.sparkSession, path) as beside:
        rows.write.options(**CSV_OPTIONS).csv(beside)


# Spaces, quotes, backslashes and line ends in a path survive writing and reading.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Group long, Hash string, FilePath string").options(
        **CSV_OPTIONS, multiLine="true"
    ).csv(path)


def write_report_json(members: DataFrame, summary: Summary, path: str, single_file: bool = False) -> None:
    """The JSON document as one file, or as a folder in row form: ``summary`` with one object
    and ``members`` with one object per member, which is read back in parallel."""
    if single_file:
        write_lines(json_lines(members, summary), path, True)
        return
    with publication(members.sparkSession, path) as beside:
        summary.as_row(members.sparkSession).write.json(f"{beside}/summary")
        report_order(members).select(*REPORT_ROWS.names).write.json(f"{beside}/members")


_SINKS = {".txt": write_report_txt, ".json": write_report_json, ".csv": write_report_csv}


def check_report_paths(paths: list[str]) -> None:
    """Reject unknown suffixes on the driver, before a scan starts."""
    for path in paths:
        if os.path.splitext(path)[1].lower() not in SUFFIXES:
            raise ValueError(f"unsupported report format {path!r}, use one of {SUFFIXES}")


def write_reports(
    members: DataFrame, summary: Summary, paths: list[str], single_file: bool = False
) -> None:
    """Write several reports of one result; members are computed once."""
    check_report_paths(paths)
    if len(paths) > 1:
        members = stage(members, "members")
    for path in paths:
        _SINKS[os.path.splitext(path)[1].lower()](members, summary, path, single_file)


def read_report(spark: SparkSession, path: str, range_bytes: str | None = None) -> Report:
    """Read a JSON report in either form; members are in long form and report order is
    ``group_idx, member_pos``. Absent sections are empty; an empty group is one row with a
    NULL path and ``n_members`` 0. A document with an indent of 2 is read by many tasks, one
    that is written otherwise by one. ``range_bytes`` is the length of the document's ranges, if
    not that of ``spark.sql.files.maxPartitionBytes``; a task reads as many as make up its share."""
    if hadoop.is_directory(spark, f"{path}/members"):
        return Report(
            spark.read.schema(SUMMARY).json(f"{path}/summary"),
            spark.read.schema(REPORT_ROWS).json(f"{path}/members"),
        )
    by_lines = _read_by_lines(spark, path, range_bytes)
    if by_lines is not None:
        return by_lines
    document = spark.read.schema(REPORT_DOCUMENT).option("multiLine", "true").json(path)
    summary = document.select(
        F.coalesce("summary", F.lit(None).cast(SUMMARY)).alias("summary")
    ).select("summary.*")
    return Report(summary, _document_members(document))


# Bytes of a document that one task reads at least, in one range or in many, once all cores have work.
TASK_BYTES = 16 << 20

# Kinds of lines of a document that is written with an indent of 2, by what they begin and end with.
_KINDS = {
    "top": ("{", "{"),
    "bottom": ("}", "}"),
    "open": ('  "', '": {'),
    "shut": ('  "', '": {}'),
    "end": ("  }", "  }"),
    "head": ('    "', '": ['),
    "none": ('    "', '": []'),
    "member": ('      "', '"'),
    "tail": ("    ]", "    ]"),
}


def _classified(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a document as ``file, block, at, kind, text``.

    Spark reads a file in ranges; lines of a range follow each other in one task, so
    monotonically_increasing_id() counts them. ``text`` is a key or path as JSON has it, or the line.
    """
    line = F.regexp_replace("value", "[,\r ]*$", "")
    kind = F.coalesce(*[
        F.when(line.startswith(first) & line.endswith(last) & (F.length(line) >= F.lit(len(first) if first == last else len(first + last) - 1)),
               F.lit(name))
        for name, (first, last) in _KINDS.items()
        if name not in ("top", "bottom", "end", "tail")
    ], *[F.when(line == first, F.lit(name)) for name, (first, _) in _KINDS.items() if name in ("top", "bottom", "end", "tail")],
        F.lit("other"))
    literal = F.when(kind.isin("open", "shut", "head", "none"), F.regexp_extract(line, "(?s)^ *(\".*\"): [^\"]*$", 1)).when(
        kind == "member", F.ltrim(line)).otherwise(F.col("value"))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), kind.alias("kind"), literal.alias("text"))


def _plain(literal: Column) -> Column:
    """The string of a JSON string; NULL if it is none."""
    return F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))


def _staged_lines(spark: SparkSession, path: str, range_bytes: str | None) -> DataFrame:
    """``_classified``, staged. The tasks follow the bytes, not the ranges, however short these are:
    each task costs the driver some kilobytes. Only the document is read in such ranges."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-hadoop.length(spark, path) // TASK_BYTES))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, range_bytes or before)
    try:
        return stage(_classified(spark, path).coalesce(tasks), "report-lines")
    finally:
        spark.conf.set(key, before)


def _read_by_lines(spark: SparkSession, path: str, range_bytes: str | None = None) -> Report | None:
    """The document read by many tasks, if each key, path and bracket has its own line, as in
    reports with an indent of 2; None otherwise.

    The lines are sorted by their place into parts. The section and the group that a part starts in are
    those in which the parts before it end: the driver carries them on, with one row for each part,
    however many ranges there were. A member's position is the distance to its group's first line.
    """
    lines = _staged_lines(spark, path, range_bytes)
    files = lines.agg(F.min("file"), F.max("file")).first()
    if files[0] is None or files[0] != files[1]:
        return None
    events = F.col("kind").isin("open", "shut", "end", "bottom")
    lines = stage(lines.orderBy("block", "at").select(
        F.monotonically_increasing_id().alias("at"), "kind", "text"), "report-lines").withColumn(
        "part", F.shiftright("at", 33))
    parts = lines.groupBy("part").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(events, F.struct("at", "kind", "text"))).alias("event"),
        F.max(F.when(F.col("kind") == "head", F.col("at"))).alias("head"),
    ).collect()
    carried, total, section, head = [], 0, "", None
    for row in sorted(parts, key=lambda row: row["part"]):
        carried.append((row["part"], row["first"], total, section, head))
        if row["event"] is not None:
            section = row["event"]["text"] if row["event"]["kind"] == "open" else ""
        if row["head"] is not None:
            head = total + row["head"] - row["first"] + 1
        total += row["n"]
    starts = spark.createDataFrame(carried, "part long, first long, before long, section0 string, head0 long")
    order = Window.partitionBy("part").orderBy("at")
    known = lines.join(F.broadcast(starts), "part").withColumn(
        "line", F.col("before") + F.col("at") - F.col("first") + 1)
    own = F.when(F.col("kind") == "open", F.col("text")).when(events, F.lit(""))
    placed = stage(known.select(
        "line", "kind", "text",
        F.coalesce(F.last(own, True).over(order), "section0").alias("section"),
        F.coalesce(F.last(F.when(F.col("kind") == "head", F.col("line")), True).over(order), "head0").alias("head"),
    ), "report-lines")
    inside = (F.col("section") == '"duplicates"') & ~events
    value = F.when(F.col("kind").isin("head", "none", "member"), _plain(F.col("text")))
    checks = placed.agg(
        F.count_if(inside & ~F.col("kind").isin("head", "none", "member", "tail")).alias("foreign"),
        F.count_if(inside & F.col("kind").isin("head", "none", "member") & value.isNull()).alias("broken"),
        (F.count_if(inside & (F.col("kind") == "head")) - F.count_if(inside & (F.col("kind") == "tail"))).alias("open"),
        F.count_if((F.col("kind") == "open") & (F.col("text") == '"duplicates"')).alias("sections"),
        F.count_if(~F.col("text").isin('"summary"', '"duplicates"') & F.col("kind").isin("open", "shut")).alias("unknown"),
        F.count_if((F.col("section") != '"summary"') & (F.col("kind") == "other")).alias("loose"),
        F.max(F.struct("line", "kind")).alias("last"), F.min(F.struct("line", "kind")).alias("first"),
    ).first()
    whole = checks["first"]["kind"] == "top" and checks["last"]["kind"] == "bottom"
    if not whole or checks["sections"] > 1 or any(
            checks[k] for k in ("foreign", "broken", "open", "unknown", "loose")):
        return None
    return Report(_summary_of_lines(placed), _members_of_lines(placed.where(inside)))


def _summary_of_lines(placed: DataFrame) -> DataFrame:
    """The summary, which has a few lines and one for each scanned folder."""
    text = F.when(F.col("kind") == "other", F.col("text"))
    rows = placed.where("section = '\"summary\"' AND kind NOT IN ('open', 'end')").agg(F.array_sort(F.collect_list(
        F.struct("line", "kind", "text"))).alias("lines"))
    written = F.transform("lines", lambda x: F.when(x["kind"] == "head", F.concat(x["text"], F.lit(": [")))
                          .when(x["kind"] == "none", F.concat(x["text"], F.lit(": [],")))
                          .when(x["kind"] == "member", F.concat(x["text"], F.lit(",")))
                          .when(x["kind"] == "tail", F.lit("],")).otherwise(x["text"]))
    joined = F.regexp_replace(F.concat(F.lit("{"), F.array_join(written, "\n"), F.lit("}")), ",\\s*([\\]}])", "$1")
    return rows.select(F.from_json(joined, SUMMARY).alias("summary")).select("summary.*")


def _members_of_lines(lines: DataFrame) -> DataFrame:
    groups = lines.where("kind = 'tail'").select("head", (F.col("line") - F.col("head") - 1).alias("n_members")).join(
        lines.where("kind = 'head'").select("head", _plain(F.col("text")).alias("hash")), "head"
    ).unionByName(lines.where("kind = 'none'").select(
        F.col("line").alias("head"), F.lit(0).cast("long").alias("n_members"), _plain(F.col("text")).alias("hash")))
    # a repeated key keeps its first place and its last value
    unique = groups.groupBy("hash").agg(
        F.min("head").alias("_pos"), F.max(F.struct("head", "n_members")).alias("last"))
    numbered = stage(with_global_index(unique, ["_pos"], "group_idx").select(
        "group_idx", "hash", "last.*"), "report-groups")
    members = lines.where("kind = 'member'").select(
        "head", (F.col("line") - F.col("head")).alias("member_pos"), _plain(F.col("text")).alias("path"))
    joined = skew_join(members, numbered.where("n_members > 0"), ["head"], "n_members", ["member_pos"],
                       largest=numbered.agg(F.max("n_members")).first()[0] or 0)
    empty = numbered.where("n_members = 0").select(
        "group_idx", "hash", "n_members", F.lit(None).cast("long").alias("member_pos"),
        F.lit(None).cast("string").alias("path"))
    return joined.select(*empty.columns).unionByName(empty)


def _document_members(document: DataFrame) -> DataFrame:
    entries = document.select(F.posexplode("duplicates").alias("_pos", "hash", "paths"))
    # a repeated key keeps its first place and its last value
    unique = entries.groupBy("hash").agg(
        F.min("_pos").alias("_pos"), F.max_by("paths", "_pos").alias("paths")
    )
    numbered = with_global_index(unique, ["_pos"], "group_idx")
    return numbered.select(
        "group_idx", "hash",
        F.size("paths").cast("long").alias("n_members"),
        F.posexplode_outer("paths").alias("_member", "path"),
    ).select(
        "group_idx", "hash", "n_members",
        (F.col("_member") + 1).cast("long").alias("member_pos"), "path",
    )
