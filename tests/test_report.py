import csv
import io
import json

import pytest
from conftest import make_tree, rows

from dupeframe import scan_tree
from dupeframe.schemas import MEMBERS
from dupeframe.sources import report
from dupeframe.sources.actions import read_actions

GROUPS = {
    "h1": ["/path/a", "/path/b"],
    "h2": ['/q"uote', "/com,ma", "/back\\slash", " /lead", "/trail ", "/ünï😀", "/new\nline", "/ret\rurn", "/tab\tx"],
}


def members(spark, groups=GROUPS):
    data = [
        (g, h, len(paths), p, path, 1, 0.0)
        for g, (h, paths) in enumerate(groups.items(), start=1)
        for p, path in enumerate(paths, start=1)
    ]
    return spark.createDataFrame(data, MEMBERS).repartition(3)


def summary(groups=GROUPS, **changes):
    facts = dict(total_files=5, duplicate_groups=len(groups), elapsed_seconds=1.234,
                 scan_folders=["/path", "/ü"], algorithm="xxh3", scan_time="2024-01-02 03:04:05")
    return report.Summary(**{**facts, **changes})


def document(groups, facts):
    return {
        "summary": {
            "scan_time": facts.scan_time, "elapsed_seconds": round(facts.elapsed_seconds, 2),
            "total_files": facts.total_files, "duplicate_groups": len(groups),
            "scan_folders": facts.scan_folders, "algorithm": facts.algorithm,
        },
        "duplicates": groups,
    }


@pytest.mark.parametrize("groups", [GROUPS, {}], ids=["groups", "none"])
def test_json_document(spark, tmp_path, groups):
    path = tmp_path / "new" / "r.json"
    report.write_report_json(members(spark, groups), summary(groups), str(path), single_file=True)
    expected = json.dumps(document(groups, summary(groups)), ensure_ascii=False, indent=2)
    assert path.read_text(encoding="utf-8").rstrip("\n") == expected


def test_json_document_without_folders(spark, tmp_path):
    path = tmp_path / "r.json"
    facts = summary(scan_folders=[])
    report.write_report_json(members(spark), facts, str(path), single_file=True)
    assert json.loads(path.read_text(encoding="utf-8")) == document(GROUPS, facts)


def _long(groups=GROUPS):
    return sorted(
        [(g, h, len(paths), p, path) for g, (h, paths) in enumerate(groups.items(), start=1)
         for p, path in enumerate(paths, start=1)], key=repr)


@pytest.mark.parametrize("single_file", [True, False])
def test_json_is_read_back(spark, tmp_path, single_file):
    path = f"{tmp_path}/r.json"
    report.write_report_json(members(spark), summary(), path, single_file)
    read = report.read_report(spark, path)
    assert rows(read.members) == _long()
    facts = read.summary.first()
    assert (facts.total_files, facts.duplicate_groups, facts.elapsed_seconds) == (5, 2, 1.23)
    assert facts.scan_folders == ["/path", "/ü"] and facts.scan_time == "2024-01-02 03:04:05"


def test_csv_bytes_equal_a_csv_writer(spark, tmp_path):
    path = tmp_path / "r.csv"
    report.write_report_csv(members(spark), summary(), str(path), single_file=True)
    expected = io.StringIO(newline="")
    writer = csv.writer(expected)
    writer.writerow(["Group", "Hash", "FilePath"])
    writer.writerows((g, h, p) for g, h, _, _, p in sorted(_long()))
    # members of one group come in report order
    ordered = [(1, "h1", p) for p in GROUPS["h1"]] + [(2, "h2", p) for p in GROUPS["h2"]]
    expected = io.StringIO(newline="")
    writer = csv.writer(expected)
    writer.writerow(["Group", "Hash", "FilePath"])
    writer.writerows(ordered)
    assert path.read_bytes() == expected.getvalue().encode("utf-8")


@pytest.mark.parametrize("single_file", [True, False])
def test_csv_is_read_back(spark, tmp_path, single_file):
    path = f"{tmp_path}/r.csv"
    plain = {"h1": GROUPS["h1"], "h2": [p for p in GROUPS["h2"] if "\n" not in p and "\r" not in p]}
    report.write_report_csv(members(spark, plain), summary(plain), path, single_file)
    assert rows(report.read_report_csv(spark, path)) == sorted(
        [(g, h, p) for g, h, _, _, p in _long(plain)], key=repr)


def test_csv_folder_keeps_line_ends_in_paths(spark, tmp_path):
    path = f"{tmp_path}/r.csv"
    report.write_report_csv(members(spark), summary(), path)
    assert rows(report.read_report_csv(spark, path), "FilePath") == sorted(
        [(p,) for *_, p in _long()], key=repr)


def test_text(spark, tmp_path):
    path = tmp_path / "r.txt"
    report.write_report_txt(members(spark), summary(), str(path), single_file=True)
    expected = ["扫描时间: 2024-01-02 03:04:05", "扫描目录: /path, /ü", "扫描完成：共发现 2 组重复文件。", "=" * 42]
    for name, paths in GROUPS.items():
        expected += ["", f"XXH3-128: {name}"] + [f"  - {p}" for p in paths]
    expected += ["=" * 42, "执行总耗时: 1.23 秒"]
    assert path.read_bytes().decode() == "\n".join(expected) + "\n"


def test_text_without_groups_and_piped(spark):
    def lines(df):
        return [r.line for r in df.orderBy("section", "group_idx", "line_no").collect()]

    none = report.text_lines(members(spark, {}), summary({}))
    assert lines(none)[2:] == ["扫描完成：未发现内容重复的文件。", "执行总耗时: 1.23 秒"]
    piped = report.text_lines(members(spark), summary(algorithm="blake3"), with_scan=False)
    assert lines(piped)[0] == "扫描完成：共发现 2 组重复文件。"
    assert "BLAKE3: h1" in lines(piped)


def test_text_in_parts_is_the_same_text(spark, tmp_path):
    groups = {f"h{i:03d}": [f"/{i}/a", f"/{i}/b"] for i in range(200)}
    table = members(spark, groups).repartition(20)
    report.write_report_txt(table, summary(groups), f"{tmp_path}/one.txt", single_file=True)
    report.write_report_txt(table, summary(groups), f"{tmp_path}/parts.txt")
    parts = sorted((tmp_path / "parts.txt").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == (tmp_path / "one.txt").read_bytes()


@pytest.mark.parametrize("single", [True, False])
def test_a_report_replaces_an_earlier_one(spark, tmp_path, single):
    for kind in ("txt", "csv", "json"):
        for count in (3, 1):
            groups = {f"h{i:03d}": [f"/{i}/a", f"/{i}/b"] for i in range(count)}
            report.write_reports(members(spark, groups), summary(groups), [f"{tmp_path}/r.{kind}"], single)
    read = report.read_report(spark, f"{tmp_path}/r.json" if single else f"{tmp_path}/r.json")
    assert read is not None
    text = (tmp_path / "r.csv").read_text() if single else "".join(
        p.read_text() for p in (tmp_path / "r.csv").glob("part-*"))
    assert "/0/a" in text and "/2/a" not in text


def test_a_file_of_many_parts(spark, tmp_path):
    lines = spark.range(1_000_100).selectExpr("0 AS section", "id AS group_idx", "0 AS line_no", "string(id) AS line")
    report.write_lines(lines.repartition(5), f"{tmp_path}/r.txt", True)
    assert (tmp_path / "r.txt").read_text() == "".join(f"{k}\n" for k in range(1_000_100))


def test_absent_sections_are_empty(spark, tmp_path):
    (tmp_path / "r.json").write_text("{}")
    read = report.read_report(spark, f"{tmp_path}/r.json")
    assert read.members.count() == 0
    assert rows(read.summary) == [(None,) * 6]


def test_repeated_keys_and_empty_groups(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"duplicates": {"a": ["/1", "/2"], "b": ["/3"], "a": ["/4"], "c": []}}')
    assert rows(report.read_report(spark, f"{tmp_path}/r.json").members) == [
        (1, "a", 1, 1, "/4"), (2, "b", 1, 1, "/3"), (3, "c", 0, None, None)]


def test_suffixes_are_checked_before_the_scan(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        scan_tree(spark, [str(tmp_path)], outputs=[f"{tmp_path}/r.xml"])
    report.check_report_paths(["a.TXT", "b.Json", "c.csv"])


def test_several_reports_of_one_scan(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"same", "b": b"same"})
    out = [f"{tmp_path}/out/r.{suffix}" for suffix in ("json", "CSV", "txt")]
    result = scan_tree(spark, [str(root)])
    result.write(out, single_file=True)
    data = json.loads((tmp_path / "out" / "r.json").read_text())
    assert list(data["duplicates"].values()) == [[f"{root}/a", f"{root}/b"]]
    assert data["summary"]["total_files"] == 2 and data["summary"]["algorithm"] == "xxh3"
    assert data["summary"]["scan_folders"] == [str(root)]
    assert (tmp_path / "out" / "r.CSV").read_text().count(str(root)) == 2
    scan_tree(spark, [str(root)], outputs=[f"{tmp_path}/parts/r.json"])
    assert report.read_report(spark, f"{tmp_path}/parts/r.json").members.count() == 2


def test_action_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"actions": {
        "h1": {"keep": "/a", "trash": ["/b", "/c"]},
        "h2": {"keep": ["/d", "/e"], "trash": []},
        "h3": {"trash": ["/f"]},
        "h4": {"keep": "[odd name", "trash": ["/ü"]},
    }}))
    assert rows(read_actions(spark, f"{tmp_path}/p.json")) == [
        ("h1", "/a", "keep"), ("h1", "/b", "trash"), ("h1", "/c", "trash"),
        ("h2", "/d", "keep"), ("h2", "/e", "keep"), ("h3", "/f", "trash"),
        ("h4", "/ü", "trash"), ("h4", "[odd name", "keep")]
    (tmp_path / "empty.json").write_text("{}")
    assert rows(read_actions(spark, f"{tmp_path}/empty.json")) == []


def whole_document(path):
    """The members as a plain JSON reader sees them; of a repeated key, the last value at its first place."""
    data = json.loads(path.read_text())
    out = []
    for number, (name, paths) in enumerate(data.get("duplicates", {}).items(), start=1):
        out += [(number, name, len(paths), p, path) for p, path in enumerate(paths, start=1)] or [
            (number, name, 0, None, None)]
    return sorted(out, key=repr)


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("groups", [
    GROUPS, {}, {"h": []}, {"a": ["/1"], "b": [], "c": ["/x" * 100, "/2", "/3"] * 9},
    {"odd \"key\": [": ['/a": [', "    ]", "/},", "  }", "/\\"], "k": ["{", "}", '": {}']},
])
def test_documents_are_read_by_lines(spark, tmp_path, small_ranges, groups):
    path = tmp_path / "r.json"
    path.write_text(json.dumps(document(groups, summary(groups)), ensure_ascii=False, indent=2))
    by_lines = report._read_by_lines(spark, str(path))
    assert rows(by_lines.members) == whole_document(path)
    read = by_lines.summary.first().asDict()
    assert read == document(groups, summary(groups))["summary"]
    assert rows(report.read_report(spark, str(path)).members) == whole_document(path)
    # the sections the other way round, and Windows line ends
    turned = dict(reversed(document(groups, summary(groups)).items()))
    path.write_bytes(json.dumps(turned, indent=2).replace("\n", "\r\n").encode())
    by_lines = report._read_by_lines(spark, str(path))
    assert rows(by_lines.members) == whole_document(path) and by_lines.summary.first().asDict() == read


def test_repeated_keys_by_lines(spark, tmp_path, small_ranges):
    path = tmp_path / "r.json"
    path.write_text('{\n  "duplicates": {\n    "a": [\n      "/1",\n      "/2"\n    ],\n    "b": [\n      "/3"\n    ],\n'
                    '    "a": [\n      "/4"\n    ],\n    "c": []\n  }\n}\n')
    by_lines = report._read_by_lines(spark, str(path))
    assert rows(by_lines.members) == [(1, "a", 1, 1, "/4"), (2, "b", 1, 1, "/3"), (3, "c", 0, None, None)]
    assert rows(by_lines.summary) == [(None,) * 6]


@pytest.mark.parametrize("text", [
    '{"duplicates": {"a": ["/1"]}}', "{}", '{\n  "duplicates": {\n    "a": ["/1", "/2"]\n  }\n}',
    '{\n "duplicates": {\n  "a": [\n   "/1"\n  ]\n }\n}', '{\n  "duplicates": {\n    "a": [\n      "/1"\n',
    '{\n  "duplicates": {\n    "a": [\n      7\n    ]\n  }\n}',
])
def test_other_layouts_are_left_to_the_whole_reader(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    assert report._read_by_lines(spark, f"{tmp_path}/r.json") is None
    report.read_report(spark, f"{tmp_path}/r.json").members.collect()


@pytest.mark.parametrize("kind", ["json", "txt", "csv"])
@pytest.mark.parametrize("earlier, later", [(True, False), (False, True)])
def test_files_and_folders_replace_each_other(spark, tmp_path, kind, earlier, later):
    path = f"{tmp_path}/r.{kind}"
    report.write_reports(members(spark), summary(), [path], earlier)
    report.write_reports(members(spark, {"n": ["/n1", "/n2"]}), summary({"n": []}), [path], later)
    assert (tmp_path / f"r.{kind}").is_file() is later
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == [f"r.{kind}"]
    if kind == "json":
        assert rows(report.read_report(spark, path).members, "path") == [("/n1",), ("/n2",)]


@pytest.mark.parametrize("single", [True, False])
def test_a_write_that_fails_half_way_leaves_the_old_report(spark, tmp_path, monkeypatch, single):
    from dupeframe import hadoop
    from pyspark.sql import functions as F

    path = f"{tmp_path}/r.json"
    report.write_report_json(members(spark), summary(), path, single)
    before = rows(report.read_report(spark, path).members)
    broken = members(spark, {f"h{i}": [f"/{i}/a", f"/{i}/b"] for i in range(50)}).withColumn(
        "path", F.when(F.col("path") == "/40/b", F.raise_error(F.lit("lost"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="lost"):
        report.write_report_json(broken, summary(), path, single)
    assert rows(report.read_report(spark, path).members) == before

    real, calls = hadoop.rename, []

    def fails_second(spark, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise OSError("lost")
        real(spark, source, target)

    monkeypatch.setattr(hadoop, "rename", fails_second)
    with pytest.raises(OSError, match="lost"):
        report.write_report_json(members(spark, {"n": ["/1", "/2"]}), summary(), path, single)
    assert rows(report.read_report(spark, path).members) == before
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.json"]


def test_the_last_of_repeated_decisions_counts(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"actions": {"h": {"keep": "/a", "trash": ["/b"]}, "g": {"keep": "/c", "trash": []},'
        ' "h": {"keep": "/b", "trash": ["/a"]}}}')
    assert rows(read_actions(spark, f"{tmp_path}/p.json")) == [
        ("g", "/c", "keep"), ("h", "/a", "trash"), ("h", "/b", "keep")]


def test_tasks_follow_the_bytes_of_a_document_not_its_ranges(spark, tmp_path):
    groups = {f"h{g}": [f"/path/{g}/{k}" for k in range(20)] for g in range(200)}
    path = tmp_path / "r.json"
    path.write_text(json.dumps(document(groups, summary(groups)), indent=2))
    context, ranges = spark.sparkContext, path.stat().st_size // 64
    context.setJobGroup("short-ranges", "")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = report.read_report(spark, str(path), range_bytes="64")
    found = rows(read.members, "group_idx", "hash", "n_members", "member_pos", "path")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("short-ranges") for s in tracker.getJobInfo(j).stageIds]
    context.setLocalProperty("spark.jobGroup.id", None)
    assert found == sorted(((g, h, 20, k, p) for g, (h, paths) in enumerate(groups.items(), 1)
                            for k, p in enumerate(paths, 1)), key=repr)
    assert ranges > 1000 and max(stage.numTasks for stage in stages if stage) <= 2 * context.defaultParallelism
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
