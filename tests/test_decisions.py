import random

import pytest
from conftest import make_tree, rows
from pyspark.sql import functions as F

from dupeframe import scan_tree, plan_reclaim
from dupeframe.operators import decisions, reclaim, validate
from dupeframe.operators.validate import UnsafeSelection
from dupeframe.sources import report
from dupeframe.sources.quarantine import quarantine
from dupeframe.sources.tree import stat_paths

COLUMNS = ("group_idx long, hash string, n_members long, member_pos long, path string, "
           "exists boolean, size long, mtime double")


def members(spark, groups):
    """``groups``: hash -> list of (path, exists, mtime)."""
    data = []
    for number, (name, items) in enumerate(groups.items(), start=1):
        if not items:
            data.append((number, name, 0, None, None, False, 0, 0.0))
        for position, (path, exists, mtime) in enumerate(items, start=1):
            data.append((number, name, len(items), position, path, exists,
                         7 if exists else 0, mtime if exists else 0.0))
    return spark.createDataFrame(data, COLUMNS).repartition(3)


def selection(spark, items):
    return spark.createDataFrame(items, "hash string, path string, decision string")


def kept(df):
    return {r.hash: r.path for r in df.where("decision = 'keep'").collect()}


TIES = {
    "g1": [("/gone", False, 1.0), ("/bb/1", True, 5.0), ("/a", True, 3.0), ("/b", True, 3.0), ("/cc/2", True, 5.0)],
    "g2": [("/only", True, 1.0), ("/lost", False, 0.0)],
    "g3": [("/x😀", True, 1.0), ("/xyz", True, 1.0), ("/xy", True, 1.0)],
    "g4": [("/n1", False, 0.0), ("/n2", False, 0.0)],
}


@pytest.mark.parametrize("rule, expected", [
    ("first", {"g1": "/bb/1", "g3": "/x😀"}),
    ("oldest", {"g1": "/a", "g3": "/x😀"}),
    ("newest", {"g1": "/bb/1", "g3": "/x😀"}),
    ("shortest", {"g1": "/a", "g3": "/xy"}),
    ("longest", {"g1": "/bb/1", "g3": "/x😀"}),
])
def test_rules_and_ties(spark, hot, rule, expected):
    result = decisions.apply_rule(members(spark, TIES), rule)
    assert kept(result) == expected
    trash = {(r.hash, r.path) for r in result.where("decision = 'trash'").collect()}
    assert trash == {
        (name, path) for name, items in TIES.items() if name in expected
        for path, exists, _ in items if exists and path != expected[name]}


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        decisions.apply_rule(members(spark, TIES), "largest")


def test_a_rule_leaves_groups_it_cannot_act_on(spark, hot):
    prior = selection(spark, [("g2", "/only", "keep"), ("g1", "/b", "keep"), ("g1", "/a", "trash")])
    assert kept(decisions.apply_rule(members(spark, TIES), "oldest", prior)) == {
        "g1": "/a", "g2": "/only", "g3": "/x😀"}


def _simulate(items, start, edits):
    """The edits of one group, one after the other."""
    present = [path for path, exists, _ in items if exists]
    keep = start
    for action, path in edits:
        if path not in present:
            continue
        if action == "keep":
            keep = path
        elif keep == path:
            others = [p for p in present if p != path]
            keep = others[0] if others else keep
    return keep


def test_edit_chains_equal_one_by_one_application(spark, hot):
    rng = random.Random(5)
    groups, edits = {}, []
    for g in range(120):
        size = rng.randint(2, 5)
        groups[f"g{g}"] = [(f"/{g}/{i}", rng.random() < 0.85, float(rng.randint(0, 3))) for i in range(size)]
        for step in range(rng.randint(0, 9)):
            edits.append((step * 3, f"g{g}", rng.choice(["keep", "trash", "trash", "trash"]),
                          f"/{g}/{rng.randint(0, size)}"))
    table = members(spark, groups)
    start = decisions.default_selection(table)
    edit_table = spark.createDataFrame(edits, "seq long, hash string, action string, path string")
    expected = {}
    for name, path in kept(start).items():
        own = [(a, p) for _, h, a, p in sorted(edits) if h == name]
        expected[name] = _simulate(groups[name], path, own)
    result = decisions.apply_overrides(table, start, edit_table.repartition(5))
    assert kept(result) == expected
    assert rows(result, "hash", "path") == rows(start, "hash", "path")


def test_choices(spark, hot):
    table = members(spark, TIES)
    choices = spark.createDataFrame(
        [("g1", "2"), ("g2", " S "), ("g3", "4"), ("g4", "1"), ("g3x", "1"), ("g3", "abc"), ("g2", "0")],
        "hash string, choice string")
    chosen, rejected = decisions.apply_choices(table, choices)
    # numbers count existing members: /gone is not number 1
    assert rows(chosen) == [
        ("g1", "/a", "keep"), ("g1", "/b", "trash"), ("g1", "/bb/1", "trash"), ("g1", "/cc/2", "trash")]
    assert rows(rejected) == [("g2", "0"), ("g3", "4"), ("g3", "abc"), ("g3x", "1"), ("g4", "1")]


def test_the_only_existing_member_can_be_chosen(spark):
    choices = spark.createDataFrame([("g2", "1")], "hash string, choice string")
    assert rows(decisions.apply_choices(members(spark, TIES), choices)[0]) == [("g2", "/only", "keep")]


PAIR = {"h": [("/a", True, 1.0), ("/b", True, 1.0)]}


def _first(spark, groups, decided, **options):
    found = validate.validate(members(spark, groups), selection(spark, decided), **options)
    return rows(validate.first_violation(found), "check", "hash", "message")


def test_a_safe_selection(spark):
    assert _first(spark, PAIR, [("h", "/a", "keep"), ("h", "/b", "trash")]) == []


def test_all_members_trashed(spark):
    (check, name, message), = _first(spark, PAIR, [("h", "/a", "trash"), ("h", "/b", "trash")])
    assert (check, name) == ("all_trashed", "h")
    assert message == "安全防护：重复组 h 的所有文件都标记了删除，必须至少保留一个文件！"


def test_overlap_names_sorted_paths_and_comes_first(spark):
    decided = [("h", p, d) for p in ("/b", "/a") for d in ("keep", "trash")]
    assert _first(spark, PAIR, decided) == [
        ("overlap", None, f"安全防护：文件同时被标记为保留和删除：{path}") for path in ("/a", "/b")]


def test_a_long_overlap_is_whole(spark):
    paths = [f"/p{i:04d}" for i in range(1500)]
    decided = [("h", p, d) for p in paths for d in ("keep", "trash")]
    found = validate.first_violation(validate.validate(
        members(spark, {"h": [(p, True, 1.0) for p in paths]}), selection(spark, decided)))
    assert [(r.position, r.path) for r in found.orderBy("position").collect()] == list(enumerate(paths, 1))
    with pytest.raises(UnsafeSelection, match="1500 .*first-violation"):
        validate.require_safe(validate.validate(
            members(spark, {"h": [(p, True, 1.0) for p in paths]}), selection(spark, decided)))


def test_several_kept_members_and_an_edit(spark):
    group = {"h": [(p, True, 1.0) for p in ("/a", "/b", "/c")]}
    decided = [("h", "/a", "keep"), ("h", "/b", "keep"), ("h", "/c", "trash")]
    edits = spark.createDataFrame([(1, "h", "trash", "/a")], "seq long, hash string, action string, path string")
    after = decisions.apply_overrides(members(spark, group), selection(spark, decided), edits)
    assert rows(after, "path", "decision") == [("/a", "trash"), ("/b", "keep"), ("/c", "trash")]


def test_kept_member_must_exist(spark):
    groups = {"h": [("/a", False, 0.0), ("/b", True, 1.0)]}
    (check, _, message), = _first(spark, groups, [("h", "/a", "keep"), ("h", "/b", "trash")])
    assert check == "none_exists"
    assert message == "安全防护：重复组 h 保留的文件均在磁盘上不存在，必须确保至少保留一个物理存在的文件！"


def test_undecided_and_empty_groups_are_checked(spark):
    groups = {"ok": PAIR["h"], "lost": [("/x", False, 0.0)], "none": []}
    found = validate.validate(members(spark, groups), selection(spark, []))
    assert rows(found, "group_idx", "check", "hash") == [
        (2, "none_exists", "lost"), (3, "all_trashed", "none")]


def test_first_violation_follows_report_order(spark):
    groups = {"z": [("/1", False, 0.0)], "a": [("/2", True, 1.0)]}
    assert _first(spark, groups, [("a", "/2", "trash")])[0][:2] == ("none_exists", "z")


def test_trash_outside_the_report(spark):
    decided = [("h", "/elsewhere", "trash")]
    assert _first(spark, PAIR, decided)[0][0] == "not_in_report"
    assert _first(spark, PAIR, decided, strict=False) == []


def test_totals_count_all_marked_and_sum_existing(spark):
    groups = {"h": [("/a", True, 1.0), ("/b", True, 1.0), ("/c", False, 0.0)]}
    plan = reclaim.reclaim_plan(
        selection(spark, [("h", "/a", "keep"), ("h", "/c", "trash"), ("h", "/b", "trash")]),
        members(spark, groups))
    assert [tuple(r) for r in plan.collect()] == [("/b", True, 7), ("/c", False, 0)]
    assert rows(reclaim.reclaim_totals(plan)) == [(2, 1, 7)]
    assert rows(reclaim.reclaim_totals(plan.where("false"))) == [(0, 0, 0)]


def _plan(spark, *paths):
    return spark.createDataFrame([(str(p), 1) for p in paths], "path string, size long")


def test_quarantine_moves_files_once(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"1234567", "b": b"12345678"})
    plan = _plan(spark, root / "a", root / "absent")
    dry = quarantine(plan, f"{tmp_path}/q", "run1")
    assert rows(dry, "status", "bytes") == [("missing", 0), ("planned", 7)]
    assert (root / "a").exists()
    outcome = quarantine(plan, f"{tmp_path}/q", "run1", dry_run=False)
    assert not (root / "a").exists() and (root / "b").exists()
    assert (tmp_path / "q" / "run1" / str(root / "a")[1:]).read_bytes() == b"1234567"
    for _ in range(2):
        assert rows(reclaim.moved_totals(outcome)) == [(1, 7)]
    # a task that runs again reports what it moved before
    again = quarantine(plan, f"{tmp_path}/q", "run1", dry_run=False)
    assert rows(reclaim.moved_totals(again)) == [(1, 7)]


def test_quarantine_goes_on_after_a_failure(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"1234567", "b": b"12345678"})
    make_tree(tmp_path / "q" / "run2" / str(root)[1:], {"a": b"earlier"})
    outcome = quarantine(_plan(spark, root / "a", root / "b"), f"{tmp_path}/q", "run2", dry_run=False)
    assert rows(outcome, "status", "bytes") == [("failed", 0), ("moved", 8)]
    assert rows(reclaim.moved_totals(outcome)) == [(1, 8)]
    assert (root / "a").read_bytes() == b"1234567"


def test_from_scan_to_reclaim(spark, tmp_path):
    root = make_tree(tmp_path / "t", {
        "a/long-name": b"same", "b/x": b"same", "c": b"same", "d": b"other", "e": b"other", "f": b"one"})
    scan_tree(spark, [str(root)], outputs=[f"{tmp_path}/r.json"])
    listed = report.read_report(spark, f"{tmp_path}/r.json")
    (root / "e").unlink()
    present = stat_paths(listed.members)
    planned = plan_reclaim(listed.members, present, rule="shortest")
    assert planned.violations.isEmpty()
    assert rows(planned.totals()) == [(2, 2, 8)]
    outcome = planned.execute(f"{tmp_path}/q", dry_run=False)
    assert rows(reclaim.moved_totals(outcome)) == [(2, 8)]
    assert sorted(p.name for p in root.rglob("*") if p.is_file()) == ["c", "d", "f"]


def test_no_duplicates_are_left_once_all_groups_are_actioned(spark, tmp_path):
    root = make_tree(tmp_path, {f"{d}/{i}": str(i // 3).encode() for d in "ab" for i in range(9)})
    result = scan_tree(spark, [str(root)])
    planned = plan_reclaim(result.members, result.members, rule="newest")
    left = planned.survivors(result.fingerprints)
    assert left.count() == left.select("hash").distinct().count() == 3


def test_unsafe_plans_are_refused(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"same", "b": b"same"})
    result = scan_tree(spark, [str(root)])
    everything = result.members.select("hash", "path", F.lit("trash").alias("decision"))
    planned = plan_reclaim(result.members, result.members, selection=everything)
    with pytest.raises(UnsafeSelection, match="所有文件都标记了删除"):
        planned.execute(f"{tmp_path}/q", dry_run=False)
    with pytest.raises(UnsafeSelection):
        planned.survivors(result.fingerprints)
    assert (root / "a").exists() and (root / "b").exists()


def test_choices_and_edits_in_a_plan(spark, tmp_path):
    root = make_tree(tmp_path, {"a": b"same", "b": b"same", "c": b"same"})
    result = scan_tree(spark, [str(root)])
    name = result.members.first().hash
    choices = spark.createDataFrame([(name, "3")], "hash string, choice string")
    planned = plan_reclaim(result.members, result.members, choices=choices)
    assert kept(planned.selection) == {name: f"{root}/c"} and planned.rejected_choices.isEmpty()
    edits = spark.createDataFrame(
        [(1, name, "trash", f"{root}/a")], "seq long, hash string, action string, path string")
    planned = plan_reclaim(result.members, result.members, edits=edits)
    assert kept(planned.selection) == {name: f"{root}/b"}
    with pytest.raises(ValueError):
        plan_reclaim(result.members, result.members, choices=choices, rule="oldest")
