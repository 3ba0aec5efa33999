import os
import random

import pytest
from conftest import make_tree, plan_text, rows
from pyspark.sql import functions as F

from dupeframe import scan_table, scan_tree
from dupeframe.operators import groups, scope
from dupeframe.plans.reclaim import plan_reclaim
from dupeframe.sources.files import fingerprint_files
from dupeframe.sources.table import manifest_from_objects
from dupeframe.sources.tree import read_tree, stat_paths
from dupeframe.staging import stage, with_global_index

COPIES = {"a/one.txt": b"common content", "b/two.txt": b"common content", "c.txt": b"unique"}


def listed(df, root):
    return sorted(os.path.relpath(row.path, root) for row in df.select("path").collect())


def test_groups_events_and_totals(spark, tmp_path):
    root = make_tree(tmp_path, COPIES)
    result = scan_tree(spark, [str(root)])
    assert (result.total_files, result.cache_hits, result.duplicate_groups) == (3, 0, 1)
    assert rows(result.members, "group_idx", "member_pos", "path") == [
        (1, 1, f"{root}/a/one.txt"), (1, 2, f"{root}/b/two.txt")]
    assert {len(row.hash) for row in result.members.collect()} == {32}


def test_excluded_directory(spark, tmp_path):
    root = make_tree(tmp_path, COPIES)
    result = scan_tree(spark, [f"{root}/a", f"{root}/b"], [f"{root}/b"])
    assert (result.total_files, result.duplicate_groups) == (1, 0)


def test_exclusion_goes_by_component(spark, tmp_path):
    root = make_tree(tmp_path, {"b/x": b"1", "bc/x": b"1", "b2": b"1"})
    assert listed(read_tree(spark, [str(root)], [f"{root}/b"]), root) == ["b2", "bc/x"]


def test_single_file_roots(spark, tmp_path):
    root = make_tree(tmp_path, COPIES)
    includes = [f"{root}/a/one.txt", f"{root}/b/two.txt", f"{root}/c.txt"]
    result = scan_tree(spark, includes)
    assert (result.total_files, result.duplicate_groups) == (3, 1)


def test_excluded_single_file_root(spark, tmp_path):
    root = make_tree(tmp_path, COPIES)
    includes = [f"{root}/a/one.txt", f"{root}/b/two.txt"]
    result = scan_tree(spark, includes, [f"{root}/b/two.txt"])
    assert (result.total_files, result.duplicate_groups) == (1, 0)


def test_directory_and_file_roots(spark, tmp_path):
    root = make_tree(tmp_path, COPIES)
    result = scan_tree(spark, [f"{root}/a", f"{root}/b/two.txt"])
    assert rows(result.members, "member_pos", "path") == [
        (1, f"{root}/a/one.txt"), (2, f"{root}/b/two.txt")]


def test_absent_roots_and_empty_scans(spark, tmp_path):
    result = scan_tree(spark, [f"{tmp_path}/nowhere"])
    assert (result.total_files, result.duplicate_groups, result.hit_rate) == (0, 0, None)
    assert result.members.count() == 0


def test_which_entries_are_listed(spark, tmp_path):
    root = make_tree(tmp_path / "tree", {
        ".hidden": b"h", "_under": b"u", "empty": b"", ".d/inner": b"i", "d/e/f/deep": b"x"})
    outside = make_tree(tmp_path / "outside", {"target": b"t"})
    (root / "link.txt").symlink_to(outside / "target")
    (root / "linkdir").symlink_to(outside)
    (tmp_path / "rootlink").symlink_to(root)
    expected = [".d/inner", ".hidden", "_under", "d/e/f/deep", "empty"]
    assert listed(read_tree(spark, [str(root)]), root) == expected
    # a symlinked root is resolved and scanned
    assert listed(read_tree(spark, [f"{tmp_path}/rootlink"]), root) == expected


def test_empty_files_are_one_group(spark, tmp_path):
    root = make_tree(tmp_path, {"a": b"", "b": b"", "c": b"c"})
    members = scan_tree(spark, [str(root)]).members
    assert rows(members, "path", "size", "hash") == [
        (f"{root}/{name}", 0, "99aa06d3014798d86001c324468d497f") for name in ("a", "b")]


def test_overlapping_roots_list_a_path_once(spark, tmp_path):
    root = make_tree(tmp_path, {"p/q/f1": b"1", "p/f2": b"2", "p/q/f3": b"3", "g": b"4"})
    includes = [f"{root}/p/q/f3", f"{root}/p", f"{root}/p/q", str(root), f"{root}/p"]
    assert rows(read_tree(spark, includes), "path", "root_ord") == sorted([
        (f"{root}/p/q/f3", 0), (f"{root}/p/q/f1", 1), (f"{root}/p/f2", 1), (f"{root}/g", 3)],
        key=repr)


def test_listing_in_rounds_equals_one_round(spark, tmp_path):
    rng = random.Random(7)
    files = {
        "/".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) + f"/f{i}": b"x"
        for i in range(120)
    }
    root = make_tree(tmp_path, files)
    whole = rows(read_tree(spark, [str(root)], [f"{root}/a/b"]))
    assert rows(read_tree(spark, [str(root)], [f"{root}/a/b"], entries_per_task=2)) == whole
    assert len(whole) == len([f for f in files if not f.startswith("a/b/")])


def test_listing_has_size_and_time(spark, tmp_path):
    root = make_tree(tmp_path, {"f": b"12345"})
    os.utime(root / "f", (1_700_000_000.25, 1_700_000_000.25))
    assert rows(read_tree(spark, [str(root)]), "size", "mtime", "root") == [
        (5, 1_700_000_000.25, str(root))]
    paths = spark.createDataFrame([(f"{root}/f",), (f"{root}/gone",), (None,)], "path string")
    assert rows(stat_paths(paths)) == [(f"{root}/f", 5, 1_700_000_000.25)]


def test_unreadable_file_fails_or_is_skipped(spark, tmp_path):
    root = make_tree(tmp_path, {"ok": b"x"})
    manifest = read_tree(spark, [str(root)])
    gone = manifest.unionByName(manifest.withColumn("path", F.lit(f"{root}/gone")))
    with pytest.raises(Exception, match="cannot read"):
        fingerprint_files(gone).collect()
    kept = {r.path: (r.hash, r.error) for r in fingerprint_files(gone, on_error="skip").collect()}
    assert kept[f"{root}/ok"][1] is None and kept[f"{root}/gone"][0] is None
    assert "gone" in kept[f"{root}/gone"][1]


def test_large_file_is_read_in_chunks(spark, tmp_path):
    import xxhash

    body = random.Random(1).randbytes(3 * 1024 * 1024 + 17)
    root = make_tree(tmp_path, {"big": body, "same": body})
    members = scan_tree(spark, [str(root)]).members.collect()
    assert [m.hash for m in members] == [xxhash.xxh3_128_hexdigest(body)] * 2


def _items(spark, items):
    return spark.createDataFrame(
        [(p, "/", o, len(c.encode()), 0.0, c) for p, o, c in items],
        "path string, root string, root_ord int, size long, mtime double, content string",
    )


def test_groups_equal_brute_force(spark, hot):
    rng = random.Random(hot)
    items = [
        (f"/r{rng.randint(0, 3)}/{i:03d}", rng.randint(0, 3), rng.choice(["hot", "hot"] + list("abcdefgh") + [str(i)]))
        for i in range(300)
    ]
    table = _items(spark, items)
    by_content = {}
    for path, order, content in sorted(items, key=lambda item: (item[1], item[0])):
        by_content.setdefault(content, []).append(path)
    expected = [
        (number, position, path)
        for number, paths in enumerate(
            [p for p in by_content.values() if len(p) > 1], start=1)
        for position, path in enumerate(paths, start=1)
    ]
    for options in ({}, {"size_prefilter": True}, {"paths_unique": True}):
        result = scan_table(table, algorithm="md5", **options)
        assert rows(result.members, "group_idx", "member_pos", "path") == sorted(expected, key=repr)
        assert result.total_files == 300


def test_prefilter_keeps_all_items(spark):
    table = _items(spark, [("/a", 0, "x"), ("/b", 0, "x"), ("/c", 0, "yy")])
    expected = rows(scan_table(table, algorithm="md5").members)
    for unique in (True, False):
        result = scan_table(table, algorithm="md5", size_prefilter=True, paths_unique=unique)
        assert rows(result.members) == expected and result.total_files == 3
        assert rows(result.fingerprints.where("hash IS NULL"), "path") == [("/c",)]
        planned = plan_reclaim(result.members, result.fingerprints, rule="oldest")
        assert rows(planned.survivors(result.fingerprints), "path") == [("/a",), ("/c",)]


@pytest.mark.parametrize("bits", [28, 6])
def test_a_map_of_keys_loses_no_row(spark, bits):
    from dupeframe.operators.bitmap import among
    from pyspark.sql import functions as F

    table = spark.range(1000)
    found = {r.id for r in among(table, F.col("id"), table.where("id % 7 = 0"), bits).collect()}
    assert {k for k in range(0, 1000, 7)} <= found
    assert bits == 6 or len(found) == 143
    assert among(table, F.col("id"), table.where("id < 0"), bits).count() == 0


def test_a_root_above_the_staging_folder(spark, tmp_path):
    from dupeframe.staging import stage_root

    root = stage_root(spark)
    os.makedirs(f"{root}/x", exist_ok=True)
    above = os.path.dirname(root)
    excludes = [f"{above}/{name}" for name in os.listdir(above) if f"{above}/{name}" != root]
    result = scan_tree(spark, [above], excludes, "md5")
    assert rows(result.fingerprints.where(result.fingerprints.path.startswith(root))) == []


def test_reasons_of_skipped_files(spark, tmp_path, monkeypatch):
    from dupeframe.sources import files

    root = make_tree(tmp_path, {"a": b"same", "b": b"same"})
    manifest = scan_tree(spark, [str(root)]).fingerprints.drop("hash", "hit")
    gone = spark.createDataFrame([(f"{root}/gone", str(root), 0, 4, 1.0)], manifest.schema)
    read = files.fingerprint_files(manifest.unionByName(gone), "md5", "skip")
    assert rows(read.where("error IS NOT NULL"), "path") == [(f"{root}/gone",)]
    assert scan_tree(spark, [str(root)], on_error="skip").errors.count() == 0


def test_scopes_of_a_table(spark):
    table = _items(spark, [(p, 9, "same") for p in ("/a/1", "/a/b/2", "/ab/3", "/c/4", "/a/b/5")])
    result = scan_table(table, ["/a/b", "/a", "/c"], ["/a/b/5"], "md5")
    assert rows(result.members, "member_pos", "path") == [(1, "/a/b/2"), (2, "/a/1"), (3, "/c/4")]


def test_objects_read_through_spark(spark, tmp_path):
    root = make_tree(tmp_path, {**COPIES, "d": b"longer content", ".hidden": b"common content"})
    manifest = manifest_from_objects(spark, [str(root)])
    result = scan_table(manifest, algorithm="xxh3", size_prefilter=True)
    assert (result.total_files, result.duplicate_groups) == (4, 1)
    assert rows(result.members, "path", "size") == [
        (f"file:{root}/a/one.txt", 14), (f"file:{root}/b/two.txt", 14)]
    assert "content:binary" not in plan_text(manifest.select("path", "size", "mtime"))


def test_repeated_paths_count_once(spark):
    table = _items(spark, [("/a", 1, "x"), ("/a", 0, "x"), ("/b", 0, "y")])
    result = scan_table(table, algorithm="md5")
    assert (result.total_files, result.duplicate_groups) == (2, 0)


def test_content_is_not_shuffled_to_remove_repeated_paths(spark):
    with pytest.raises(ValueError, match="content"):
        scope.dedupe_paths(_items(spark, [("/a", 0, "x")]))


def test_global_index_has_no_gaps(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7)
    indexed = with_global_index(df, ["k"], "place").orderBy("k").collect()
    assert [row.place for row in indexed] == list(range(1, 5001))
    assert rows(with_global_index(df.where("k < 0"), ["k"], "place")) == []


def test_group_parts_are_bounded_and_whole(spark):
    table = _items(spark, [(f"/{i:02d}", 0, "x") for i in range(25)])
    members = scan_table(table, algorithm="md5").members
    parts = groups.group_parts(members, rows_per_part=10).orderBy("part").collect()
    assert [len(p.paths) for p in parts] == [10, 10, 5]
    assert [path for p in parts for path in p.paths] == [f"/{i:02d}" for i in range(25)]


def test_rows_with_nulls_are_equal_to_each_other(spark, hot):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, None, None), (4, "b", 1), (5, "b", 1), (6, None, 2)],
        "id int, x string, y int")
    assert rows(groups.duplicate_row_members(df, ["x", "y"], ["id"]), "id", "n_copies") == [
        (1, 2), (2, 2), (4, 2), (5, 2)]
    assert rows(groups.duplicate_rows(df, ["x", "y"])) == [("a", None, 2), ("b", 1, 2)]


def test_size_candidates(spark, hot):
    meta = _items(spark, [("/a", 0, "xx"), ("/b", 0, "yy"), ("/c", 0, "z"), ("/d", 0, "")]).drop("content")
    assert rows(groups.size_candidates(meta), "path") == [("/a",), ("/b",)]


def walked(lines, allowance):
    """What one task of the listing gives back for one directory."""
    import pyarrow as pa
    from dupeframe.sources import tree

    walk = tree._walker([(0, lines)], [], allowance)
    frontier = [("root", lines, lines, 0, None, None, None)]
    return [row for batch in walk([tree._batch(frontier, tree._ENTRIES)]) for row in batch.to_pylist()]


def test_a_flat_directory_is_looked_at_by_many_tasks(spark, tmp_path):
    from dupeframe.sources.tree import read_tree
    from dupeframe.staging import stage_root

    count = 200_000
    (tmp_path / "flat").mkdir()
    for k in range(count):
        os.mknod(tmp_path / "flat" / f"f{k}")
    (tmp_path / "flat" / "sub").mkdir()
    (tmp_path / "flat" / "sub" / "inner").write_bytes(b"x")
    (tmp_path / "flat" / "link").symlink_to(tmp_path / "flat" / "f1")
    given = walked(f"{tmp_path}/flat", 10_000)
    seen = [row for row in given if row["kind"] == "file"]
    names = [name for row in given if row["kind"] == "names" for name in row["names"]]
    assert len(seen) <= 10_000 and len(seen) + len(names) >= count
    assert max(len(row["names"]) for row in given if row["kind"] == "names") <= 1000
    found = read_tree(spark, [f"{tmp_path}/flat"], entries_per_task=10_000)
    assert found.count() == count + 1 and found.where("path LIKE '%/inner' AND size = 1").count() == 1
    # the second round's files come from many tasks: its staged table has many parts with files
    rounds = sorted((os.path.join(stage_root(spark), name) for name in os.listdir(stage_root(spark))
                     if name.startswith("tree-")), key=os.path.getmtime)
    second = spark.read.parquet(rounds[-1]) if len(rounds) else None
    parts = [spark.read.parquet(path).where("kind = 'file' AND path LIKE '%/flat/%'").groupBy(
        F.input_file_name()).count().collect() for path in rounds[-3:]]
    assert second is not None and max(len(p) for p in parts) >= 16
    assert max(row["count"] for p in parts for row in p) <= 45_000


def test_objects_of_a_store_are_all_listed(spark, tmp_path):
    from dupeframe.sources.tree import read_tree, stat_paths

    root = make_tree(tmp_path / "a b", {
        ".hidden": b"same", "_under": b"u", "empty": b"", ".d/inner": b"same", "d/e/f/deep %41.txt": b"x"})
    uri = f"file://{root}"
    expected = sorted([".d/inner", ".hidden", "_under", "d/e/f/deep %41.txt", "empty"])
    for allowance in (1, 50_000):
        found = read_tree(spark, [uri + "/", f"file://{tmp_path}/nowhere"], entries_per_task=allowance)
        assert rows(found, "path") == [(f"{uri}/{name}",) for name in expected]
    assert rows(read_tree(spark, [f"{uri}/d", uri, f"{uri}/empty"], [f"{uri}/.d"]), "path", "root_ord") == sorted([
        (f"{uri}/d/e/f/deep %41.txt", 0), (f"{uri}/.hidden", 1), (f"{uri}/_under", 1), (f"{uri}/empty", 1)])
    assert rows(read_tree(spark, [f"{uri}/empty"]), "path", "size") == [(f"{uri}/empty", 0)]
    mounted = scan_tree(spark, [str(root)])
    result = scan_tree(spark, [uri], store=f"{root}/store")
    assert (result.total_files, result.duplicate_groups) == (5, 1)
    assert rows(result.members, "hash", "size") == rows(mounted.members, "hash", "size")
    again = scan_tree(spark, [uri], store=f"{root}/store")  # the store's files are no objects
    assert (again.total_files, again.cache_hits) == (5, 5)
    paths = spark.createDataFrame([(f"{uri}/_under",), (f"{uri}/gone",)], "path string")
    assert rows(stat_paths(paths).select("path", "size")) == [(f"{uri}/_under", 1)]


def test_files_are_dealt_by_their_bytes(spark, monkeypatch):
    from dupeframe.sources import files

    monkeypatch.setattr(files, "BYTES_PER_TASK", 1000)
    monkeypatch.setattr(files, "FILES_PER_TASK", 50)
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 10, 400, 999, 1000, 1001, 50_000]) for _ in range(400)] + [None]
    manifest = spark.createDataFrame(
        [(f"/{k}", "/", 0, size, 0.0) for k, size in enumerate(sizes)],
        "path string, root string, root_ord int, size long, mtime double")
    dealt = files.spread_files(manifest).withColumn("task", F.spark_partition_id())
    tasks = dealt.groupBy("task").agg(
        F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.count("*").alias("n")).collect()
    assert sum(task.n for task in tasks) == len(sizes)
    for task in tasks:
        assert task.n <= 51 and ((task.bytes or 0) <= 2000 or task.n == 1)
    total = sum(size or 0 for size in sizes if (size or 0) <= 1000)
    assert len(tasks) <= total / 1000 + len(sizes) / 50 + sum((size or 0) > 1000 for size in sizes) + 2
    assert files.spread_files(manifest.limit(0)).count() == 0
    plan = plan_text(files.spread_files(manifest))
    assert "_task" in plan and "hashpartitioning(path" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_scopes_of_a_table_of_any_size(spark, parts):
    rng = random.Random(parts)
    names = ["a", "ab", "a!", "a0", "b", "ü", "c d"]

    def path():
        return "".join("/" + rng.choice(names) for _ in range(rng.randint(1, 5)))

    paths = sorted({path() for _ in range(400)})
    roots = [(path() + rng.choice(["", "/"]), rng.randrange(6)) for _ in range(60)]
    for chosen in (roots, roots[:1], [], [*roots, ("/", 3)], [("/", 0)]):
        items = _items(spark, [(p, 0, "x") for p in paths]).drop("content").repartition(parts)
        expected = []
        for p in paths:
            held = [(n, r.rstrip("/") or "/") for r, n in chosen if f"{p}/".startswith(r.rstrip("/") + "/")]
            if held:
                least = {}
                for n, r in held:
                    least[r] = min(n, least.get(r, n))
                number, name = min((n, "" if r == "/" else r) for r, n in least.items())
                expected.append((p, name or "/", number))
        table = spark.createDataFrame(chosen, "root string, root_ord int")
        assert rows(scope.in_scope_table(items, table), "path", "root", "root_ord") == sorted(expected, key=repr)
        left = scope.exclude_table(items, table.select("root"))
        assert left.columns == items.columns
        assert rows(left, "path") == sorted(((p,) for p in paths if p not in {e[0] for e in expected}), key=repr)
    with pytest.raises(ValueError, match="content"):
        scope.exclude_table(_items(spark, [("/a", 0, "x")]), table.select("root"))


def test_a_scope_with_most_paths_is_no_single_task(spark, monkeypatch):
    plans, original = [], scope.stage
    monkeypatch.setattr(scope, "stage", lambda df, label: plans.append(plan_text(df)) or original(df, label))
    items = spark.range(20_000).select(
        F.concat(F.lit("/big/"), F.col("id").cast("string")).alias("path"), F.lit(1).alias("size"))
    found = scope.in_scope_table(items, spark.createDataFrame([("/big", 1), ("/z", 2)], "root string, root_ord int"))
    assert found.count() == 20_000 and found.where("root = '/big' AND root_ord = 1").count() == 20_000
    # paths are dealt by their place in the order, not by their scope
    assert "Exchange rangepartitioning(_key" in plans[-1] and plans[-1].count("Exchange rangepartitioning") == 1


def test_few_foreign_keys_pass_the_filter(spark):
    from dupeframe.operators.bitmap import among

    keys = stage(spark.range(1_000_000).select(F.concat(F.lit("/k/"), F.col("id").cast("string")).alias("path")), "keys")
    rows_ = spark.range(900_000, 2_000_000).select(
        "id", F.concat(F.lit("/k/"), F.col("id").cast("string")).alias("path"))
    passed = among(rows_, F.col("path"), keys)
    own, foreign = passed.agg(F.count_if(F.col("id") < 1_000_000), F.count_if(F.col("id") >= 1_000_000)).first()
    assert own == 100_000 and foreign < 0.01 * 1_000_000
    assert among(rows_, F.col("path"), keys.limit(0)).count() == 0
    tight = among(rows_, F.col("path"), keys, bits_per_key=2)  # a small filter loses nothing
    assert tight.where("id < 1000000").count() == 100_000


def test_wide_rows_are_grouped_by_digest(spark, hot):
    df = spark.createDataFrame(
        [(1, "a", None), (2, "a", None), (3, None, "a"), (4, "x:1", "b"), (5, "x:1", "b"), (6, "x", "1b"), (7, "", None),
         (8, None, ""), (9, None, None), (10, None, None)], "id int, x string, y string")
    found = groups.duplicate_wide_rows(df, ["x", "y"], ["id"])
    assert rows(found, "id", "n_copies") == [(1, 2), (10, 2), (2, 2), (4, 2), (5, 2), (9, 2)]
    assert groups.duplicate_wide_rows(df.limit(0), ["x", "y"], ["id"]).count() == 0


def test_progress_grows_while_files_are_read(spark, tmp_path, monkeypatch):
    from dupeframe.sources import files

    monkeypatch.setattr(files, "FILES_PER_TASK", 2)
    root = make_tree(tmp_path, {f"d/f{k}": b"%04d" % (k % 5) for k in range(400)})
    seen = []
    result = scan_tree(spark, [str(root)], on_progress=lambda p: seen.append((p.files, p.bytes, p.total)), every=0.02)
    assert result.total_files == 400 and seen[-1] == (400, 1600, 400)
    assert seen == sorted(seen) and any(0 < n < 400 for n, _, _ in seen)
