import os

import pytest
from conftest import make_tree, rows

from dupeframe import scan_table, scan_tree, hadoop
from dupeframe.operators import cache
from dupeframe.schemas import MANIFEST, STORE
from dupeframe.sources.store import ensure_store_schema, open_store


def manifest(spark, items):
    return spark.createDataFrame([(p, "/", 0, s, m) for p, s, m in items], MANIFEST)


def store_rows(spark, items):
    return spark.createDataFrame(items, STORE)


def test_a_new_store_is_created_empty(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/deep/store")
    assert os.path.isdir(f"{tmp_path}/deep/store")
    assert store.read().count() == 0 and store.current_version() is None


def test_hit_and_changes(spark):
    stored = store_rows(spark, [(p, 10, 1000.0, "h", "xxh3") for p in ("/a", "/b", "/c", "/d", "/e")])
    now = manifest(spark, [
        ("/a", 10, 1000.0), ("/b", 11, 1000.0), ("/c", 10, 900.0), ("/d", 10, 1000.00005),
        ("/e", 10, 1000.0002), ("/new", 10, 1000.0)])
    found = {r.path: r.hit for r in cache.lookup(now, stored, "xxh3").collect()}
    assert found == {"/a": True, "/b": False, "/c": False, "/d": True, "/e": False, "/new": False}


def test_an_empty_hash_is_a_miss(spark):
    stored = store_rows(spark, [("/a", 1, 1.0, "", "xxh3")])
    assert rows(cache.lookup(manifest(spark, [("/a", 1, 1.0)]), stored, "xxh3"), "hash", "hit") == [
        (None, False)]


def test_algorithms_do_not_mix(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "x", "xxh3")]))
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "b", "blake3")]))
    now = manifest(spark, [("/a", 1, 1.0)])
    for algorithm, expected in (("xxh3", "x"), ("blake3", "b"), ("md5", None)):
        assert rows(cache.lookup(now, store.read(), algorithm), "hash") == [(expected,)]


def test_upsert_replaces_by_key(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "old", "xxh3"), ("/b", 2, 1.0, "b", "xxh3")]))
    store.upsert(store_rows(spark, [("/a", 5, 2.0, "new", "xxh3"), ("/a", 5, 2.0, "m", "md5")]))
    assert rows(store.read(), "filepath", "algorithm", "hash") == [
        ("/a", "md5", "m"), ("/a", "xxh3", "new"), ("/b", "xxh3", "b")]


def test_prune_below_a_directory(spark):
    stored = store_rows(spark, [(p, 1, 1.0, "h", "xxh3") for p in ("/r/1", "/r/2", "/r/3", "/other")])
    keep = manifest(spark, [("/r/1", 1, 1.0), ("/r/2", 1, 1.0)])
    assert rows(cache.prune(stored, ["/r"], keep), "filepath") == [("/other",), ("/r/1",), ("/r/2",)]
    assert rows(cache.stale_rows(stored, ["/r"], keep), "filepath") == [("/r/3",)]


def test_prune_with_file_roots(spark):
    stored = store_rows(spark, [(p, 1, 1.0, "h", "xxh3") for p in ("/r/1", "/r/2", "/r/2/x")])
    pruned = cache.prune(stored, [], manifest(spark, [("/r/1", 1, 1.0)]), ["/r/1", "/r/2"])
    assert rows(pruned, "filepath") == [("/r/1",), ("/r/2/x",)]


def test_prune_takes_all_algorithms_and_literal_prefixes(spark):
    paths = ("/my_dir/x", "/myXdir/x", "/MY_DIR/x", "/50%/x", "/50abc/x")
    stored = store_rows(
        spark, [(p, 1, 1.0, "h", a) for p in paths for a in ("xxh3", "md5")])
    pruned = cache.prune(stored, ["/my_dir", "/50%"], manifest(spark, []))
    assert {r.filepath for r in pruned.collect()} == {"/myXdir/x", "/MY_DIR/x", "/50abc/x"}
    assert pruned.count() == 6


def test_prune_of_the_top_and_of_nothing_found(spark):
    stored = store_rows(spark, [("/a/x", 1, 1.0, "h", "xxh3")])
    assert cache.prune(stored, ["/"], manifest(spark, [])).count() == 0
    assert cache.prune(stored, ["/a/"], manifest(spark, [])).count() == 0


@pytest.mark.parametrize("columns", [
    "filepath string, size long, mtime double, hash string",
    "filepath string, size string, mtime double, hash string, algorithm string",
])
def test_other_layouts_are_reset(spark, tmp_path, columns):
    old = spark.createDataFrame([], columns)
    directory = f"{tmp_path}/s"
    values = {"filepath": "/a", "size": "1", "mtime": 1.0, "hash": "h", "algorithm": "xxh3"}
    row = [int(v) if f.dataType.simpleString() == "bigint" else v
           for f in old.schema for v in [values[f.name]]]
    spark.createDataFrame([row], old.schema).write.parquet(f"{directory}/v00000001")
    hadoop.write_text(spark, f"{directory}/v00000001/_layout.json", '{"columns": {}, "key": []}')
    store = open_store(spark, directory)
    assert store.read().count() == 0 and store.current_version() == 2


def test_wrong_columns_under_the_right_marker_are_reset(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "h", "xxh3")]))
    assert not ensure_store_schema(store)
    store.read().selectExpr("*", "size AS extra").write.partitionBy("algorithm").parquet(
        f"{tmp_path}/s/v00000002")
    marker = hadoop.read_text(spark, f"{tmp_path}/s/v00000001/_layout.json")
    hadoop.write_text(spark, f"{tmp_path}/s/v00000002/_layout.json", marker)
    assert open_store(spark, f"{tmp_path}/s").read().count() == 0


def test_foreign_data_starts_an_empty_version(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/s")
    assert open_store(spark, f"{tmp_path}/s").read().count() == 0


def test_an_unusable_location_is_fatal(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    for path in (f"{tmp_path}/file", f"{tmp_path}/file/below"):
        with pytest.raises(RuntimeError, match="cannot open"):
            open_store(spark, path)
        with pytest.raises(RuntimeError, match="cannot open"):
            scan_tree(spark, [str(tmp_path)], store=path)


def test_an_unfinished_version_is_ignored_and_vacuumed(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "h", "xxh3")]))
    store_rows(spark, [("/b", 1, 1.0, "h", "xxh3")]).write.parquet(f"{tmp_path}/s/v00000002")
    assert rows(store.read(), "filepath") == [("/a",)]
    store.upsert(store_rows(spark, [("/c", 1, 1.0, "h", "xxh3")]))
    assert store.current_version() == 3
    store.vacuum(keep=1)
    assert [n for n in os.listdir(f"{tmp_path}/s") if n.startswith("v")] == ["v00000003"]
    assert rows(store.read(), "filepath") == [("/a",), ("/c",)]


def test_incremental_scan_of_a_tree(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"same", "b": b"same", "c": b"other"})
    store = f"{root}/.store"
    first = scan_tree(spark, [str(root)], store=store)
    assert (first.total_files, first.cache_hits) == (3, 0)
    again = scan_tree(spark, [str(root)], store=store)
    # the store itself is never listed
    assert (again.total_files, again.cache_hits, again.hit_rate) == (3, 3, 100.0)
    assert rows(again.members) == rows(first.members)
    (root / "a").write_bytes(b"changed")
    (root / "b").unlink()
    last = scan_tree(spark, [str(root)], store=store)
    assert (last.total_files, last.cache_hits, last.duplicate_groups) == (2, 1, 0)
    assert rows(open_store(spark, store).read(), "filepath") == [(f"{root}/a",), (f"{root}/c",)]


def test_a_vanished_root_is_pruned_and_others_stay(spark, tmp_path):
    root = make_tree(tmp_path, {"a/1": b"1", "b/2": b"2"})
    store = str(tmp_path / "store")
    scan_tree(spark, [f"{root}/a"], store=store)
    scan_tree(spark, [f"{root}/b"], store=store)
    (root / "a" / "1").unlink()
    (root / "a").rmdir()
    scan_tree(spark, [f"{root}/a"], store=store)
    assert rows(open_store(spark, store).read(), "filepath") == [(f"{root}/b/2",)]


def test_incremental_scan_of_a_table(spark, tmp_path):
    def table(items):
        return spark.createDataFrame(
            [(p, "/", 0, len(c), m, c) for p, c, m in items],
            "path string, root string, root_ord int, size long, mtime double, content string")

    before = [("/r/1", "x", 1.0), ("/r/2", "x", 1.0), ("/r/3", "zz", 1.0)]
    after = [("/r/1", "x", 1.0), ("/r/2", "y", 2.0), ("/r/4", "x", 1.0), ("/r/1", "x", 1.0)]
    for includes in (["/r"], None):  # without includes the scan answers for all paths
        store = f"{tmp_path}/s{includes is None}"
        assert scan_table(table(before), includes, algorithm="md5", store=store).cache_hits == 0
        result = scan_table(table(after), includes, algorithm="md5", store=store)
        assert (result.total_files, result.cache_hits) == (3, 1)
        assert rows(result.members, "path") == [("/r/1",), ("/r/4",)]
        assert rows(open_store(spark, store).read(), "filepath") == [("/r/1",), ("/r/2",), ("/r/4",)]


def test_stats(spark):
    stored = store_rows(spark, [("/a", 1, 1.0, "h", "xxh3")])
    now = manifest(spark, [("/a", 1, 1.0), ("/b", 1, 1.0), ("/c", 1, 1.0)])
    assert rows(cache.cache_stats(cache.lookup(now, stored, "xxh3"))) == [(1, 3, 1 / 3 * 100)]
    empty = cache.lookup(manifest(spark, []), stored, "xxh3")
    assert rows(cache.cache_stats(empty)) == [(0, 0, None)]


def test_merge_equals_upsert_and_prune(spark):
    import random

    from dupeframe.schemas import STORE_KEY
    from pyspark.sql import functions as F

    rng = random.Random(3)
    pairs = {(f"/{rng.choice('abc')}/{i}", a) for i in range(40) for a in ("md5", "xxh3") if rng.random() < 0.7}
    stored = store_rows(spark, [(p, 1, 1.0, "old", a) for p, a in sorted(pairs)])
    found = spark.createDataFrame(
        [(f"/{d}/{i}", 2, 2.0, "new") for d in "ab" for i in range(40) if rng.random() < 0.5],
        "path string, size long, mtime double, hash string")
    fresh = found.select(F.col("path").alias("filepath"), "size", "mtime", "hash", F.lit("md5").alias("algorithm"))
    expected = cache.prune(cache.upsert(stored, fresh, list(STORE_KEY)), ["/a", "/b"], found)
    assert rows(cache.merge_scan(stored, found, "md5", ["/a", "/b"])) == rows(
        expected.select(*stored.columns))


# -- buckets, changes and the commit protocol -------------------------------------------------


@pytest.fixture
def small_buckets(spark):
    from dupeframe.sources.store import BUCKET_ROWS_KEY

    spark.conf.set(BUCKET_ROWS_KEY, "10")
    yield
    spark.conf.unset(BUCKET_ROWS_KEY)


def files_of(directory):
    return {os.path.join(top, name): os.stat(os.path.join(top, name)).st_mtime_ns
            for top, _, names in os.walk(f"{directory}/data") for name in names if name.startswith("part-")}


def scan_rows(spark, items):
    return spark.createDataFrame(items, "path string, size long, mtime double, hash string")


def stored_state(store):
    return rows(store.read(), "filepath", "size", "mtime", "hash", "algorithm")


def test_a_run_adds_changes_and_leaves_all_buckets_as_they_are(spark, tmp_path, small_buckets):
    store = open_store(spark, f"{tmp_path}/s")
    items = [(f"/r/{i}", i, 1.0, f"h{i}") for i in range(100)]
    store.apply_scan(scan_rows(spark, items), "md5", ["/r"])
    before = files_of(store.directory)
    assert len(before) > 8  # one file in each bucket
    changed = [("/r/1", 1, 2.0, "new"), *items[3:], ("/r/x", 7, 1.0, "x")]
    store.apply_scan(scan_rows(spark, changed), "md5", ["/r"])
    after = files_of(store.directory)
    assert before.items() <= after.items() and 0 < len(after) - len(before) <= 4
    assert store.current_version() == 2
    assert stored_state(store) == sorted((*row, "md5") for row in changed)
    store.apply_scan(scan_rows(spark, changed), "md5", ["/r"])
    assert store.current_version() == 2 and files_of(store.directory) == after  # nothing changed


def test_changes_are_merged_once_they_are_many(spark, tmp_path, small_buckets):
    store = open_store(spark, f"{tmp_path}/s")
    expected = {f"/r/{i}": (f"/r/{i}", i, 1.0, "h") for i in range(60)}
    store.apply_scan(scan_rows(spark, list(expected.values())), "md5", ["/r"])
    folders = []
    for k in range(6):
        expected |= {f"/r/{i}": (f"/r/{i}", i, 2.0 + k, f"h{k}") for i in range(k, 66, 9)}
        expected.pop(f"/r/{10 + k}", None)
        store.apply_scan(scan_rows(spark, list(expected.values())), "md5", ["/r"])
        folders.append(len(store._state().parts["md5"].folders))
        assert stored_state(store) == sorted((*row, "md5") for row in expected.values())
    assert 1 in folders[1:] and max(folders) > 1
    store.compact()
    assert len(store._state().parts["md5"].folders) == 1
    assert stored_state(store) == sorted((*row, "md5") for row in expected.values())
    before = store.current_version()
    store.compact()
    assert store.current_version() == before


def test_merging_does_not_shuffle_the_full_set(spark, tmp_path, small_buckets):
    from conftest import plan_text

    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [(f"/{i}", i, 1.0, "h", "md5") for i in range(60)]))
    store.upsert(store_rows(spark, [(f"/{i}", i, 2.0, "h", "md5") for i in range(3)]))
    part = store._state().parts["md5"]
    assert len(part.folders) == 2 and part.buckets == 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(store._rows(part))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    full = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    assert "SortMergeJoin" in plan and not any("Exchange" in line for line in lines[:full])
    for _ in range(3):
        before = {r.filepath: r.mtime for r in store.read().collect()}
        store.compact()
        assert {r.filepath: r.mtime for r in store.read().collect()} == before
        folder = store._state().parts["md5"].folders[0][0]
        buckets = [name.split("_")[-1] for name in files_of(f"{tmp_path}/s") if folder in name]
        assert len(set(buckets)) <= 8 and max(buckets.count(name) for name in buckets) <= 2
        store.upsert(store_rows(spark, [(f"/{i}", i, 3.0, "h", "md5") for i in range(5, 9)]))


@pytest.mark.parametrize("first, second", [("md5", "md5"), ("md5", "sha256")])
def test_of_two_runs_the_later_merges_again(spark, tmp_path, first, second):
    from dupeframe.catalog.queries import _Overtaken

    store = open_store(spark, f"{tmp_path}/s")
    store.apply_scan(scan_rows(spark, [(f"/{r}/{i}", i, 1.0, "old") for r in "abc" for i in range(4)]), "md5", None)
    one = scan_rows(spark, [("/a/0", 0, 1.0, "one"), ("/b/0", 0, 1.0, "one")])
    two = scan_rows(spark, [("/b/0", 0, 1.0, "two"), ("/c/9", 9, 1.0, "two")])
    overtaken = _Overtaken(spark, store.directory, lambda: store.apply_scan(two, second, ["/b", "/c"]))
    overtaken.apply_scan(one, first, ["/a", "/b"])
    assert store.current_version() == 3
    expected = {("/a/0", 0, 1.0, "one", "md5"), ("/b/0", 0, 1.0, "one", "md5"), ("/c/9", 9, 1.0, "two", second)}
    if second == "sha256":  # the other run's rows of paths that this one found stay
        expected |= {("/b/0", 0, 1.0, "two", "sha256")}
    assert set(stored_state(store)) == expected


def test_a_new_marker_never_replaces_one(spark, tmp_path):
    path = f"{tmp_path}/below/marker"
    assert hadoop.create_new(spark, path, "first")
    assert not hadoop.create_new(spark, path, "second")
    assert hadoop.read_text(spark, path) == "first" and os.listdir(f"{tmp_path}/below") == ["marker"]
    # the way of other file systems, here over the local one
    fs, hpath = hadoop._fs(spark, f"{tmp_path}/below/other")
    for text, made in (("first", True), ("second", False)):
        hadoop.write_text(spark, f"{tmp_path}/below/.beside", text)
        assert hadoop._rename_new(spark, fs, f"{tmp_path}/below/.beside", hpath) is made
    assert hadoop.read_text(spark, f"{tmp_path}/below/other") == "first"


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/marker"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: hadoop.create_new(spark, path, str(k) * 1000), range(8)))
    assert sum(made) == 1 and hadoop.read_text(spark, path) == str(made.index(True)) * 1000
    store = open_store(spark, f"{tmp_path}/s")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: open_store(spark, store.directory).apply_scan(
            scan_rows(spark, [(f"/r{k}/{i}", i, 1.0, "h") for i in range(5)]), "md5", [f"/r{k}"]), range(4)))
    assert store.read().count() == 20 and store.current_version() == 4


def test_a_copied_marker_does_not_count(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "h", "xxh3")]))
    marker = hadoop.read_text(spark, f"{tmp_path}/s/v00000001/_layout.json")
    hadoop.write_text(spark, f"{tmp_path}/s/v00000002/_layout.json", marker)
    assert ensure_store_schema(store) and store.read().count() == 0 and store.current_version() == 3


def test_vacuum_keeps_listed_and_recent_data(spark, tmp_path):
    store = open_store(spark, f"{tmp_path}/s")
    for k in range(4):
        store.replace(store_rows(spark, [(f"/{k}", 1, 1.0, "h", "xxh3"), ("/b", 1, 1.0, "h", "md5")]))
    runs = set(os.listdir(f"{tmp_path}/s/data"))
    store.vacuum()
    assert set(os.listdir(f"{tmp_path}/s/data")) == runs  # a run that has not ended may own them
    store.vacuum(keep=2, older_than=-1)
    assert len(os.listdir(f"{tmp_path}/s/data")) == 2
    assert [n for n in sorted(os.listdir(f"{tmp_path}/s")) if n[0] == "v"] == ["v00000003", "v00000004"]
    assert rows(store.read(), "filepath") == [("/3",), ("/b",)]


def test_reads_outlive_the_table_names_and_odd_algorithm_names(spark, tmp_path):
    tables = {t.name for t in spark.catalog.listTables()}
    store = open_store(spark, f"{tmp_path}/it's a store")
    store.upsert(store_rows(spark, [("/a", 1, 1.0, "h", "b/3 x"), ("/a", None, None, None, "md5")]))
    assert rows(store.read(), "filepath", "hash", "algorithm") == [("/a", "h", "b/3 x"), ("/a", None, "md5")]
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_a_store_is_no_item_however_it_is_named(spark, tmp_path):
    root = make_tree(tmp_path / "t", {"a": b"same"})
    names = [f"{root}/a", f"file:{root}/s/x", f"file://{root}/s/y", f"{root}/s/z", f"{root}/sz"]
    table = spark.createDataFrame(
        [(n, "/", 0, 1, 1.0, "c") for n in names],
        "path string, root string, root_ord int, size long, mtime double, content string")
    for store in (f"{root}/s", f"file://{root}/s"):
        assert scan_table(table, algorithm="md5", store=store).total_files == 2
