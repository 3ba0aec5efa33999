"""Plans, not results: nothing that would stop a job at scale."""

import pytest
from conftest import DATA, plan_text
from pyspark.sql import functions as F

from dupeframe import staging
from dupeframe.catalog import corpus
from dupeframe.catalog.queries import REGISTRY
from dupeframe.operators import decisions, groups
from dupeframe.plans import scan


@pytest.fixture
def staged_plans(monkeypatch):
    """Physical plans of all tables that are staged while a query is built."""
    plans = []
    original = staging.stage

    def recording(df, label):
        plans.append((label, plan_text(df)))
        return original(df, label)

    import dupeframe.catalog.queries as catalog
    import dupeframe.operators.validate as validate
    import dupeframe.plans.reclaim as reclaim
    for module in (staging, scan, catalog, decisions, validate, reclaim):
        monkeypatch.setattr(module, "stage", recording)
    return plans


@pytest.mark.parametrize("name", [
    "dup_members", "dup_members_scoped", "dup_members_prefiltered", "scope_exclude_many",
    "cache_prune", "manual_edits", "index_choices", "violations", "reclaim_plan",
    "incremental_scan", "size_candidates", "dup_row_members_orders",
])
def test_no_nested_loops_and_no_single_task_windows(spark, staged_plans, name):
    df = REGISTRY[name](spark, DATA)
    for _, plan in [*staged_plans, (name, plan_text(df))]:
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        for line in plan.splitlines():
            if "SinglePartition" in line:
                # only whole-table aggregates may meet in one task, never rows
                assert "Exchange SinglePartition" in line
                assert "Window" not in plan


def test_content_is_read_once_and_not_shuffled(spark, staged_plans):
    REGISTRY["dup_members_scoped"](spark, DATA)
    readers = [plan for _, plan in staged_plans if "text:string" in plan]
    assert len(readers) == 1
    below_exchange = readers[0].split("Exchange", 1)
    assert "text#" not in below_exchange[0]


def test_metadata_queries_do_not_read_content(spark):
    plan = plan_text(corpus.table(spark, DATA, "documents").select("doc_id", "source"))
    assert "text" not in plan
    manifest = corpus.files(spark, DATA).select("path", "root_ord")
    assert "text:string" not in plan_text(manifest)


def test_scope_predicates_reach_the_scan(spark):
    from dupeframe.operators.scope import in_scope

    path = staging.stage_path(spark, "paths")
    corpus.metadata(spark, DATA).write.parquet(path)
    plan = plan_text(in_scope(spark.read.parquet(path), ["/corpus/src1"]))
    assert "StringStartsWith(path,/corpus/src1)" in plan and "Exchange" not in plan


def test_native_digests_stay_in_generated_code(spark):
    plan = plan_text(REGISTRY["fp_sha256"](spark, DATA))
    assert "Python" not in plan and "Arrow" not in plan


def test_digests_of_candidates_come_after_the_size_filter(spark):
    filtered = scan._prefilter_content(corpus.files(spark, DATA))
    plan = plan_text(scan._hash_table(filtered, "sha256"))
    assert plan.index("sha2(") < plan.index("BroadcastHashJoin")


def test_groups_are_counted_before_the_shuffle(spark):
    table = scan._hash_table(corpus.files(spark, DATA), "sha256")
    plan = plan_text(groups.group_table(table))
    assert "partial_count" in plan.split("Exchange", 1)[1]


def test_edits_need_only_two_members_of_a_group(spark, staged_plans):
    REGISTRY["manual_edits"](spark, DATA)
    plan = dict(staged_plans)["edit-states"]
    # members beyond the second are dropped before the shuffle, also in a hot group
    assert "row_number(), 2, Partial" in plan and "row_number(), 2, Final" in plan


def test_positions_reuse_the_partitioning_of_the_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(REGISTRY["dup_members"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    between = plan[plan.index("Window ["):plan.index("SortMergeJoin")]
    assert "Exchange" not in between


def test_misses_are_found_by_short_keys_and_hashed_after(spark, tmp_path):
    from dupeframe.sources.store import open_store

    store = open_store(spark, f"{tmp_path}/s")
    store.upsert(corpus.stored(spark, DATA))
    plan = plan_text(
        scan._reuse_table(corpus.files(spark, DATA), store, "sha256", True))
    assert plan.index("sha2(") < plan.rindex("BroadcastHashJoin") and "_word" in plan


def test_a_store_look_up_reads_one_algorithm_and_does_not_shuffle_the_store(spark, tmp_path):
    from dupeframe.sources.store import BUCKET_ROWS_KEY, open_store

    stored = corpus.stored(spark, DATA)
    spark.conf.set(BUCKET_ROWS_KEY, "30")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = open_store(spark, f"{tmp_path}/s")
        store.upsert(stored.unionByName(stored.withColumn("algorithm", F.lit("md5"))))
        store.upsert(stored.limit(3).withColumn("hash", F.lit("changed")))  # a folder of changes
        found = corpus.metadata(spark, DATA)
        for name, folders in (("md5", 1), ("sha256", 2)):
            looked = store.look_up(found, name)
            plan = plan_text(looked)
            # the items are shuffled; the full set and a folder of changes are not
            assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == folders
            above = plan[:plan.index("Bucketed: true")].splitlines()[-3:]
            assert not any("Exchange" in line for line in above)
            files = [path for path in looked.inputFiles() if "/data/" in path]
            assert files and all(f"/{name}-" in path for path in files)
        assert all("/md5-" in path for path in store.read().where("algorithm = 'md5'").inputFiles())
    finally:
        spark.conf.unset(BUCKET_ROWS_KEY)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_columns_of_repeated_rows_are_not_shuffled(spark, monkeypatch):
    from dupeframe.operators import groups as module

    plans = []
    original = module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: plans.append(plan_text(df)) or original(df, label))
    plan = plan_text(REGISTRY["dup_rows_documents"](spark, DATA))
    for text in (*plans, plan):
        assert "Exchange" not in text or "text#" not in text[text.index("Exchange"):]


def test_plans_and_violations_are_computed_once_and_when_read(spark, monkeypatch):
    from dupeframe.plans import reclaim as module
    from dupeframe.plans.reclaim import plan_reclaim

    staged = []
    original = module.stage
    monkeypatch.setattr(module, "stage", lambda df, label: staged.append(label) or original(df, label))
    members = scan.scan_table(corpus.files(spark, DATA), algorithm="sha256").members.drop("size", "mtime")
    present = corpus.metadata(spark, DATA)
    planned = plan_reclaim(members, present, rule="newest")
    assert staged == ["enriched", "selection"]
    planned.totals().collect()
    planned.totals().collect()
    assert staged == ["enriched", "selection", "plan"]
    planned.survivors(present).count()
    planned.survivors(present).count()
    assert staged == ["enriched", "selection", "plan", "violations"]


def test_content_is_read_twice_where_sizes_are_derived(spark, monkeypatch):
    read = []
    original = scan.stage

    def recording(df, label):
        plan = plan_text(df)
        read.append((label, plan.count("text:string")))
        return original(df, label)

    monkeypatch.setattr(scan, "stage", recording)
    scan.scan_table(corpus.files(spark, DATA), algorithm="sha256", size_prefilter=True, paths_unique=True)
    assert sum(n for _, n in read) == 2
