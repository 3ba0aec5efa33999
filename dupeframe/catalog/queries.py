"""Named queries over the given tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from dupeframe import hadoop
from dupeframe.catalog import corpus
from dupeframe.catalog.corpus import table
from dupeframe.functions import formats, paths
from dupeframe.functions.fingerprint import algorithm_label as label_of
from dupeframe.functions.fingerprint import fingerprint
from dupeframe.operators import cache, decisions, groups, reclaim, scope, summary, validate
from dupeframe.plans.reclaim import ReclaimPlan, plan_reclaim
from dupeframe.plans.scan import ScanResult, scan_table, scan_tree
from dupeframe.schemas import MANIFEST
from dupeframe.session import HOT_ROWS_KEY
from dupeframe.sources import report
from dupeframe.sources.actions import parse_actions
from dupeframe.sources.store import FingerprintStore, open_store
from dupeframe.sources.tree import read_tree
from dupeframe.staging import stage, stage_path, with_global_index

Query = Callable[[SparkSession, str], DataFrame]

INCLUDES = ["/corpus/src1", "/corpus/src10/en", "/corpus/src7/", "/corpus/src12/de"]
OVERLAPPING = ["/corpus/src3/en", "/corpus/src3", "/corpus/src4/fr", "/corpus"]
EXCLUDES = ["/corpus/src2", "/corpus/src5/en", "/corpus/src1/en/1.txt"]
STORE_DIR = "/corpus/src9"
SCAN_TIME = "2024-01-31 12:00:00"
ELAPSED = 1.234
MID = "2024-01-16 00:00:00"

REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


# -- manifests and path functions ------------------------------------------------------------


@query
def manifest(spark, d):
    return corpus.files(spark, d).select("path", "root", "root_ord", "size", "mtime")


def _page_paths(spark, d) -> DataFrame:
    host = F.regexp_replace("url", "^https?://", "")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("/web/"), host).alias("path"))


@query
def normalize_path(spark, d):
    messy = F.concat(F.lit("\\web//./"), F.replace("url", F.lit("/en/"), F.lit("\\en\\.\\")), F.lit("/"))
    return table(spark, d, "pages").select("page_id", paths.normalize_path(messy).alias("path"))


@query
def path_suffix(spark, d):
    pages = _page_paths(spark, d).select("path")
    both = corpus.files(spark, d).select("path").unionByName(pages)
    return both.select("path", paths.path_suffix(F.col("path")).alias("suffix"))


@query
def is_relative_to(spark, d):
    path = F.col("path")
    return corpus.files(spark, d).select(
        "path",
        paths.is_relative_to(path, "/corpus/src1").alias("beneath_src1"),
        paths.is_relative_to(path, F.col("root")).alias("beneath_root"),
        paths.is_relative_to(path, "/").alias("beneath_top"),
    )


@query
def path_length(spark, d):
    return _page_paths(spark, d).select(
        "page_id", paths.path_length(F.col("path")).alias("path_length")
    )


@query
def truncate_path(spark, d):
    path = F.col("path")
    return _page_paths(spark, d).select(
        "page_id",
        paths.truncate_path(path, 85).alias("narrow"),
        paths.truncate_path(path, 60).alias("narrowest"),
        paths.truncate_path(path, 200).alias("wide"),
    )


# -- scopes -----------------------------------------------------------------------------------


@query
def scope_include(spark, d):
    return scope.in_scope(corpus.metadata(spark, d), INCLUDES).select("path", "root", "root_ord")


@query
def scope_first_root(spark, d):
    return scope.in_scope(corpus.metadata(spark, d), OVERLAPPING).select(
        "path", "root", "root_ord"
    )


@query
def scope_exclude(spark, d):
    return scope.exclude(corpus.metadata(spark, d), EXCLUDES).select("path")


@query
def scope_exclude_many(spark, d):
    """Many excludes: some languages of most sources."""
    many = [f"/corpus/src{i}/{lang}" for i in range(3, 20) for lang in ("de", "fr", "es")]
    return scope.exclude(corpus.metadata(spark, d), many).select("path")


def _uri_scope(spark, d, sources: range) -> DataFrame:
    """Object names with a scheme and an empty part, in the scope of some sources and languages."""
    files = corpus.metadata(spark, d).withColumn("path", F.concat(F.lit("s3://bucket//x"), "path"))
    roots = [f"s3://bucket//x/corpus/src{i}/{lang}" for i in sources for lang in ("de", "fr", "es")]
    return scope.in_scope(files.drop("root", "root_ord"), roots).select("path", "root", "root_ord")


@query
def scope_include_uri(spark, d):
    return _uri_scope(spark, d, range(1, 2))


@query
def scope_include_many(spark, d):
    return _uri_scope(spark, d, range(0, 20))


@query
def survivors_prefiltered(spark, d):
    """What is left after a scan that hashes items of a repeated size only."""
    files = corpus.files(spark, d)
    scanned = scan_table(files, algorithm="sha256", size_prefilter=True, paths_unique=True)
    planned = plan_reclaim(scanned.members, scanned.fingerprints, rule="shortest")
    return planned.survivors(scanned.fingerprints).select("path", "size")


@query
def scope_include_table(spark, d):
    """Roots given as a table: folders that the labels name, and files of toxic documents, which lie
    within some of them; the first root by its number counts."""
    documents = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    folder = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang")
    number = F.substring("source", F.lit(4), F.length("source")).cast("int")
    folders = documents.where("doc_id % 5 = 0").select(folder.alias("root"), (number * 7 % 11).alias("root_ord"))
    names = documents.where("toxic = 1").select(
        F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("root"),
        (F.col("doc_id") % 13).cast("int").alias("root_ord"))
    roots = folders.unionByName(names).unionByName(
        spark.createDataFrame([("/corpus/src3/", 4), ("/corpus/src1", 9), ("/corpus/none", 0)], "root string, root_ord int"))
    return scope.in_scope_table(corpus.metadata(spark, d), roots).select("path", "root", "root_ord", "size")


@query
def scope_exclude_table(spark, d):
    """Excludes given as a table: a path for each toxic document, and some folders."""
    toxic = corpus.as_files(table(spark, d, "documents").join(
        table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")).select("path")
    folders = spark.createDataFrame([(path,) for path in EXCLUDES], "path string")
    return scope.exclude_table(corpus.metadata(spark, d), toxic.unionByName(folders)).select("path", "root", "root_ord")


@query
def scope_exclude_store(spark, d):
    return scope.exclude(corpus.metadata(spark, d), EXCLUDES, STORE_DIR).select("path")


@query
def scope_overlap(spark, d):
    """Each root listed on its own, then one row per path."""
    meta = corpus.metadata(spark, d)
    listed = [
        scope.in_scope(meta, [root]).withColumn("root_ord", F.lit(i))
        for i, root in enumerate(OVERLAPPING)
    ]
    union = reduce(DataFrame.unionByName, listed)
    return scope.dedupe_paths(union).select("path", "root", "root_ord")


@query
def scope_union(spark, d):
    sources = [
        corpus.files(spark, d), corpus.page_files(spark, d),
        corpus.conversation_files(spark, d), corpus.benchmark_files(spark, d),
        scope.in_scope(corpus.files(spark, d), INCLUDES),
    ]
    return scope.union_roots([m.select(*MANIFEST.names) for m in sources]).select(
        "path", "root", "root_ord", "size"
    )


# -- fingerprints and groups ------------------------------------------------------------------


@query
def fp_sha256(spark, d):
    return corpus.files(spark, d).select(
        "path", fingerprint(F.col("content"), "sha256").alias("hash")
    )


@query
def fp_md5(spark, d):
    return corpus.page_files(spark, d).select(
        "path", fingerprint(F.col("content"), "md5").alias("hash")
    )


def _scan(spark, d, algorithm: str = "sha256", **options) -> ScanResult:
    return scan_table(
        corpus.files(spark, d), algorithm=algorithm, paths_unique=True, **options
    )


@query
def fp_xxh3_groups(spark, d):
    return _scan(spark, d, "xxh3").members.select("group_idx", "n_members", "member_pos", "path")


@query
def dup_groups(spark, d):
    return _scan(spark, d).groups.select("group_idx", "hash", "n_members", "first_path")


@query
def dup_members(spark, d):
    return _scan(spark, d).members.select(
        "group_idx", "hash", "n_members", "member_pos", "path", "size", "mtime"
    )


@query
def dup_members_scoped(spark, d):
    """The whole scan with overlapping roots, excludes and repeated paths."""
    return scan_table(
        corpus.files(spark, d), OVERLAPPING, EXCLUDES, "sha256"
    ).members.select("group_idx", "hash", "member_pos", "path")


@query
def dup_members_prefiltered(spark, d):
    """The same groups, hashing only items whose size occurs more than once."""
    return _scan(spark, d, size_prefilter=True).members.select(
        "group_idx", "hash", "member_pos", "path"
    )


@query
def dup_members_all_tables(spark, d):
    sources = [
        corpus.files(spark, d), corpus.page_files(spark, d),
        corpus.conversation_files(spark, d), corpus.benchmark_files(spark, d),
    ]
    return scan_table(
        reduce(DataFrame.unionByName, sources), algorithm="sha256"
    ).members.select("group_idx", "hash", "member_pos", "path")


@query
def group_parts(spark, d):
    """The nested form in arrays of at most two paths, unnested again."""
    parts = groups.group_parts(_scan(spark, d).members, rows_per_part=2)
    return parts.select(
        "group_idx", "part", F.size("paths").cast("long").alias("n_paths"),
        F.array_join("paths", "|").alias("paths"),
    )


@query
def dup_rows_part(spark, d):
    return groups.duplicate_rows(table(spark, d, "part"), ["p_name"])


@query
def dup_rows_documents(spark, d):
    """Documents of one text in one language, by a digest: the texts are not shuffled."""
    found = groups.duplicate_wide_rows(table(spark, d, "documents"), ["text", "lang"], ["doc_id"])
    return found.select("doc_id", "digest", "n_copies")


@query
def dup_rows_lineitem(spark, d):
    return groups.duplicate_rows(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query
def dup_row_members_lineitem(spark, d):
    items = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return groups.duplicate_row_members(
        items, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]
    )


@query
def dup_row_members_orders(spark, d):
    """Rows equal in low-cardinality columns: few keys, each with a large share of the rows."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return groups.duplicate_row_members(
        orders, ["o_orderstatus", "o_orderpriority"], ["o_orderkey"]
    )


@query
def size_candidates(spark, d):
    return groups.size_candidates(corpus.metadata(spark, d)).select("path", "size")


# -- fingerprint store ------------------------------------------------------------------------


def _looked_up(spark, d) -> DataFrame:
    return cache.lookup(corpus.metadata(spark, d), corpus.stored(spark, d), "sha256")


@query
def cache_lookup(spark, d):
    return _looked_up(spark, d).select("path", "hash", "hit")


@query
def is_fresh(spark, d):
    """Every path and store row side by side with the freshness test."""
    stored = corpus.stored(spark, d).select(
        F.col("filepath").alias("path"), F.col("size").alias("stored_size"),
        F.col("mtime").alias("stored_mtime"),
    )
    fresh = cache.is_fresh(
        F.col("size"), F.col("mtime"), F.col("stored_size"), F.col("stored_mtime")
    )
    return corpus.metadata(spark, d).join(stored, "path").select("path", fresh.alias("fresh"))


@query
def cache_stats(spark, d):
    return cache.cache_stats(_looked_up(spark, d))


@query
def cache_isolation(spark, d):
    """Two algorithms for one path: a look-up sees only rows of its own."""
    meta = corpus.metadata(spark, d)
    both = corpus.stored(spark, d, "sha256").unionByName(
        corpus.stored(spark, d, "md5").where(F.col("size") < 1000)
    )
    looked = [
        cache.lookup(meta, both, name).withColumn("algorithm", F.lit(name))
        for name in ("sha256", "md5", "xxh3")
    ]
    return reduce(DataFrame.unionByName, looked).select("algorithm", "path", "hash", "hit")


@query
def cache_upsert(spark, d):
    """Two loads of the event log, the later one inserted or replaced over the earlier one."""
    events = table(spark, d, "events")
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    middle = F.lit(MID).cast("timestamp")
    base = cache.latest_by(events.where(F.col("ts") < middle), keys, order)
    fresh = cache.latest_by(events.where(F.col("ts") >= middle), keys, order)
    return cache.upsert(base, fresh, keys).select("user_id", "event_type", "event_id", "value")


PRUNE_ROOTS = ["/corpus/src1", "/corpus/src7/en", "/corpus/src4"]


@query
def cache_prune(spark, d):
    return cache.prune(
        corpus.stored(spark, d), PRUNE_ROOTS, corpus.present(spark, d)
    ).select("filepath", "hash")


@query
def cache_stale(spark, d):
    return cache.stale_rows(
        corpus.stored(spark, d), PRUNE_ROOTS, corpus.present(spark, d)
    ).select("filepath", "size")


@query
def incremental_scan(spark, d):
    """A first scan of what is present fills a store; the second scan covers everything."""
    store = stage_path(spark, "store")
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    first = corpus.as_files(table(spark, d, "documents").join(good, "doc_id", "left_anti"))
    scan_table(first, algorithm="sha256", store=store, paths_unique=True)
    return _scan(spark, d, store=store).fingerprints.select("path", "hash", "hit")


def _store_rows(spark, directory: str) -> DataFrame:
    return open_store(spark, directory).read().select("filepath", "size", "mtime", "hash", "algorithm")


def _without_toxic(spark, d) -> DataFrame:
    toxic = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return corpus.as_files(table(spark, d, "documents").join(toxic, "doc_id", "left_anti"))


@query
def incremental_store(spark, d):
    """The rows of a store after scans under two algorithms, and one of some roots after the toxic
    documents were deleted: it prunes rows of both algorithms there."""
    store = stage_path(spark, "store")
    scan_table(corpus.files(spark, d), algorithm="sha256", store=store, paths_unique=True)
    scan_table(corpus.files(spark, d), INCLUDES, algorithm="md5", store=store, paths_unique=True)
    scan_table(_without_toxic(spark, d), PRUNE_ROOTS, algorithm="sha256", store=store, paths_unique=True)
    return _store_rows(spark, store)


@query
def store_reset(spark, d):
    """A store whose version has another layout starts anew; a scan then fills it."""
    store = stage_path(spark, "store")
    corpus.stored(spark, d).drop("algorithm").write.parquet(f"{store}/v00000001")
    hadoop.write_text(spark, f"{store}/v00000001/_layout.json", '{"columns": {}, "key": []}')
    emptied = open_store(spark, store).read().select(F.lit("reset").alias("state"), "filepath", "hash")
    emptied = stage(emptied, "emptied")
    scan_table(_without_toxic(spark, d), algorithm="sha256", store=store, paths_unique=True)
    return emptied.unionByName(_store_rows(spark, store).select(F.lit("scanned").alias("state"), "filepath", "hash"))


class _Overtaken(FingerprintStore):
    """A store where another run publishes its version just before this one's."""

    def __init__(self, spark, directory: str, other: Callable[[], None]):
        super().__init__(spark, directory)
        self.other = [other]

    def _publish(self, state, parts) -> bool:
        while self.other:
            self.other.pop()()
        return super()._publish(state, parts)


@query
def store_two_runs(spark, d):
    """Two runs over different roots build on one version; the later one merges again."""
    store = stage_path(spark, "store")
    scan_table(corpus.present(spark, d).withColumn("content", F.lit("")), algorithm="sha256", store=store,
               paths_unique=True)
    hashed = stage(fp_sha256(spark, d).join(corpus.metadata(spark, d), "path"), "hashed")

    def run(opened: FingerprintStore, roots: list[str]) -> None:
        opened.apply_scan(stage(scope.in_scope(hashed, roots), "found"), "sha256", roots)

    def other() -> None:
        run(open_store(spark, store), ["/corpus/src3", "/corpus/src7"])

    run(_Overtaken(spark, store, other), ["/corpus/src1", "/corpus/src3"])
    return _store_rows(spark, store)


# -- summaries and formats --------------------------------------------------------------------


@query
def scan_summary(spark, d):
    result = _scan(spark, d)
    return summary.scan_summary(result.fingerprints, result.groups)


@query
def group_size(spark, d):
    return summary.group_sizes(_scan(spark, d).members).select("group_idx", "hash", "size")


def _sizes(spark, d) -> DataFrame:
    """Byte counts from one to terabytes."""
    item = table(spark, d, "lineitem")
    product = F.col("l_orderkey") * F.col("l_partkey") * F.col("l_quantity").cast("long")
    return item.select(F.explode(F.array(
        F.col("l_partkey"), F.col("l_orderkey") * 37, product, product * 997,
    )).alias("size")).distinct()


@query
def format_size_scan(spark, d):
    return _sizes(spark, d).select("size", formats.format_size(F.col("size"), "scan").alias("text"))


@query
def format_size_handler(spark, d):
    return _sizes(spark, d).select(
        "size", formats.format_size(F.col("size"), "handler").alias("text")
    )


@query
def format_size_web(spark, d):
    return _sizes(spark, d).select("size", formats.format_size(F.col("size"), "web").alias("text"))


@query
def format_mtime(spark, d):
    seconds = F.lit(corpus.EPOCH) + F.col("l_orderkey") * 61.0 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", formats.format_mtime(seconds, "UTC").alias("text")
    )


@query
def algorithm_label(spark, d):
    """Report labels of algorithm names, for the names a scan and the event log can hold."""
    name = F.when(F.col("event_type") == "view", F.lit("xxh3")).when(
        F.col("event_type") == "click", F.lit("blake3")
    ).otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy(label_of(name).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def rates(spark, d):
    """Cache hit rate per root."""
    return _looked_up(spark, d).groupBy("root").agg(
        formats.rate_percent(F.count_if("hit"), F.count(F.lit(1))).alias("hit_rate")
    )


@query
def list_join(spark, d):
    """Each file with its directories, joined as a report joins its folders."""
    above = F.transform(
        paths.beginnings(F.col("path")), lambda start: F.when(start == "", F.lit("/")).otherwise(start)
    )
    return corpus.files(spark, d).select(
        "path", formats.join_list(F.array_append(above, F.col("path"))).alias("folders")
    )


# -- reports ----------------------------------------------------------------------------------


def _summary(result: ScanResult) -> report.Summary:
    return report.Summary(
        result.total_files, result.duplicate_groups, ELAPSED, ["/corpus", "/web"],
        "sha256", SCAN_TIME,
    )


def _read_back(spark, result: ScanResult, single_file: bool) -> report.Report:
    path = stage_path(spark, "report") + ".json"
    report.write_report_json(result.members, _summary(result), path, single_file)
    return report.read_report(spark, path)


@query
def report_json_roundtrip(spark, d):
    members = _read_back(spark, _scan(spark, d), True).members
    return members.select("group_idx", "hash", "n_members", "member_pos", "path")


@query
def report_json_rows_roundtrip(spark, d):
    members = _read_back(spark, _scan(spark, d), False).members
    return members.select("group_idx", "hash", "n_members", "member_pos", "path")


@query
def report_json_summary(spark, d):
    return _read_back(spark, _scan(spark, d), True).summary.select(
        "scan_time", "elapsed_seconds", "total_files", "duplicate_groups",
        formats.join_list(F.col("scan_folders")).alias("scan_folders"), "algorithm",
    )


@query
def report_document_roundtrip(spark, d):
    """One JSON document, read in many small ranges of its lines."""
    result = _scan(spark, d)
    path = stage_path(spark, "report") + ".json"
    report.write_report_json(result.members, _summary(result), path, True)
    members = report.read_report(spark, path, range_bytes="1k").members
    return members.select("group_idx", "hash", "n_members", "member_pos", "path")


@query
def report_rewrite_roundtrip(spark, d):
    """A folder over an earlier file, then a file over that folder; each is read back."""
    result = _scan(spark, d)
    scoped = scan_table(corpus.files(spark, d), OVERLAPPING, EXCLUDES, "sha256")
    path = stage_path(spark, "report") + ".json"
    report.write_report_json(result.members, _summary(result), path, True)
    read = []
    for form, written, single_file in (("folder", scoped, False), ("file", result, True)):
        report.write_report_json(written.members, _summary(written), path, single_file)
        found = report.read_report(spark, path).members.select(
            F.lit(form).alias("form"), "group_idx", "hash", "member_pos", "path")
        read.append(stage(found, "read"))
    return read[0].unionByName(read[1])


@query
def report_txt_roundtrip(spark, d):
    """The lines of a text report that was written as one file."""
    result = _scan(spark, d)
    path = stage_path(spark, "report") + ".txt"
    report.write_report_txt(result.members, _summary(result), path, True)
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    return with_global_index(lines, ["block", "at"], "line_no").select("line_no", "line")


@query
def report_csv_roundtrip(spark, d):
    result = _scan(spark, d)
    path = stage_path(spark, "report") + ".csv"
    report.write_report_csv(result.members, _summary(result), path)
    return report.read_report_csv(spark, path).select(
        F.col("Group").alias("group_idx"), F.col("Hash").alias("hash"),
        F.col("FilePath").alias("path"),
    )


@query
def report_txt_lines(spark, d):
    result = _scan(spark, d)
    return report.text_lines(result.members, _summary(result))


@query
def report_json_lines(spark, d):
    result = _scan(spark, d)
    return report.json_lines(result.members, _summary(result))


@query
def report_order(spark, d):
    """Members in report order."""
    return groups.report_order(_scan(spark, d).members).select("group_idx", "member_pos", "path")


# -- decisions --------------------------------------------------------------------------------


def _enriched(spark, d) -> DataFrame:
    members = _scan(spark, d).members.drop("size", "mtime")
    return stage(decisions.enrich(members, corpus.present(spark, d)), "enriched")


@query
def enrich(spark, d):
    return _enriched(spark, d).select(
        "group_idx", "hash", "member_pos", "path", "exists", "size", "mtime"
    )


@query
def existing_members(spark, d):
    return decisions.existing(_enriched(spark, d)).select("group_idx", "member_pos", "path")


@query
def default_keep(spark, d):
    return decisions.default_selection(_enriched(spark, d))


@query
def choose_keep(spark, d):
    """Groups a rule can act on, with the member it keeps."""
    return decisions.choose_keep(_enriched(spark, d), "newest")


@query
def keep_oldest(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_rule(members, "oldest", largest=decisions.largest_group(members))


@query
def keep_newest(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_rule(members, "newest", largest=decisions.largest_group(members))


@query
def keep_shortest(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_rule(members, "shortest", largest=decisions.largest_group(members))


@query
def keep_longest(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_rule(members, "longest", largest=decisions.largest_group(members))


def _prior(members: DataFrame) -> DataFrame:
    return members.select(
        "hash", "path",
        F.when(F.col("member_pos") == 1, F.lit("keep")).otherwise(F.lit("trash"))
        .alias("decision"),
    )


@query
def rule_over_prior(spark, d):
    """A rule replaces earlier decisions of the groups it can act on, and only those."""
    members = _enriched(spark, d)
    return decisions.apply_rule(members, "longest", _prior(members))


def _edits(members: DataFrame) -> DataFrame:
    """Keep every member in turn, trash them from the last to the first, then trash the ones
    in later directories again."""
    n, pos = F.col("n_members"), F.col("member_pos")
    passes = [
        members.select(pos.alias("seq"), "hash", F.lit("keep").alias("action"), "path"),
        members.select(
            (n * 2 + 1 - pos).alias("seq"), "hash", F.lit("trash").alias("action"), "path"
        ),
        members.where(F.col("path") > "/corpus/src14").select(
            (n * 2 + pos).alias("seq"), "hash", F.lit("trash").alias("action"), "path"
        ),
    ]
    return reduce(DataFrame.unionByName, passes)


@query
def manual_edits(spark, d):
    members = _enriched(spark, d)
    largest = decisions.largest_group(members)
    return decisions.apply_overrides(
        members, decisions.apply_rule(members, "oldest", largest=largest), _edits(members), largest
    )


def _choices(members: DataFrame) -> DataFrame:
    n = F.col("n_members")
    choice = F.when(n == 3, F.lit(" S ")).when(n > 4, F.lit("x")).otherwise(n.cast("string"))
    return members.where("member_pos = 1").select("hash", choice.alias("choice"))


@query
def index_choices(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_choices(members, _choices(members))[0]


@query
def rejected_choices(spark, d):
    members = _enriched(spark, d)
    return decisions.apply_choices(members, _choices(members))[1]


@query
def decision_sets(spark, d):
    members = _enriched(spark, d)
    rule = decisions.apply_rule(members, "newest")
    return decisions.decision_sets(rule.unionByName(decisions.default_selection(members)))


@query
def action_payloads(spark, d):
    """Decisions as one JSON payload per trashed member, read back as a selection."""
    members = _scan(spark, d).members
    firsts = members.where("member_pos = 1").select(
        "hash", F.col("path").alias("keep"), "n_members"
    )
    others = members.where("member_pos > 1").select("hash", "path")
    from dupeframe.operators.skew import skew_join

    pairs = skew_join(others, firsts, ["hash"], "n_members", ["path"])
    detail = F.struct(F.col("keep"), F.array("path").alias("trash"))
    payload = F.to_json(F.struct(F.create_map("hash", detail).alias("actions")))
    return parse_actions(pairs.select(payload.alias("value")), "value").distinct()


@query
def action_payload_repeats(spark, d):
    """Payloads that decide on a group twice: the last entry counts."""
    members = _scan(spark, d).members
    ends = members.groupBy("hash").agg(
        F.min_by("path", "member_pos").alias("first"), F.max_by("path", "member_pos").alias("last"))

    def detail(keep: str, trash: str):
        return F.to_json(F.struct(F.col(keep).alias("keep"), F.array(trash).alias("trash")))

    key = F.concat(F.lit('"'), F.col("hash"), F.lit('": '))
    payload = F.concat(
        F.lit('{"actions": {'), key, detail("first", "last"), F.lit(", "), key, detail("last", "first"), F.lit("}}"))
    return parse_actions(ends.select(payload.alias("value")), "value")


# -- validation -------------------------------------------------------------------------------


def _unsafe(members: DataFrame, spark, d) -> DataFrame:
    """First members kept and others trashed, with mistakes: German first members both kept
    and trashed, French ones only trashed, and trash that is in no group."""
    first = F.col("member_pos") == 1
    german, french = F.col("path").contains("/de/"), F.col("path").contains("/fr/")
    kept = members.where(first & ~french).select("hash", "path", F.lit("keep").alias("decision"))
    trash = members.where(~first | german | french).select(
        "hash", "path", F.lit("trash").alias("decision")
    )
    foreign = corpus.benchmark_files(spark, d).select(
        F.lit(None).cast("string").alias("hash"), "path", F.lit("trash").alias("decision")
    )
    return kept.unionByName(trash).unionByName(foreign)


def _unsafe_without_overlap(members: DataFrame, spark, d) -> DataFrame:
    return _unsafe(members, spark, d).where(
        (F.col("decision") == "trash") | ~F.col("path").contains("/de/")
    )


def _checked(spark, d) -> tuple[DataFrame, DataFrame]:
    members = _enriched(spark, d)
    return members, stage(_unsafe(members, spark, d), "selection")


@query
def check_overlap(spark, d):
    return validate.overlapping_paths(_checked(spark, d)[1])


@query
def check_all_trashed(spark, d):
    flags = validate.group_flags(*_checked(spark, d))
    return flags.where("all_trashed").select("group_idx", "hash")


@query
def check_none_exists(spark, d):
    flags = validate.group_flags(*_checked(spark, d))
    return flags.where("none_exists").select("group_idx", "hash")


@query
def group_flags(spark, d):
    return validate.group_flags(*_checked(spark, d))


@query
def untrashed_members(spark, d):
    return validate.untrashed_members(*_checked(spark, d)).select("group_idx", "hash", "path")


@query
def violations(spark, d):
    return validate.validate(*_checked(spark, d)).select(
        "severity", "group_idx", F.col("check").alias("check_name"), "hash", "path"
    )


@query
def first_violation(spark, d):
    found = validate.first_violation(validate.validate(*_checked(spark, d)))
    return found.select(F.col("check").alias("check_name"), "position", "path", "message")


@query
def first_group_violation(spark, d):
    members = _enriched(spark, d)
    found = validate.first_violation(
        validate.validate(members, _unsafe_without_overlap(members, spark, d))
    )
    return found.select(F.col("check").alias("check_name"), "hash", "position", "message")


# -- reclaim ----------------------------------------------------------------------------------


def _planned(spark, d):
    return plan_reclaim(
        _scan(spark, d).members.drop("size", "mtime"), corpus.present(spark, d), rule="newest"
    )


@query
def reclaim_plan(spark, d):
    return _planned(spark, d).plan


@query
def reclaim_plan_marked(spark, d):
    """The confirm list of a selection that marks missing members too."""
    members = _enriched(spark, d)
    return reclaim.reclaim_plan(_prior(members), members)


@query
def reclaim_totals(spark, d):
    return _planned(spark, d).totals()


@query
def reclaim_totals_marked(spark, d):
    members = _enriched(spark, d)
    return reclaim.reclaim_totals(reclaim.reclaim_plan(_prior(members), members))


@query
def reclaim_text(spark, d):
    """The confirm list as it is shown: path, size text and time text."""
    planned = _planned(spark, d)
    times = planned.members.select("path", "mtime")
    return planned.plan.join(times, "path").select(
        "path", formats.format_size(F.col("size"), "handler").alias("size_text"),
        formats.format_mtime(F.col("mtime"), "UTC").alias("mtime_text"),
    )


@query
def survivors(spark, d):
    """What is left of the whole corpus once every group is reclaimed."""
    members = _scan(spark, d).members.drop("size", "mtime")
    meta = corpus.metadata(spark, d)
    return plan_reclaim(members, meta, rule="shortest").survivors(meta).select("path", "size")


# -- file trees -------------------------------------------------------------------------------


@query
def tree_manifest(spark, d):
    """The documents as files, listed from the file system."""
    top, roots = corpus.write_tree(spark, d)
    return read_tree(spark, roots).select(
        corpus.below(top), corpus.below(top, "root"), "root_ord", "size", "mtime")


@query
def tree_scan(spark, d):
    top, roots = corpus.write_tree(spark, d)
    return scan_tree(spark, roots, algorithm="sha256").members.select(
        "group_idx", "hash", "n_members", "member_pos", corpus.below(top), "size", "mtime")


@query
def tree_scan_excludes(spark, d):
    """Overlapping roots and excludes; only items of a repeated size are read."""
    top, _ = corpus.write_tree(spark, d)
    result = scan_tree(spark, [top + p for p in OVERLAPPING], [top + p for p in EXCLUDES], "sha256")
    return result.members.select("group_idx", "hash", "member_pos", corpus.below(top))


@query
def tree_incremental(spark, d):
    """A stored scan without the excluded files, then one of all files."""
    top, roots = corpus.write_tree(spark, d)
    store = stage_path(spark, "store")
    scan_tree(spark, roots, [top + p for p in EXCLUDES], "sha256", store)
    return scan_tree(spark, roots, (), "sha256", store).fingerprints.select(
        corpus.below(top), "hash", "hit")


@query
def tree_links(spark, d):
    """Links, links to folders and pipes beside the files are no items."""
    top, roots = corpus.write_tree(spark, d, links=True)
    return read_tree(spark, roots).select(corpus.below(top), "size")


@query
def object_scan(spark, d):
    """The same files as objects of a store, named by URIs; hidden and empty ones count."""
    top, roots = corpus.write_tree(spark, d, corpus.with_hidden_and_empty(corpus.files(spark, d)))
    result = scan_tree(spark, [f"file://{root}/" for root in roots], algorithm="sha256")
    return result.members.select(
        "group_idx", "hash", "n_members", "member_pos", corpus.below(f"file://{top}"), "size")


@query
def object_manifest(spark, d):
    """Objects below overlapping prefixes, without excluded ones."""
    top, _ = corpus.write_tree(spark, d, corpus.with_hidden_and_empty(corpus.files(spark, d)))
    found = read_tree(
        spark, [f"file://{top}{p}" for p in OVERLAPPING], [f"file://{top}{p}" for p in EXCLUDES])
    return found.select(corpus.below(f"file://{top}"), corpus.below(f"file://{top}", "root"), "root_ord", "size")


def _tree_plan(spark, d) -> tuple[str, ReclaimPlan]:
    top, roots = corpus.write_tree(spark, d)
    result = scan_tree(spark, roots, algorithm="sha256")
    return top, plan_reclaim(result.members, result.fingerprints)


@query
def quarantine_outcome(spark, d):
    """What became of each file of the plan, after the moves."""
    top, planned = _tree_plan(spark, d)
    outcome = planned.execute(f"{top}/quarantine", dry_run=False)
    return outcome.select(corpus.below(top), "status", "bytes")


@query
def quarantine_totals(spark, d):
    top, planned = _tree_plan(spark, d)
    return reclaim.moved_totals(planned.execute(f"{top}/quarantine", dry_run=False))


@query
def refused_plan(spark, d):
    """The refusal of a plan that would move every member of every group."""
    result = _scan(spark, d)
    everything = result.members.select("hash", "path", F.lit("trash").alias("decision"))
    planned = plan_reclaim(result.members, result.fingerprints, selection=everything)
    try:
        planned.execute(stage_path(spark, "quarantine"), dry_run=False)
    except validate.UnsafeSelection as refusal:
        return spark.createDataFrame([(str(refusal),)], "message string")
    return spark.createDataFrame([], "message string")


# -- groups above the limit of hot keys -------------------------------------------------------


def _hot(name: str, function: Query) -> None:
    """Register a query again with every key treated as hot while its plan is built."""
    def hot(spark, d):
        before = spark.conf.get(HOT_ROWS_KEY, None)
        spark.conf.set(HOT_ROWS_KEY, "2")
        try:
            return function(spark, d)
        finally:
            spark.conf.unset(HOT_ROWS_KEY) if before is None else spark.conf.set(HOT_ROWS_KEY, before)

    REGISTRY[name] = hot


_hot("dup_members_hot", dup_members)
_hot("dup_row_members_hot", dup_row_members_lineitem)
_hot("keep_newest_hot", keep_newest)
_hot("index_choices_hot", index_choices)
