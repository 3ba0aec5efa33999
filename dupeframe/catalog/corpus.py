"""The given tables seen as file trees, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dupeframe.plans.scan import local_path
from dupeframe.schemas import MANIFEST
from dupeframe.sources.places import is_uri
from dupeframe.sources.table import manifest_from_table
from dupeframe.staging import stage_path

EPOCH = 1704067200.0
DAY = 86400

FILES_SQL = """
files AS (
  SELECT '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path,
         '/corpus/' || source AS root,
         CAST(substr(source, 4) AS INTEGER) AS root_ord,
         CAST(strlen(text) AS BIGINT) AS size,
         CAST(1704067200 + abs(CAST(substr(source, 4) AS INTEGER) - 10) * 86400 AS DOUBLE) AS mtime,
         text AS content, doc_id, lang
  FROM documents)"""

MEMBERS_SQL = FILES_SQL + """,
placed AS (
  SELECT *, count(*) OVER (PARTITION BY content) AS n_members,
         row_number() OVER (PARTITION BY content ORDER BY root_ord, path) AS member_pos,
         first_value(root_ord) OVER (PARTITION BY content ORDER BY root_ord, path) AS first_ord,
         first_value(path) OVER (PARTITION BY content ORDER BY root_ord, path) AS first_path
  FROM files),
members AS (
  SELECT CAST(dense_rank() OVER (ORDER BY first_ord, first_path) AS BIGINT) AS group_idx,
         sha256(content) AS hash, CAST(n_members AS BIGINT) AS n_members,
         CAST(member_pos AS BIGINT) AS member_pos, path, size, mtime, lang, doc_id
  FROM placed WHERE n_members > 1)"""

# What is "on disk now": documents that no reviewer marked as good are still there.
ENRICHED_SQL = MEMBERS_SQL + """,
present AS (
  SELECT path, size, mtime FROM files
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)),
enriched AS (
  SELECT m.group_idx, m.hash, m.n_members, m.member_pos, m.path, m.lang,
         p.path IS NOT NULL AS "exists", coalesce(p.size, 0) AS size,
         coalesce(p.mtime, 0.0) AS mtime
  FROM members m LEFT JOIN present p ON m.path = p.path)"""

# Fingerprints of an earlier run: labelled documents, some changed since (toxic), some with a
# time within the tolerance (good).
STORE_SQL = FILES_SQL + """,
store AS (
  SELECT f.path AS filepath, f.size,
         f.mtime + CASE WHEN l.toxic = 1 THEN 1.0 WHEN l.quality = 1 THEN 0.00005 ELSE 0.0 END
           AS mtime,
         sha256(f.content) AS hash, 'sha256' AS algorithm
  FROM files f JOIN labels l ON f.doc_id = l.doc_id)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source_number() -> Column:
    return F.substring("source", F.lit(4), F.length("source")).cast("int")


def as_files(documents: DataFrame) -> DataFrame:
    """Manifest with content of (a part of) ``documents``."""
    path = F.concat(
        F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"),
        F.col("doc_id").cast("string"), F.lit(".txt"),
    )
    return manifest_from_table(
        documents, path, "text",
        mtime=F.lit(EPOCH) + F.abs(_source_number() - 10) * DAY,
        root=F.concat(F.lit("/corpus/"), "source"),
        root_ord=_source_number(),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(*MANIFEST.names)


def write_tree(
    spark: SparkSession, sf_dir: str, documents: DataFrame | None = None, links: bool = False
) -> tuple[str, list[str]]:
    """Write every document (or those of a manifest with content) as a file below the staging folder,
    with its time; the folder that stands for ``/``, and the corpus' roots in order.

    Tasks write where they run, so the staging folder must be a mount that all of them share.
    With ``links``, a German file gets a symbolic link beside it, a French one a pipe, and a
    Spanish one's folder a link to itself; none of these is a regular file.
    """
    top = local_path(stage_path(spark, "tree"))
    if is_uri(top):
        raise RuntimeError(f"files can be written to a mounted staging folder only, not to {top}")

    def write(batches):
        import os

        for batch in batches:
            for path, content, mtime in zip(*[column.to_pylist() for column in batch.columns]):
                name = top + path
                os.makedirs(os.path.dirname(name), exist_ok=True)
                with open(name, "wb") as stream:
                    stream.write(content)
                os.utime(name, (mtime, mtime))
                for place, odd, make in (
                    ("/de/", name + ".link", lambda odd: os.symlink(name, odd)),
                    ("/fr/", name + ".pipe", os.mkfifo),
                    ("/es/", os.path.dirname(name) + "/again", lambda odd: os.symlink(os.path.dirname(name), odd)),
                ):
                    if links and place in path:
                        try:
                            make(odd)
                        except FileExistsError:  # of another file of the folder, or an earlier attempt
                            pass
            yield batch.select(["path"])

    source = files(spark, sf_dir) if documents is None else documents
    written = source.select("path", F.col("content").cast("binary"), "mtime")
    written.mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
    last = table(spark, sf_dir, "documents").agg(F.max(_source_number())).first()[0]
    return top, [f"{top}/corpus/src{i}" for i in range(last + 1)]


def with_hidden_and_empty(documents: DataFrame) -> DataFrame:
    """German files under hidden names, and those of every seventh source empty."""
    name = F.when(F.col("path").contains("/de/"), F.regexp_replace("path", "/([^/]*)$", "/.$1")).otherwise(F.col("path"))
    content = F.when(F.col("root_ord") % 7 == 0, F.lit("")).otherwise(F.col("content"))
    return documents.withColumns({"path": name, "content": content})


def below(top: str, name: str = "path") -> Column:
    """A path of ``write_tree`` as it is in the corpus."""
    return F.substring(name, F.lit(len(top) + 1), F.length(name)).alias(name)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/web/"), F.col("page_id").cast("string"), F.lit(".html"))
    return manifest_from_table(
        table(spark, sf_dir, "pages"), path, "html", root=F.lit("/web"), root_ord=F.lit(100)
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(
        F.lit("/chat/"), F.col("conv_id").cast("string"), F.lit("/"),
        F.col("turn").cast("string"), F.lit("."), "role",
    )
    return manifest_from_table(
        table(spark, sf_dir, "conversations"), path, "text",
        root=F.lit("/chat"), root_ord=F.lit(101),
    )


def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/bench/"), F.col("item_id").cast("string"))
    return manifest_from_table(
        table(spark, sf_dir, "benchmark"), path, "text",
        root=F.lit("/bench"), root_ord=F.lit(102),
    )


def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    left = table(spark, sf_dir, "documents").join(good, "doc_id", "left_anti")
    return as_files(left).select(*MANIFEST.names)


def stored(spark: SparkSession, sf_dir: str, algorithm: str = "sha256") -> DataFrame:
    from dupeframe.functions.fingerprint import fingerprint
    from dupeframe.schemas import STORE

    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents")
    drift = F.when(F.col("toxic") == 1, F.lit(1.0)).when(
        F.col("quality") == 1, F.lit(0.00005)
    ).otherwise(F.lit(0.0))
    # content is hashed where it is read; only metadata meets the labels
    hashed = as_files(documents).select(
        "path", "size", "mtime", fingerprint(F.col("content"), algorithm).alias("hash")
    )
    drifts = documents.join(labels, "doc_id").withColumn("_drift", drift)
    labelled = drifts.select(
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "_drift"
    )
    return hashed.join(labelled, "path").select(
        F.col("path").alias("filepath"), "size",
        (F.col("mtime") + F.col("_drift")).alias("mtime"), "hash",
        F.lit(algorithm).alias("algorithm"),
    ).select(*STORE.names)
