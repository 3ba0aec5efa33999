"""Fixed schemas of the tables that operators exchange."""

from pyspark.sql import types as T

# One row per item in scope. Table mode adds a ``content`` column, which Catalyst prunes
# from the scan of every plan that does not fingerprint.
MANIFEST = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("root", T.StringType()),
    T.StructField("root_ord", T.IntegerType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
])

# Group members in long form: a group is never held in one array.
MEMBERS = T.StructType([
    T.StructField("group_idx", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("n_members", T.LongType()),
    T.StructField("member_pos", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
])

# Fingerprint store, keyed by STORE_KEY.
STORE = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()),
    T.StructField("hash", T.StringType()),
    T.StructField("algorithm", T.StringType()),
])
STORE_KEY = ("filepath", "algorithm")

SUMMARY = T.StructType([
    T.StructField("scan_time", T.StringType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("total_files", T.LongType()),
    T.StructField("duplicate_groups", T.LongType()),
    T.StructField("scan_folders", T.ArrayType(T.StringType())),
    T.StructField("algorithm", T.StringType()),
])

# The single-document report. Never inferred: inference would turn every hash into a field.
REPORT_DOCUMENT = T.StructType([
    T.StructField("summary", SUMMARY),
    T.StructField("duplicates", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])

# The row form of the report: one JSON object per member.
REPORT_ROWS = T.StructType([
    T.StructField("group_idx", T.LongType()),
    T.StructField("hash", T.StringType()),
    T.StructField("n_members", T.LongType()),
    T.StructField("member_pos", T.LongType()),
    T.StructField("path", T.StringType()),
])

# ``keep`` is read as text because it may be a string or a list.
ACTIONS = T.StructType([
    T.StructField("actions", T.MapType(T.StringType(), T.StructType([
        T.StructField("keep", T.StringType()),
        T.StructField("trash", T.ArrayType(T.StringType())),
    ]))),
])

SELECTION = T.StructType([
    T.StructField("hash", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("decision", T.StringType()),
])
