import hashlib
from pathlib import PurePosixPath

import pytest
import xxhash
from pyspark.sql import functions as F

from dupeframe.functions import formats, paths
from dupeframe.functions.fingerprint import algorithm_label, check_algorithm, fingerprint


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_digests_equal_the_libraries(spark):
    values = ["", "a", "common content", "ünï😀", "x" * 300_000]
    raw = [v.encode() for v in values]
    assert apply(spark, values, lambda c: fingerprint(c, "xxh3")) == [
        xxhash.xxh3_128_hexdigest(b) for b in raw]
    assert apply(spark, raw, lambda c: fingerprint(c, "xxh3"), "binary") == [
        xxhash.xxh3_128_hexdigest(b) for b in raw]
    assert apply(spark, values, lambda c: fingerprint(c, "sha256")) == [
        hashlib.sha256(b).hexdigest() for b in raw]
    assert apply(spark, values, lambda c: fingerprint(c, "md5")) == [
        hashlib.md5(b).hexdigest() for b in raw]


def test_missing_content_has_no_digest(spark):
    for algorithm in ("xxh3", "sha256", "md5"):
        assert apply(spark, [None], lambda c: fingerprint(c, algorithm)) == [None]


def test_blake3_is_checked_on_the_driver(spark):
    try:
        import blake3
    except ImportError:
        with pytest.raises(RuntimeError, match="blake3"):
            fingerprint(F.col("v"), "blake3")
    else:
        assert apply(spark, ["a"], lambda c: fingerprint(c, "blake3")) == [
            blake3.blake3(b"a").hexdigest()]


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        check_algorithm("crc32")


def test_normalize_path(spark):
    cases = {
        "/a/b": "/a/b", "/a//b/": "/a/b", "/a/./b/.": "/a/b", "/a/../b": "/b", "/../../x": "/x",
        "/a/b/../../c/../d": "/d", "\\a\\b": "/a/b", "x/y": "/base/x/y", "/": "/", "/a/..": "/",
        "/a/...": "/a/...", "/.hidden": "/.hidden", "/a/..b/c": "/a/..b/c", "/.": "/",
    }
    assert apply(spark, list(cases), lambda c: paths.normalize_path(c, "/base")) == list(
        cases.values())


def test_is_relative_to_goes_by_component(spark):
    values = ["/a/b", "/a/b/c", "/a/bc", "/a", "/A/b"]
    assert apply(spark, values, lambda c: paths.is_relative_to(c, "/a/b")) == [
        True, True, False, False, False]
    assert apply(spark, values, lambda c: paths.is_relative_to(c, "/a/b/")) == [
        True, True, False, False, False]
    assert apply(spark, values, lambda c: paths.is_relative_to(c, F.lit("/a/"))) == [
        True, True, True, True, False]
    assert all(apply(spark, values, lambda c: paths.is_relative_to(c, "/")))


def test_many_bases_equal_few(spark):
    values = ["/", "/a", "/a/b", "/a/bc/d", "/x/y/z", "/x", "s3://b/x/1", "s3://b/xy", "file:/b/x",
              "/a/b//c", "/b//x/3", "/b/x/3", "x", ""]
    for few in (["/a/b", "/x/y"], ["s3://b/x", "file:/b/x/"], ["/b//x"], ["/"], ["x"]):
        def plain(value):
            return any(value == (b.rstrip("/") or "/") or value.startswith(b.rstrip("/") + "/") for b in few)
        for bases in (few, few + [f"/none/{i}" for i in range(60)]):
            assert apply(spark, values, lambda c: paths.is_beneath_any(c, bases)) == list(map(plain, values))


def test_beginnings(spark):
    assert apply(spark, ["/a/b", "/", "s3://b//x", "x"], paths.beginnings) == [
        ["", "/a"], [""], ["s3:", "s3:/", "s3://b", "s3://b/"], []]


def test_path_suffix(spark):
    values = ["/x/a.tar.gz", "/x/.bashrc", "/x/a..txt", "/x/x.", "/x/A.JSON", "/x.d/plain", "/x/..a.b"]
    assert apply(spark, values, paths.path_suffix) == [
        PurePosixPath(v).suffix.lower() for v in values]


def test_path_length_counts_utf16_units(spark):
    assert apply(spark, ["a😀", "abc", "é", ""], paths.path_length) == [3, 3, 1, 0]


def test_truncate_path(spark):
    values = ["/short", "/a/rather/long/path/to/a/file.txt"]
    for width in (60, 75, 90, 200):
        room = max(10, width - 65)
        expected = [v if len(v) <= room else "..." + v[-(room - 3):] for v in values]
        assert apply(spark, values, lambda c: paths.truncate_path(c, width)) == expected


def _scan_size(n):
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024:
            return f"{int(n)} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} PB"


def test_format_size(spark):
    values = [0, 1, 1023, 1024, 1152, 1536, 1048575, 1048576, 1024**3 + 7, 1024**4, 1024**5, 3 * 1024**5]
    assert apply(spark, values, lambda c: formats.format_size(c, "scan"), "long") == [
        _scan_size(v) for v in values]
    assert apply(spark, [0, 12, 1152, 1024**4, 1024**5], lambda c: formats.format_size(c, "handler"),
                 "long") == ["0.00 B", "12.00 B", "1.12 KB", "1.00 TB", "1024.00 TB"]
    assert apply(spark, [0, 12, 1024, 1152, 1536, 1048575, 1024**5],
                 lambda c: formats.format_size(c, "web"), "long") == [
        "0 B", "12 B", "1 KB", "1.13 KB", "1.5 KB", "1024 KB", "1024 TB"]


def test_format_mtime(spark):
    values = [0.0, 1704067200.0, 1704067199.9999999, 1720000000.25]
    assert apply(spark, values, lambda c: formats.format_mtime(c, "UTC"), "double") == [
        "1970-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-07-03 09:46:40"]
    assert apply(spark, [0.0], lambda c: formats.format_mtime(c, "Asia/Tokyo"), "double") == [
        "1970-01-01 09:00:00"]
    assert apply(spark, [0.0], formats.format_mtime, "double") == ["1970-01-01 00:00:00"]


def test_algorithm_label(spark):
    assert apply(spark, ["xxh3", "blake3", "sha256"], algorithm_label) == [
        "XXH3-128", "BLAKE3", "SHA256"]
