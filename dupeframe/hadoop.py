"""Small file-system calls on the driver (markers, pointers), through Hadoop's FileSystem
so that they work on any store the session can read."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath) and fs.getFileStatus(hpath).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hpath))


def length(spark: SparkSession, path: str) -> int:
    """Bytes of the files and folders that a path or a pattern names."""
    fs, hpath = _fs(spark, path)
    return sum(fs.getContentSummary(status.getPath()).getLength() for status in fs.globStatus(hpath) or [])


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, hpath = _fs(spark, path)
    fs.mkdirs(hpath)


def delete(spark: SparkSession, path: str) -> None:
    fs, hpath = _fs(spark, path)
    fs.delete(hpath, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, hpath = _fs(spark, source)
    if not fs.rename(hpath, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not rename {source} to {target}")


def swap(spark: SparkSession, source: str, target: str) -> None:
    """Give ``source`` the place of ``target``, a file or a folder, which goes; if that fails,
    ``target`` is as it was."""
    parent, name = os.path.split(target.rstrip("/"))
    earlier = os.path.join(parent, f".{name}.{uuid.uuid4().hex}") if exists(spark, target) else None
    if earlier:
        rename(spark, target, earlier)
    try:
        rename(spark, source, target)
    except Exception:
        if earlier:
            rename(spark, earlier, target)
        raise
    if earlier:
        delete(spark, earlier)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, hpath = _fs(spark, path)
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file, whole, where there is none; False if there is one.

    The text goes to a file beside it, which then gets the name: by a hard link on a local or
    mounted file system, elsewhere by a rename that does not replace (atomic on HDFS and the like; an object
    store must refuse to overwrite for two writers to be told apart).
    """
    fs, hpath = _fs(spark, path)
    parent = hpath.getParent()
    fs.mkdirs(parent)
    beside = f"{parent}/.{uuid.uuid4().hex}"
    write_text(spark, beside, text)
    try:
        if fs.getScheme() == "file":
            local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside).toUri().getPath()
            try:
                os.link(local, hpath.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return _rename_new(spark, fs, beside, hpath)
    finally:
        delete(spark, beside)


def _rename_new(spark: SparkSession, fs, source: str, target) -> bool:
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), target, none)
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def modified(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds since 1970."""
    fs, hpath = _fs(spark, path)
    return fs.getFileStatus(hpath).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    fs, hpath = _fs(spark, path)
    stream = fs.open(hpath)
    try:
        size = fs.getFileStatus(hpath).getLen()
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
        return bytes(raw).decode("utf-8")
    finally:
        stream.close()


def concatenate(spark: SparkSession, sources: list[str], target: str) -> None:
    """Append the bytes of ``sources`` to each other as ``target``, which is replaced."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs, hpath = _fs(spark, target)
    if is_directory(spark, target):  # an earlier report of the same name in the folder form
        fs.delete(hpath, True)
    out = fs.create(hpath, True)
    try:
        for source in sources:
            from_fs, from_path = _fs(spark, source)
            stream = from_fs.open(from_path)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
