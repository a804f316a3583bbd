"""The few file-system calls the jobs need, through the cluster's own file system."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _resolve(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _resolve(spark, path)
    fs.delete(hadoop_path, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a file or folder that is there once the application ends."""
    fs, hadoop_path = _resolve(spark, path)
    fs.deleteOnExit(hadoop_path)


def child_folders(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isDirectory()]


def child_files(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path) if s.isFile()]


def any_file(spark: SparkSession, path: str) -> str | None:
    """Some file directly in ``path``, or None; reads one listing entry, not all."""
    fs, hadoop_path = _resolve(spark, path)
    if not fs.exists(hadoop_path):
        return None
    entries = fs.listStatusIterator(hadoop_path)
    while entries.hasNext():
        entry = entries.next()
        if entry.isFile():
            return entry.getPath().toString()
    return None


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Create the file ``path``; for what fits the driver's memory.

    It is written beside and then renamed, so whoever sees it sees it whole. A file that is
    there already is an error: what must change gets a new name.
    """
    fs, hadoop_path = _resolve(spark, path)
    if fs.exists(hadoop_path):
        raise FileExistsError(path)
    parent, name = hadoop_path.getParent(), hadoop_path.getName()
    draft = spark._jvm.org.apache.hadoop.fs.Path(parent, f".{name}.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not fs.rename(draft, hadoop_path):
        fs.delete(draft, False)
        raise FileExistsError(path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file whole."""
    fs, hadoop_path = _resolve(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _visible(name: str) -> bool:
    return not name.startswith((".", "_"))


def data_files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The files that Spark reads for ``path``, a file, folder or pattern, each with the folder
    that its partition folders (``name=value``) start from, or ''."""
    fs, pattern = _resolve(spark, path)
    found: list[tuple[str, str]] = []

    def walk(folder, base: str) -> None:
        for status in sorted(fs.listStatus(folder), key=lambda x: x.getPath().toString()):
            name = status.getPath().getName()
            if not status.isDirectory():
                if _visible(name):
                    found.append((status.getPath().toString(), base))
            elif "=" in name:
                walk(status.getPath(), base or folder.toString())

    for status in fs.globStatus(pattern) or []:
        if status.isDirectory():
            walk(status.getPath(), "")
        else:
            found.append((status.getPath().toString(), ""))
    return found


def literal(path: str) -> str:
    """``path`` with what a pattern would take for a sign made plain."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first ``size`` bytes of a file, unpacked if its name ends as that of a packed one."""
    fs, hadoop_path = _resolve(spark, path)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(fs.getConf())
    codec = codecs.getCodec(hadoop_path)
    stream = fs.open(hadoop_path)
    try:
        return bytes((codec.createInputStream(stream) if codec else stream).readNBytes(size))
    finally:
        stream.close()
