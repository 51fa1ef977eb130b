"""Path checks through the Hadoop FileSystem (works for any cluster FS)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def is_complete(spark: SparkSession, path: str) -> bool:
    """A folder written by a committed Spark job (has ``_SUCCESS``)."""
    fs, p = _fs_path(spark, path.rstrip("/") + "/_SUCCESS")
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries directly under ``path`` (sorted)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p)) and fs.getFileStatus(p).isDirectory()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def replace_folder(spark: SparkSession, src: str, dst: str) -> None:
    """Move a finished folder into place and mark it complete. An existing
    incomplete ``dst`` (an interrupted earlier write) is removed first."""
    fs, s = _fs_path(spark, src)
    _, d = _fs_path(spark, dst)
    if fs.exists(d):
        fs.delete(d, True)
    if not fs.rename(s, d):
        raise OSError(f"could not move {src} to {dst}")
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst + "/_SUCCESS")).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed into it."""
    import uuid

    fs, p = _fs_path(spark, path)
    _, staged = _fs_path(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(staged)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(staged, p):
        raise OSError(f"could not move {staged} to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
