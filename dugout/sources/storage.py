"""Small files in the table store, wherever it is: the file system of the address does the work."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _at(spark, path)
    return files.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    files, place = _at(spark, path)
    if not files.exists(place):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(place))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; False if it does. The file appears whole: it is
    written under another name, and renamed unless the name was taken meanwhile."""
    files, place = _at(spark, path)
    if files.exists(place):
        return False
    files.mkdirs(place.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    option = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    option[0] = hadoop.Options.Rename.NONE  # fails where the target exists
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), option)
    except Exception as e:  # noqa: BLE001 - py4j wraps the file system's error
        files.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def read(spark: SparkSession, path: str) -> str:
    files, place = _at(spark, path)
    stream = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    files, place = _at(spark, path)
    files.delete(place, True)
