"""A table stored by parts (months, say) in numbered versions.

A version is a manifest: which folder holds each part. A writer puts the parts it changes into a folder
of its own, then creates the manifest after the one it read; creating fails if another writer was first,
and the writer starts again from that writer's version. Readers see whole versions only, a part without
rows is in no manifest, and a writer that breaks off leaves nothing but a folder that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.sources import storage

MANIFESTS = "_versions"
PART = "_part"


def numbers(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n in storage.names(spark, f"{path}/{MANIFESTS}") if n.endswith(".json") and not n.startswith(".")]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """Number and parts of a version, the latest unless given; (0, {}) where there is none."""
    known = numbers(spark, path)
    if version is None:
        version = max(known, default=0)
    if version == 0:
        return 0, {}
    if version not in known:
        raise LookupError(f"no version {version} of {path}")
    return version, json.loads(storage.read(spark, f"{path}/{MANIFESTS}/{version:09d}.json"))


def read(spark: SparkSession, path: str, schema: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """A version of the table, or some parts of it."""
    _, folders = manifest(spark, path, version)
    wanted = [f"{path}/{folder}" for part, folder in sorted(folders.items()) if parts is None or part in parts]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*wanted)


def update(
    spark: SparkSession,
    path: str,
    schema: str,
    part: Column,
    change: Callable[[Callable[..., DataFrame]], tuple[list[str], DataFrame]],
    attempts: int = 10,
) -> int:
    """A new version. ``change`` gets a reader of the version it builds on, ``read(parts=None)``, and
    returns the parts it rewrites with all of their rows; ``part`` names a row's part. Returns the number.
    """
    for _ in range(attempts):
        version, folders = manifest(spark, path)
        touched, rows = change(lambda parts=None, version=version: read(spark, path, schema, version, parts) if version
                               else spark.createDataFrame([], schema))
        folder = f"data/{uuid.uuid4().hex}"
        ready = rows.withColumn(PART, part).hint("rebalance", F.col(PART))
        ready.write.partitionBy(PART).parquet(f"{path}/{folder}")
        written = {n.removeprefix(f"{PART}="): f"{folder}/{n}" for n in storage.names(spark, f"{path}/{folder}") if n.startswith(f"{PART}=")}
        strange = set(written) - set(touched)
        if strange:
            raise ValueError(f"rows of parts that are not rewritten: {sorted(strange)}")
        after = {p: f for p, f in folders.items() if p not in touched} | written
        if storage.create(spark, f"{path}/{MANIFESTS}/{version + 1:09d}.json", json.dumps(after, sort_keys=True)):
            return version + 1
        storage.delete(spark, f"{path}/{folder}")
    raise RuntimeError(f"{path} changed {attempts} times while this batch was written")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete versions but for the latest ``keep``, and the folders that only they use. Not to be run
    beside a writer."""
    known = sorted(numbers(spark, path))
    kept = known[-keep:]
    used = {folder.split("/")[1] for v in kept for folder in manifest(spark, path, v)[1].values()}
    for version in known[:-keep]:
        storage.delete(spark, f"{path}/{MANIFESTS}/{version:09d}.json")
    for folder in storage.names(spark, f"{path}/data"):
        if folder not in used:
            storage.delete(spark, f"{path}/data/{folder}")
