"""Atomic publication: parts are written aside, one manifest makes them current.

A run writes its parts (tables, a model) below ``runs/<run id>/<attempt>``; nothing there is read
until a manifest names it. Manifests are numbered files that are moved into place whole and never
replaced. Readers take the highest number. So a crash before the move leaves the last version as
it was, and a reader never meets half of a version; a run that is played again finds its manifest
and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, run_id string, parts map<string,string>"


class PublishedMeanwhile(RuntimeError):
    """Another run took the next version first; start again from what is current now."""


@dataclass(frozen=True)
class Published:
    version: int
    run_id: str
    parts: dict[str, str]


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _manifests(spark: SparkSession, root: str):
    """All whole manifests, or None where there is no folder yet."""
    folder = _path(spark, f"{root}/manifests")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder) or not files.globStatus(_path(spark, f"{root}/manifests/v*.json")):
        return None
    return spark.read.schema(MANIFEST).json(f"{root}/manifests/v*.json").where("version IS NOT NULL")


def current(spark: SparkSession, root: str, run_id: str | None = None) -> Published | None:
    """The latest version, or the one that ``run_id`` published."""
    found = _manifests(spark, root)
    if found is None:
        return None
    row = (found if run_id is None else found.where(F.col("run_id") == run_id)).orderBy(F.desc("version")).head()
    return None if row is None else Published(row["version"], row["run_id"], dict(row["parts"]))


def publish(spark: SparkSession, root: str, run_id: str, parts: Mapping[str, Callable[[str], None]], after: Published | None) -> Published:
    """Write all parts, then make them the version that follows ``after``.

    Each part is a function that writes to a path. A part that is not given stays as it is in ``after``."""
    done = current(spark, root, run_id)
    if done is not None:
        return done
    places = {} if after is None else dict(after.parts)
    attempt = f"{root}/runs/{run_id}/{uuid.uuid4().hex}"
    for name, write in parts.items():
        write(f"{attempt}/{name}")
        places[name] = f"{attempt}/{name}"
    version = Published(1 if after is None else after.version + 1, run_id, places)
    _place(spark, f"{root}/manifests", version)
    return version


def _place(spark: SparkSession, folder: str, version: Published) -> None:
    """Move a whole manifest to its number; a number that is taken stays as it is."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    aside, target = _path(spark, f"{folder}/.{uuid.uuid4().hex}"), _path(spark, f"{folder}/v{version.version:08d}.json")
    files = target.getFileSystem(conf)
    out = files.create(aside)
    out.write(json.dumps({"version": version.version, "run_id": version.run_id, "parts": version.parts}).encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    keep = spark.sparkContext._gateway.new_array(rename, 1)
    keep[0] = rename.NONE  # fails on a number that exists
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf) if "://" in folder else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(target), keep)
    except Exception as taken:
        if files.exists(target):
            files.delete(aside, False)
            raise PublishedMeanwhile(f"version {version.version} is taken") from taken
        raise
