"""Folders on any store that Spark reaches: listing, deleting, scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir; a temporary one for a local master only."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gaitframe-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/gaitframe-{tag}-{uuid.uuid4().hex}"


def listing(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    """path (relative to root), length and, if asked for, content of all files below root."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    p, fs = _fs(spark, root)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*?" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base), "")
    return df.select(relative.alias("path"), "length", *(["content"] if contents else []))
