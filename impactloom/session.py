"""Session helpers for local runs; a cluster passes in its own session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app: str = "impactloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with UTC timestamps and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where that is unset, a local run gets a temporary folder; a cluster, whose executors would not see it, gets an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="impactloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def dealt_session(spark: SparkSession, parts: int) -> SparkSession:
    """A session of the same context, with the same settings but for these: a shuffle has ``parts`` parts, which are not put
    together, a file is read by a task of its own, no table is broadcast, and rows that are dealt by one key of a join are not
    dealt again by all of them.

    For tables that are small as files and large as rows, of which adaptive execution knows the former.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k) and own.conf.get(k, None) != v:
            own.conf.set(k, v)
    own.conf.set("spark.sql.shuffle.partitions", parts)
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    own.conf.set("spark.sql.files.openCostInBytes", own.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for by in ("", "adaptive."):
        own.conf.set(f"spark.sql.{by}autoBroadcastJoinThreshold", "-1")
    return own


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
