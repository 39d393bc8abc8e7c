"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes and
# splits skewed shuffle partitions; duplicate JSON keys resolve last-wins
# (the rule of the JSON validator the toolkit mirrors).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text rows are CPU-heavy per byte: coalesce shuffle output to 16 MB
    # partitions rather than 64 MB so post-shuffle work keeps every core
    # busy.  Coalescing only merges, so at scale the shuffle partition count
    # still sets the upper bound.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only on measured sizes: no broadcast from plan-time estimates,
    # AQE may still switch a join to broadcast once a shuffle stage has
    # measured its side below this bound.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Reliable checkpoints are removed once their DataFrames are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app_name: str = "quizlens",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the toolkit's defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def is_one_machine(master: str) -> bool:
    """``local``, ``local[4]`` or ``local[4, 2]``: driver and executors share a disk."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3,
    ...) and is used as is.  A local session without one (tests) gets a
    private folder under the system temp directory; a cluster without one is
    an error, as each executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quizlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quizlens`` importable on every executor (once per application).

    Operators that run Python on the executors (model calls, embeddings,
    file writers) pickle functions by reference to this package; on a
    cluster the executors only have it if it is shipped.  The package is
    zipped in memory, written into the shared checkpoint folder and handed
    to ``SparkContext.addPyFile``.
    """
    import io
    import zipfile

    from pyarrow import fs as pafs

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    target = scratch_path(spark, "pkg") + "/quizlens.zip"
    uri = "file://" + target[len("file:"):] if target.startswith("file:") and not target.startswith("file://") else target
    if "://" in uri:
        filesystem, path = pafs.FileSystem.from_uri(uri)
    else:
        filesystem, path = pafs.LocalFileSystem(), uri
    filesystem.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(path) as out:
        out.write(buf.getvalue())
    sc.addPyFile(target)
    _SHIPPED.add(app)
