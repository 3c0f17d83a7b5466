"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (so a
# small side is broadcast only when it really is small) and splits skewed
# shuffle partitions; UTC keeps zoned literals equal to the zone-free parquet
# timestamps.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "campusledger",
                shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) the session with the library defaults applied.

    On a cluster ``master`` stays ``None`` so that spark-submit decides.
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
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage (checkpoints, written tables).

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Where it is unset, a session in one process takes a scratch folder, any
    other one a folder in the warehouse, which all its executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if re.match(r"local($|\[)", spark.sparkContext.master or ""):
            configured = tempfile.mkdtemp(prefix="campusledger-ckpt-")
        else:
            configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage like a checkpoint (a lost executor costs a re-read), and
    the optimizer sees the size of the files: a checkpoint keeps the estimate of its
    plan, which a loop of joins multiplies up from round to round.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
