"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that plans rely on or gain from; on a cluster, sizes of executors and memory are the deployment's own.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "scriptorium", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings above; more by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (b.master(master) if master else b).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder that spark.checkpoint.dir names; in local mode one of its own where it is unset."""
    import uuid

    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{home or '/tmp/checkpoints'}/scratch-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there."""
    from pyspark.sql.types import StructType

    spark, home = rows.sparkSession, scratch(rows.sparkSession)
    rows.write.parquet(home)
    return spark.read.schema(StructType(rows.schema.fields)).parquet(home)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a table's files, from listings alone."""
    import hashlib

    found = []
    for name in spark.read.parquet(path).inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        s = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        found.append(f"{name} {s.getLen()} {s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


_KEPT: dict[tuple[str, ...], str] = {}


def kept(spark: SparkSession, name: str, source: str, build) -> str:
    """The folder of what build(folder) made of a table; it is made once for each application and state of the table's files."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, source))
    if key not in _KEPT:
        home = scratch(spark)
        build(home)
        _KEPT[key] = home
    return _KEPT[key]
