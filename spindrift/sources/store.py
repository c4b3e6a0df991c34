"""Where intermediate tables go: the folder that the cluster names in ``spark.checkpoint.dir``.

They stay until :func:`clear` is called, because results are read from them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session.

    ``spark.checkpoint.dir`` is used as it stands.  Only a session with a local master that names
    none (as in tests) gets a temporary folder; a cluster without the setting is an error, because
    executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="spindrift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = "file://" + own
    return _OWN[app]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this application has made here, and says how many; results that read them are gone then."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
    return len(made)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, made from ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
