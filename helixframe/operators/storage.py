"""Where iterative operators leave a round's rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; on one machine a folder of this process will do."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses; its last part is ``name``."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that the session names and go on from there.

    A folder of this process is set only where the session names none and all tasks run on this machine;
    elsewhere a missing name is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote for frames that nothing reads any more."""
    for df in written:
        rdd = df._jdf.queryExecution().analyzed().rdd()
        file = rdd.getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
