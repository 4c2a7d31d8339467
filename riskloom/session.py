"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Rows a task of a learner's pass has at least (as long as all cores have one), numbers at most.
ROWS_A_TASK, CELLS_A_TASK = 16_384, 1 << 25

def get_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session that names none (tests) gets a temporary one; a cluster must name it. The
    learners checkpoint into the context's folder, so it is set there as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-"))
        named = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for fitted tables, which are small next to the rows they were fitted on.
    As parquet they keep column pruning and size statistics, and they survive
    the loss of executors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/fitted-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def for_passes(df: DataFrame, n_rows: int, width: int, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df`` dealt out evenly for a learner that passes over it hundreds of times.

    A table of few files, or one cut finely for a shuffle, has too few or far too many
    partitions for that: short passes then cost what starting tasks costs. A task gets
    ``rows_a_task`` rows or more, as long as there are as many tasks as cores, and ``CELLS_A_TASK``
    numbers (``width`` a row) at most.
    """
    return df.repartition(tasks_of_a_pass(df.sparkSession, n_rows, width, rows_a_task))


def tasks_of_a_pass(spark: SparkSession, n_rows: int, width: int, rows_a_task: int = ROWS_A_TASK) -> int:
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, math.ceil(n_rows / rows_a_task)), math.ceil(n_rows * width / CELLS_A_TASK))


def fits_at_once(spark: SparkSession, tasks: int) -> int:
    """Learners to run side by side: four, or more where a pass has fewer tasks than there are cores.

    Between two passes a learner waits for the driver, so there are three tasks a core.
    """
    return max(4, 3 * spark.sparkContext.defaultParallelism // tasks)


def run_jobs(tasks: Mapping[object, Callable[[], object]], workers: int = 4) -> dict:
    """Run independent fits as concurrent Spark jobs; results by task key."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=workers) as pool:
        futures = {k: pool.submit(inherit(fn)) for k, fn in tasks.items()}
        return {k: f.result() for k, f in futures.items()}
