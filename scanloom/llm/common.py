"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Without it a session has none, and steps can't be kept;
    a folder of the driver's machine would not do on a cluster, so only a local session gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="scanloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_heap_after = 0


def collect_garbage(spark: SparkSession) -> bool:
    """Plans and generated classes of steps that are written are garbage of the driver, but its heap grows to its limit
    before they go, and the system has to keep that room. So they go when the heap is at half of its limit (and has grown
    since the last time, else what it holds is in use); the room is given back."""
    global _heap_after
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() < max(heap.maxMemory() / 2, 1.25 * _heap_after):
        return False
    heap.gc()
    _heap_after = heap.totalMemory()
    return True


def trim_native(spark: SparkSession) -> bool:
    """Gives back what the JVM's own allocations have freed: compiling generated classes leaves it to the C library, whose
    arenas (one a thread or so) keep it. False where the JVM doesn't know how."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, v in enumerate(values):
            out[k] = v
        return out

    named = jvm.java.lang.Class.forName
    try:  # by the interface's method: the server's own class can't be reached from outside of its module
        kinds = map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(jvm.java.lang.Object, command, "systemTrimNativeHeap", None, None))
    except Py4JError:  # an older JVM, or another C library
        return False
    return True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a step to the shared folder and reads it again: lineage ends here, and a lost executor costs no more
    than its running tasks. The shuffle files of the step and the driver's garbage go when it is written; unstage() removes the step itself.

    Tables are broadcast by the size that they have when they are shuffled, not by the estimate: that is the size of a
    compressed file, also of what is exploded to many rows for each of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    limit = spark.conf.get(ADAPTIVE, None) or spark.conf.get(BROADCAST)
    held = {k: spark.conf.get(k, None) for k in (CLEANUP, BROADCAST, ADAPTIVE)}
    for k, v in ((CLEANUP, "true"), (BROADCAST, "-1"), (ADAPTIVE, limit)):
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    collect_garbage(spark)
    trim_native(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*steps: DataFrame | None) -> None:
    """Removes the folders of steps that nothing reads any more."""
    for df in steps:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores until no column of the frames has it (whatever the case of letters)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n
