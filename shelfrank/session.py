"""Session helpers. Nothing here is needed on a cluster that is already configured."""

from pathlib import Path
import tempfile

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}  # by application

# SQL settings that can be set on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs one more exchange: a hot key may
    # hold a third of the rows.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # HotSpot does not compile methods longer than this; wide rows are then computed in smaller ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A part holds rows that grow about fifteenfold in a task's sorts and hash maps.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def local_session(cores: str = "8", app: str = "shelfrank", memory: str = "12g") -> SparkSession:
    """A local session for tests and timings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one that spark.checkpoint.dir names. Only where it is unset
    and all executors are threads of this process, as in tests, a temporary folder does."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL_FOLDERS.get(context.applicationId)
    if not named:
        named = _LOCAL_FOLDERS[context.applicationId] = Path(tempfile.mkdtemp(prefix="shelfrank-")).as_uri()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")
