"""Where intermediate results go: the folder that the cluster names, which all machines share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set for checkpoints too.

    Only a local master gets a folder of its own where none is named, as in tests; on a cluster a
    machine's own folder would not be seen by the others, so that is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (None if current.isEmpty() else current.get())
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='checkpoints')}"
    if current.isEmpty():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder from now on; executors may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one computation in the shared folder.

    A table cuts the lineage as a checkpoint does, but holds Parquet, is read in few tasks however many
    wrote it, and goes as soon as its last reader is done. The shuffle files behind it go when it is
    written. What a lazy result still reads is kept until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []
        self._fs().mkdirs(self._path(self.root))  # only what is there can be marked
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, random: bool = False) -> DataFrame:
        """``df`` as a table; ``random`` says that most of its values are fingerprints, for which dictionaries are no use."""
        path = f"{self.root}/{len(self.tables)}"
        before = self.spark.conf.get(_DROP_SHUFFLES, None)
        self.spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.option("parquet.enable.dictionary", str(not random).lower()).parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_DROP_SHUFFLES)
            else:
                self.spark.conf.set(_DROP_SHUFFLES, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table, path in self.tables:
            if any(table is t for t in tables):
                self._fs().delete(self._path(path), True)

    def close(self, *keep: DataFrame) -> None:
        """Deletes all tables but those that a result still reads."""
        self.drop(*(t for t, _ in self.tables if not any(t is k for k in keep)))
        if not keep:
            self._fs().delete(self._path(self.root), True)
