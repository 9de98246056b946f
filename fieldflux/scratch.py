"""Cutting lineage and size-checked broadcasts."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Of the rows that a broadcast side may have, so that it stays far below executor memory.
MAX_BROADCAST_BYTES = 48 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.  Only a local session
    without that setting gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    named = named or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldflux-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: later stages get
    column pruning, the lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> int:
    """What a row of this schema takes, strings and arrays by Spark's own default size for them."""
    return 16 + df.sparkSession._jvm.org.apache.spark.sql.types.DataType.fromJson(df.schema.json()).defaultSize()


def is_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True if the rows of df take at most max_bytes; reads no more rows than that."""
    most = max(1, max_bytes // row_bytes(df))
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def shuffled(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never broadcast.  A generator's rows are estimated by the rows
    before it, so a table grown by one would be broadcast whatever its size; skewed keys can still be split."""
    return df.hint("merge")


def hashed(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """df, a stored table, as the side of a join from which each partition makes a hash table, so that the other side is not
    sorted; a larger one than max_bytes for each shuffle partition as `shuffled`."""
    most = max_bytes * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if df.count() * row_bytes(df) <= most else shuffled(df)


def apart(df: DataFrame, name: str) -> DataFrame:
    """df with its generated code cut here: columns so far and later ones get methods of their own, where a long chain of
    projections would be one method, too large to be compiled.  name: a column of plain numbers, kept as it is.

    Spark's whole-stage code starts a method where an operator uses all columns below it, as a generator does."""
    whole = df.columns
    return df.withColumn("_apart", F.explode(F.array(name))).select(*[F.col("_apart").alias(c) if c == name else F.col(c) for c in whole])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions, for small tables whose rows are about to become many each: tasks
    would be sized by the rows before that."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", bounded: bool = False):
    """Join with a broadcast hint where `small` is known or found to be small, otherwise as a
    plain shuffle join that adaptive execution can split on skewed keys.

    Pass bounded=True only where the caller has already checked the size."""
    if bounded or is_small(small):
        return big.join(F.broadcast(small), on, how)
    return big.join(shuffled(small), on, how)
