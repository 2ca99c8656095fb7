"""What the corpus operators share: the cluster's shared folder, word splitting, connected components."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.sources.storage import shared_dir

#: The letters of the word pattern [^\x20\x09-\x0D]+ are all but these.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Cuts the lineage: writes df to the shared folder as Parquet and reads it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    gc.collect()
    spark._jvm.System.gc()  # Spark deletes the shuffle files behind the table only once the driver has collected their plans
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table of materialize() that nothing will read again."""
    spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: the driver and Python workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def spread(df: DataFrame) -> int:
    """Partitions for a shuffle whose size is not known: what the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(batch: pa.RecordBatch, column: str, most: int):
    """The batch in slices whose texts have at most ``most`` bytes together, or are one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, until - at)
        at = until


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words [^\\x20\\x09-\\x0D]+ of each text; null has none.

    Returns each word's number in the dictionary, the place of each text's first word (one more at the
    end), and the dictionary.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pa.array(~empty))
        gone = np.concatenate([[0], np.cumsum(empty)])
        offsets = offsets - gone[offsets]
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), offsets, coded.dictionary


def connected_components(edges: DataFrame) -> DataFrame:
    """Columns a, b (bigint) to node, root: root is the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., SoCC 2014). Each step is one aggregation with
    partial sums and one equi-join on its result, so no node's neighbours are ever gathered. The aggregate is written
    before it is joined: both sides of the join are then plain shuffles, of which adaptive execution cuts up the
    partition of a node with very many neighbours. Each round's tables replace those of the round before.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        if large:
            out = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            joined = both.join(low, "a")
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        out = materialize(out.where("a <> b").distinct())
        discard(low)
        discard(pairs)
        return out

    def mark(pairs: DataFrame):
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = star(star(edges, large=True), large=False)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
