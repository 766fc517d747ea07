"""What the corpus operators share: batches bounded in bytes, lineage cuts, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to Python. Rows of texts vary from nothing to
#: megabytes, so a bound in rows alone would not bound memory.
BATCH_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session in bytes (a row larger than that comes alone)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is
    unset, on one machine only, a temporary folder that is then set as such."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or ""
    has = sc._jsc.sc().getCheckpointDir()
    if not has.isDefined():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarnwell-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


_tables: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors,
    and later reads take only the columns they need. It stays until ``clear_tables``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tarnwell-{uuid.uuid4().hex}"
    _tables.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Remove the tables that this driver has written to the shared folder; results that
    still read them must have been taken."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _tables:
        path = jvm.org.apache.hadoop.fs.Path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a written table; the tables written on the way to it are removed, and the
    shuffles of dead plans let go."""
    mark = len(_tables)
    out = written(make())
    spark = out.sparkSession
    rest, _tables[mark:] = _tables[mark:-1], _tables[-1:]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in rest:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    gc.collect()
    jvm.System.gc()
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder (small tables; kept as rows)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(c):
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def crc_fold(doc_id, n: int):
    """crc32 of doc_id as text, modulo n: the fold of a row; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def arrow_batches(rows: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[f.name], type=f.type) for f in schema], schema=schema
    )


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the texts of one slice hold about ``most`` bytes
    (a longer text comes alone)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        import pyarrow.compute as pc

        size = np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64)
        part = (np.cumsum(size) - size) // most
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield b.slice(lo, hi - lo)


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of the edges u-v, without the
    roots themselves: as many rows as nodes at most, however many edges."""
    if not len(u):
        return u, v
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long): rows (node, root) for each node of
    an edge, root being the smallest node reachable.

    Each partition first contracts its own edges to a forest. Then large-star and
    small-star rounds (Kiveris et al., 2014) alternate until the edges stay as they are;
    each is a partially aggregated min and an equi-join that AQE can split where a node
    is hot. Nothing but two sums per round comes to the driver.
    """

    def contract(batches):
        u, v = [], []
        held = 0
        for b in batches:
            u.append(b.column(0).to_numpy(zero_copy_only=False))
            v.append(b.column(1).to_numpy(zero_copy_only=False))
            held += b.num_rows
            if held > 2_000_000:
                x, y = local_forest(np.concatenate(u), np.concatenate(v))
                u, v, held = [x], [y], len(x)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])
                    u, v, held = [], [], 0
        if u:
            x, y = local_forest(np.concatenate(u), np.concatenate(v))
            for i in range(0, len(x), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000], pa.int64()), pa.array(y[i : i + 200_000], pa.int64())], ["u", "v"])

    def state(e):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    e = checkpointed(e.mapInArrow(contract, "u long, v long").distinct())
    was = state(e)
    for _ in range(rounds):
        if was[0] == 0:
            break
        # large-star: each larger neighbour of a node is linked to the node's smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        # small-star: each smaller neighbour, and the node, is linked to the smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = checkpointed(small)
        now = state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
