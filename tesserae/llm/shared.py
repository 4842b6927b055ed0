"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: White space that separates words in every contract of this package (fixed values).
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset in a local session
    a temporary folder is made and recorded in the session, and removed when Python ends. On a
    cluster it must be set, as executors could not read a folder of the driver's own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tesserae.shared", None)
    if where is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = f"file://{folder}"
        spark.conf.set("spark.tesserae.shared", where)
    return where.rstrip("/")


#: Paths that this process has handed out and not deleted.
_made: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession, *keep: DataFrame) -> None:
    """Delete all tables and files made so far but those that ``keep`` reads.

    For use once results were consumed: a result that still reads a deleted table fails.
    """
    stays = {folder.rsplit("/", 1)[-1] for df in keep for folder in _folders(df)}
    for path in [p for p in _made if p.rsplit("/", 1)[-1] not in stays]:
        _delete(spark, path)
        _made.discard(path)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def stored(df: DataFrame, name: str, even: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage and survives lost executors: readers need only the written files. Slim rows
    are dealt out evenly first, in as many parts as their size needs, so a pass of many tasks over
    texts leaves few files; without ``even`` every task writes its own, which suits whole texts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    (df.hint("rebalance") if even else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` that nothing needs any more."""
    for folder in _folders(df):
        _delete(spark, folder)
        _made.difference_update([p for p in _made if p.rsplit("/", 1)[-1] == folder.rsplit("/", 1)[-1]])


def document_columns(df: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone, absent ones as null, so extra columns cannot clash."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    return df.select(*[(df[c].cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])


def slices(batches: Iterator[pa.RecordBatch], text: int, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most_chars`` bytes of the given text column."""
    for batch in batches:
        n, start = batch.num_rows, 0
        if batch.nbytes <= most_chars or n < 2:
            yield batch
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        held = 0
        for i in range(n):
            if held and held + size[i] > most_chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size[i])
        if start < n:
            yield batch.slice(start, n - start)


def ddl(df: DataFrame, *without: str) -> str:
    """The schema of ``df`` as DDL, for functions that hand columns on."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in without)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: int = 1) -> DataFrame:
    """``mapInArrow`` with a per-task factory and bounded batches; ``text`` is the long column's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, text):
            yield work(batch)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of long texts hold fewer rows, unless the session sets its own number.

    The buffers of a batch lie outside the executor's heap, on both sides of the pipe.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def words_of(text: Column) -> Column:
    """The words (maximal runs of non-space characters) of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


#: Bits of a sieve at most: 8 MB, which holds some six million keys well and lets more through beyond.
SIEVE_BITS = 1 << 26


class Sieve:
    """A Bloom filter of keys: three places of a key in a broadcast table of bits."""

    def __init__(self, sent: Broadcast, bits: int):
        self.sent, self.bits = sent, bits

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(self.bits)) for k in (1, 2, 3)]

    def test(self, places: list[pa.Array]) -> np.ndarray:
        """Which keys may be among those of the sieve, by their places; runs on the executors."""
        table, out = self.sent.value, np.ones(len(places[0]), bool)
        for p in places:
            at = p.to_numpy(zero_copy_only=False)
            out &= (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out

    def __call__(self, key: Column) -> Column:
        @F.arrow_udf(BooleanType())
        def among(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return pa.array(self.test([a, b, c]))

        return among(*self.places(key))


def sieve(keys: DataFrame, column: str) -> Sieve:
    """A Bloom filter of a column's values.

    It keeps rows that a join would drop out of the join's shuffle; keys that pass must still be
    joined. Its size follows the count of keys up to ``SIEVE_BITS``, so what is broadcast is bounded,
    and with more keys it only lets more rows through.
    """
    spark = keys.sparkSession
    want = 12 * max(1, keys.count())
    made = Sieve(None, min(SIEVE_BITS, max(1 << 12, 1 << (want - 1).bit_length())))
    each = keys.where(F.col(column).isNotNull()).select(F.explode(F.array(*made.places(F.col(column)))).alias("p"))
    one = F.when(F.col("p").bitwiseAND(F.lit(63)) == 63, F.lit(-(1 << 63))).otherwise(F.expr("shiftleft(1L, cast(p & 63 as int))"))
    words = each.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(one).alias("b")).toArrow()
    table = np.zeros(made.bits // 64, np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    made.sent = spark.sparkContext.broadcast(table)
    return made


#: Rows of a table of groups (a source, a language and source) that is broadcast at most.
FEW = 50_000


def small(groups: DataFrame, count: int) -> DataFrame:
    """``groups`` marked for broadcast if its counted rows are few, else as it is.

    Joining one row per group this way leaves the large side where it is, so a hot group's rows are
    not dealt to one task; with more groups than ``FEW`` Spark joins by key and splits skewed ones.
    """
    return F.broadcast(groups) if count <= FEW else groups
