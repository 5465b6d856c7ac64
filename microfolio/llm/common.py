"""Helpers of this subpackage: stage tables in the shared folder, Arrow batches by size."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import remove_path, stages_folder

BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this library: once per application, an archive of it in the shared folder."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(f"{package.name}/{source.relative_to(package).as_posix()}"), source.read_bytes())
    name = f"{package.name}-{zlib.crc32(packed.getvalue()):08x}.zip"
    if name in context._python_includes:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(f"{stages_folder(spark)}/{uuid.uuid4().hex}/{name}")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path.toString())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, on a session whose workers have this library."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place among the application's stage tables, which ``session.remove_stages`` clears."""
    return f"{stages_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the frame to the shared folder and goes on from the files, which outlive executors."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    for paths in _scratch[-1:]:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Stage tables written inside go when the block ends, but for those written by the given function, which the caller reads on.

    Nothing else that was made inside may be read after the block.
    """
    kept: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        kept.append(_scratch[-1].pop())
        return out

    _scratch.append([])
    try:
        yield keep
    finally:
        for path in _scratch.pop():
            remove_path(spark, path)
        for paths in _scratch[-1:]:
            paths += kept


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)


def map_pieces(df: DataFrame, column: str, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``function`` over bounded runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, column):
            yield function(piece)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def named(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    """The columns ``keep`` of a batch and further ones."""
    return pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + list(more.values()), names=keep + list(more))


BITMAP_WORDS = 1 << 17


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``likely__``: true where the key is among ``keys``, and for few others. The bitmap has a fixed size (``BITMAP_WORDS`` words)."""
    place = F.xxhash64(key)
    word, bit = F.pmod(F.shiftright("place__", 6), F.lit(BITMAP_WORDS)), F.expr("cast(place__ & 63 as int)")
    marks = keys.select(place.alias("place__")).groupBy(word.alias("word__"))
    bitmap = marks.agg(F.expr("bit_or(shiftleft(1L, cast(place__ & 63 as int)))").alias("bits__"))
    found = rows.withColumn("place__", place).withColumn("word__", word).join(F.broadcast(bitmap), "word__", "left")
    return found.withColumn("likely__", F.coalesce(F.getbit("bits__", bit) == 1, F.lit(False))).drop("place__", "word__", "bits__")


def likely_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is wanted, and few others; spares the others a shuffle."""
    return _marked(rows, wanted, key).where("likely__").drop("likely__")


def not_in(rows: DataFrame, unwanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` (not null) is not in ``unwanted``; most of them without a shuffle."""
    marked = _marked(rows, unwanted, key)
    sure, doubtful = (marked.where(c).drop("likely__") for c in ("not likely__", "likely__"))
    gone = unwanted.select(key).distinct().withColumn("gone__", F.lit(True))  # an anti-join would be moved before the bitmap
    left = doubtful.join(gone, key, "left").where("gone__ is null").select(sure.columns)
    return sure.unionByName(left)


def crc_of(column: str, parts: int):
    """crc32 of an id written as text, modulo ``parts``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))
