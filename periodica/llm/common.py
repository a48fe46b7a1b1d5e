"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodica.sources.shared import shared_dir

#: Bytes of text that one vectorised step works on; bounds the numpy temporaries of a Python worker.
SLAB_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder, for a table that an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def own(name: str) -> Column:
    """The input's column of that name, also if the name holds dots or back-ticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: Column | str) -> Column:
    """crc32 of the id's text leaves 1 when divided by 3: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False)) if isinstance(doc_id, str) else F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled rows outside the held-out third.

    The rows with the smallest hash of their id are taken, so the choice doesn't depend on how the
    tables are partitioned. The ids are max_rows at most, which bounds the broadcast.
    """
    picked = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # Of rows that repeat an id one is learned from, that of the smallest text digest, so no more than max_rows come out.
    found = id_text(docs).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"), F.first("y").alias("y"))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def as_strings(texts: pa.Array) -> list[str]:
    return [x or "" for x in texts.to_pylist()]


def slabs(texts: list, limit: int = SLAB_BYTES) -> Iterator[list]:
    """Consecutive runs of whole texts, each of about limit bytes or one longer text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
