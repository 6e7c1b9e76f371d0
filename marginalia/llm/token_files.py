"""Token ids as flat files with 64-bit offsets, and reading them back by memory map.

A part holds the documents of one range of doc_id, in three files: the ids of all its documents one after the other
(unsigned, 16 bits where the vocabulary fits, else 32), the documents' offsets into them (64 bits, one more than there
are documents), and their doc_ids. A manifest lists the parts in order with their sizes; prefix sums over it say
where each part begins. Each attempt of a task writes files of its own and names them in its manifest row, so a repeated
task leaves nothing half-written in the result.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as pf
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import buffers, documents, longs, shuffle_partitions, units
from marginalia.llm.tokens import encoder as worker_encoder
from marginalia.scratch import shared_folder

#: How a null doc_id stands in the file of doc_ids; such documents come last.
NO_ID = -(2**63)

#: Bytes of text encoded at a time.
TEXT_BYTES = 4 << 20

#: Documents that a reader hands on at a time.
READ_DOCUMENTS = 20_000

_MANIFEST = "part long, path string, bits int, n_docs long, n_ids long"


def _place(root: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(root)


def _writer(root: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _place(root)
        fs.create_dir(folder, recursive=True)
        part, name = TaskContext.get().partitionId(), uuid4().hex
        encoder = worker_encoder(tokenizer)
        bits = 16 if max(encoder.size, end_id + 1) <= 1 << 16 else 32
        n_docs = n_ids = 0
        at = f"{folder}/{part:06d}-{name}"
        with fs.open_output_stream(f"{at}.tokens") as tokens, fs.open_output_stream(f"{at}.offsets") as offsets, fs.open_output_stream(f"{at}.docs") as docs:
            offsets.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                column = batch.column("text")
                _, sizes = buffers(column)
                for first, last in units(np.diff(sizes), TEXT_BYTES):
                    ids, ends = encoder.encode(column.slice(first, last - first), end_id)
                    tokens.write(ids.astype(f"<u{bits // 8}").tobytes())
                    offsets.write((n_ids + ends[1:]).astype("<i8").tobytes())
                    n_ids, n_docs = n_ids + len(ids), n_docs + last - first
                docs.write(longs(batch.column("doc_id"), NO_ID).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int64()), "path": [f"{root}/{part:06d}-{name}"], "bits": pa.array([bits], pa.int32()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())}
        )

    return write


def _mapped(path: str, dtype: str) -> np.ndarray:
    """A file's numbers: by memory map where the file system has one."""
    fs, at = _place(path)
    if isinstance(fs, pf.LocalFileSystem):
        return np.memmap(at, dtype, "r") if fs.get_file_info(at).size else np.zeros(0, dtype)
    with fs.open_input_file(at) as file:
        return np.frombuffer(file.read(), dtype)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            tokens, offsets, docs = (_mapped(f"{row['path']}.{x}", t) for x, t in (("tokens", f"<u{row['bits'] // 8}"), ("offsets", "<i8"), ("docs", "<i8")))
            for first in range(0, len(docs), READ_DOCUMENTS):
                ids = np.array(docs[first : first + READ_DOCUMENTS])
                at = np.array(offsets[first : first + len(ids) + 1])
                crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(ids, mask=ids == NO_ID), "start": at[:-1] + row["base"], "n_tokens": np.diff(at), "ids_crc32": pa.array(crcs, pa.int64())}
                )


@dataclass
class TokenFiles:
    """Written parts; ``manifest`` has part, path, bits, n_docs, n_ids and base, the number of ids before the part."""

    manifest: DataFrame

    def read(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
        spread = self.manifest.repartition(shuffle_partitions(self.manifest), "part")
        return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write(docs: DataFrame, tokenizer: str, end_id: int = 1, root: str | None = None) -> TokenFiles:
    """Writes the ids of every document (doc_id, text), each with ``end_id`` behind it, in ascending order of doc_id.

    A null text is empty and has the end id alone; null doc_ids come last; rows of one doc_id stand in the order of
    their texts. An empty table has no documents in its parts. Other columns are ignored. ``root`` is a folder that all
    executors share.
    """
    spark: SparkSession = docs.sparkSession
    root = root or shared_folder(spark)
    order = (F.col("doc_id").asc_nulls_last(), F.col("text"))
    parts = documents(docs).repartitionByRange(shuffle_partitions(docs), order[0]).sortWithinPartitions(*order)
    parts.mapInArrow(_writer(f"{root}/parts", tokenizer, end_id), _MANIFEST).write.parquet(f"{root}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = spark.read.parquet(f"{root}/manifest").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return TokenFiles(manifest)
