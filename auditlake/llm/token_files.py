"""Token ids of all documents as wavelet matrix files, one per shard."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import partitions, slices, stored, texts_of
from auditlake.llm.tokens import END, encoder
from auditlake.llm.wavelet import WaveletMatrix, write
from auditlake.workspace import fresh_path

#: A shard ends with the document that reaches this many tokens.
SHARD_TOKENS = 1 << 22
_SHARDS = "part int, shard int, name string, docs long, tokens long, bytes long"


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as tasks need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write_shards(docs: DataFrame, folder: str, shard_tokens: int = SHARD_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Write files of the rows (doc_id, text) in ascending doc_id order (null first) and return the stored list of shards.

    Documents are range-sorted by doc_id; a task encodes its range and writes a file whenever a shard is full, so it holds
    one shard. A file's name follows from range and shard number; it is written aside and renamed, so a repeated task
    replaces its own files. List: part, shard, name, docs, tokens, bytes, start (tokens before the shard).
    """
    spark = docs.sparkSession
    folder = _address(spark, folder)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        own, end = encoder(vocabulary), END.to_bytes(4, "little")
        ids: list[int | None] = []
        data: list[bytes] = []
        size = number = 0

        def flush(part: int) -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in data], np.uint64)
            known = np.array([x is not None for x in ids], np.uint8)
            numbers = np.array([x or 0 for x in ids], np.int64)
            content = write(numbers, known, lengths, np.frombuffer(b"".join(data), "<u4"))
            name = f"{part:05d}-{number:05d}.wvm"
            aside = f"{root}/_{name}.{context.taskAttemptId()}"
            with files.open_output_stream(aside) as out:
                out.write(content)
            if files.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/{name}")
            files.move(aside, f"{root}/{name}")
            row = [part, number, name, len(ids), size, len(content)]
            return pa.RecordBatch.from_pylist([dict(zip(("part", "shard", "name", "docs", "tokens", "bytes"), row))], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
        part = context.partitionId()
        for batch in slices(batches):
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), own.encode(texts_of(batch.column("text")))):
                ids.append(doc_id)
                data.append(found + end)
                size += len(data[-1]) // 4
                if size >= shard_tokens:
                    yield flush(part)
                    ids, data, size, number = [], [], 0, number + 1
        if ids:
            yield flush(part)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("tie"))
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    shards = stored(ranged.select("doc_id", "text").mapInArrow(put, _SHARDS), "token-shards")
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.join(parts, "part").withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("base")


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (in all tokens), n_tokens, ids_crc32. A task reads one file at a time."""
    spark = shards.sparkSession
    folder = _address(spark, folder)
    shards = stored(shards.select("name", "start"), "token-starts")
    files_in_all = shards.count()

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with files.open_input_file(f"{root}/{name}") as source:
                    matrix = WaveletMatrix(source.read())
                raw = memoryview(matrix.tokens().tobytes())
                ends = np.cumsum(matrix.lengths).astype(np.int64)
                starts = ends - matrix.lengths.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(matrix.doc_ids, mask=matrix.known == 0), pa.array(starts + start), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = shards.repartitionByRange(max(1, min(files_in_all, 10_000)), "start")  # about a file a task
    return spread.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, shard_tokens: int = SHARD_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens (end id included), ids_crc32, one row per row of ``docs``.

    A null or empty text is its end token. Rows of one doc_id stand side by side; null doc_ids come first; no rows write no
    file. A text of any length goes whole into one shard. Other columns are not read.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, folder, shard_tokens, vocabulary), folder)
