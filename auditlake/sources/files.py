"""Reading a corpus of repositories.

The main source is a table of files (repo, path, size, content). Directories are read by
``corpus_load``. Spark's own file listing leaves out names starting with '.' or '_', and
secrets, pipeline definitions and policies live in just such files, so the listing is done
by the tasks. Functions of tasks are nested, so they travel with the job to executors
that have no copy of this package.
"""

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import decode_lossy
from auditlake.workspace import stored

#: Bytes held before rows are passed on, read by one task, and of one range of a file (a multiple of three).
BATCH_BYTES = 32 * 1024 * 1024
TASK_BYTES = 256 * 1024 * 1024
RANGE_BYTES = 48 * 1024 * 1024


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of files; text or raw bytes in ``content``."""
    files = spark.read.format(fmt).load(path)
    return files.select(
        "repo",
        "path",
        F.col("size").cast("bigint").alias("size"),
        decode_lossy(F.col("content")).alias("content"),
    )


_LISTED = "repo STRING, root STRING, path STRING, folder BOOLEAN, size BIGINT"


def _one_level(frontier: DataFrame) -> DataFrame:
    """What lies directly in the folders (repo, root, path): files with their size, and folders. A root that is none fails."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for repo, root, path in zip(*(batch.column(c).to_pylist() for c in ("repo", "root", "path"))):
                files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
                whole = f"{base.rstrip('/')}/{path}" if path else base
                # Raises for a root that is missing or no folder; a folder that has gone since it was listed is empty.
                found = files.get_file_info(fs.FileSelector(whole, allow_not_found=bool(path)))
                if isinstance(files, fs.LocalFileSystem):  # links to folders may lead in circles
                    found = [x for x in found if x.type != fs.FileType.Directory or not os.path.islink(x.path)]
                found = [x for x in found if x.type in (fs.FileType.File, fs.FileType.Directory)]
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([repo] * n, pa.string()), pa.array([root] * n, pa.string()),
                        pa.array([f"{path}/{x.base_name}" if path else x.base_name for x in found], pa.string()),
                        pa.array([x.type == fs.FileType.Directory for x in found], pa.bool_()), pa.array([x.size for x in found], pa.int64()),
                    ],
                    ["repo", "root", "path", "folder", "size"],
                )

    return frontier.select("repo", "root", "path").mapInArrow(listed, _LISTED)


def list_files(roots: DataFrame) -> DataFrame:
    """Files below the roots (repo, root): repo, root, path, size, hidden names included.

    The tree is listed breadth first: each level's folders are written, spread anew over all tasks and listed together, so one huge
    repository is as many tasks as it has folders in a level. Every level is stored; a lost executor repeats a part of one.
    """
    spark = roots.sparkSession
    found: DataFrame | None = None
    frontier = roots.select("repo", "root", F.lit("").alias("path"))
    while True:
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        level = stored(_one_level(frontier.repartition(tasks, F.xxhash64("repo", "root", "path"))), "listing")
        files = level.filter(~F.col("folder")).select("repo", "root", "path", "size")
        found = files if found is None else found.unionByName(files)
        frontier = level.filter("folder").select("repo", "root", "path")
        if frontier.isEmpty():
            return found


_READ = "repo STRING, path STRING, size BIGINT, part BIGINT, content BINARY, error STRING"


def _read_ranges(ranges: DataFrame) -> DataFrame:
    """Bytes of ranges (repo, root, path, size, part, offset, length), or why they could not be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("repo", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("part", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                files, base = fs.FileSystem.from_uri(row["root"]) if "://" in row["root"] else (fs.LocalFileSystem(), row["root"])
                content = error = None
                try:
                    with files.open_input_file(f"{base.rstrip('/')}/{row['path']}") as f:
                        content = f.read_at(row["length"], row["offset"])
                except OSError as e:  # told in the row, as a warning of the scan
                    error = str(e)
                rows.append({"repo": row["repo"], "path": row["path"], "size": row["size"], "part": row["part"], "content": content, "error": error})
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.mapInArrow(read, _READ)


def corpus_load(roots: DataFrame, max_bytes: int | None = None, tasks: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Files below the given roots: rows (repo, root) to rows (repo, path, size, content, error).

    ``root`` is a folder, or a URI of a file system that pyarrow opens (file, HDFS, S3), which every executor can read; one that
    cannot be listed fails the job. A file that cannot be read has no content and says why in ``error`` (null otherwise).
    The listing (names and sizes) is spread over about one task per TASK_BYTES, or ``tasks``. A file above ``range_bytes`` is read in
    ranges by several tasks and put together once; smaller ones are not moved. Nothing is listed or read on the driver.
    """
    if range_bytes % 3:
        raise ValueError("range_bytes must be a multiple of three")
    listing = list_files(roots)
    if max_bytes is not None:
        listing = listing.filter(F.col("size") <= max_bytes)
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n = tasks or max(roots.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint"))
    ranges = listing.select("*", F.posexplode(starts).alias("part", "offset")).withColumn("length", F.least(F.lit(range_bytes), F.col("size") - F.col("offset")))

    def read(rows: DataFrame) -> DataFrame:
        return _read_ranges(rows.repartition(n, F.xxhash64("repo", "path", "part")))

    small = read(ranges.filter(F.col("size") <= range_bytes)).drop("part")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda p: F.base64(p["content"]))
    # Encoded in base64, since only text can be joined; a range is a multiple of three bytes, so the pieces follow without padding.
    large = read(ranges.filter(F.col("size") > range_bytes)).groupBy("repo", "path", "size").agg(
        F.when(F.max("error").isNull(), F.unbase64(F.array_join(parts, ""))).alias("content"), F.max("error").alias("error")
    )
    files = small.unionByName(large)
    return files.select("repo", "path", "size", decode_lossy(F.col("content")).alias("content"), "error")


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write files (repo, path, content as binary or text) below ``folder``/repo and give the stored list (repo, path, size). Paths must be distinct."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            for repo, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                whole = f"{root}/{repo}/{path}"
                out.create_dir(whole.rpartition("/")[0], recursive=True)
                with out.open_output_stream(whole) as f:
                    f.write(content)
            sizes = pa.array([len(c) for c in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["repo", "path", "size"])

    rows = files.select("repo", "path", F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    return stored(rows.mapInArrow(put, "repo STRING, path STRING, size BIGINT"), "written-files")


def documents_as_files(documents: DataFrame, folder: str = "src", extension: str = ".py") -> DataFrame:
    """A table of texts (doc_id, text, source) seen as source files of one repository per source."""
    return documents.select(
        F.col("source").alias("repo"),
        F.concat(F.lit(folder + "/d"), F.col("doc_id").cast("string"), F.lit(extension)).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").alias("content"),
    )
