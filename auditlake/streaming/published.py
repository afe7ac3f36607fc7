"""Tables that a stream keeps as a snapshot and small tables of changes, named by one pointer."""

import json

from pyspark.sql import SparkSession

#: Batches after which the small tables of changes become one snapshot.
COMPACT = 10
POINTER = "_current.json"


class PublishedFolder:
    """The table's folder through Hadoop's file system: small files are replaced as a whole."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.out, self.gateway = out.rstrip("/"), spark.sparkContext._gateway
        self.files = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}" if name else self.out)

    def pointer(self) -> dict:
        """What is published: the last batch, the snapshot, and the changes since it, oldest first."""
        if not self.files.exists(self._path(POINTER)):
            return {"batch": -1, "snapshot": None, "changes": []}
        stream = self.files.open(self._path(POINTER))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def publish(self, version: dict) -> None:
        """Write the pointer aside and put it in place in one step: a reader sees the old version or the new one."""
        aside = self._path(f"_next-{version['batch']}.json")
        stream = self.files.create(aside, True)
        stream.write(bytearray(json.dumps(version).encode()))
        stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        self.context.rename(aside, self._path(POINTER), options)

    def remove(self, names: list[str]) -> None:
        for name in names:
            self.files.delete(self._path(name), True)


def tables(version: dict) -> list[str]:
    return ([version["snapshot"]] if version["snapshot"] else []) + version["changes"]


def next_version(now: dict, batch_id: int, change: str, snapshot: str | None) -> dict:
    """The pointer after a batch: one more table of changes, or the snapshot that has taken them all in."""
    version = {"batch": batch_id, "snapshot": snapshot or now["snapshot"], "changes": [] if snapshot else [*now["changes"], change]}
    # Readers of the version just replaced may still be running: its folders go one version later.
    version["old"] = [t for t in [*tables(now), change] if t not in tables(version)]
    return version
