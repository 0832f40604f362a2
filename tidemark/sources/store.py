"""Tables that change together: written under new names, and made current by one manifest that only one writer can put.

A reader that has pinned a manifest sees its tables and no others for as long as it likes. A writer gives the number that it
has read from; if another manifest has been put since, nothing of its own counts. What a writer has left half done
is in files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


class Stale(RuntimeError):
    """Another writer has put a manifest since the one that was read."""


class Store:
    """A folder of tables and numbered manifests; ``kind`` is a format that Spark writes."""

    def __init__(self, spark: SparkSession, folder: str, kind: str = "parquet"):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self._conf)

    def version(self) -> int:
        """The number of the newest manifest, 0 before the first."""
        path, files = self._path("manifests")
        if not files.exists(path):
            return 0
        names = [status.getPath().getName() for status in files.listStatus(path)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int) -> dict:
        if not version:
            return {}
        row = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).first()
        return json.loads(row[0])

    def pin(self, version: int | None = None) -> Snapshot:
        """The tables of one manifest, the newest unless another is asked for."""
        at = self.version() if version is None else version
        return Snapshot(self, at, self.manifest(at))

    def commit(self, base: int, tables: Mapping[str, DataFrame], note: str = "") -> int:
        """Write the tables and make them current in place of those that ``base`` names; the others stay. Returns the number.

        Raises ``Stale`` if ``base`` isn't the newest manifest any more, also where two writers end at the same time: the
        manifest's name is taken by a rename that doesn't replace.
        """
        if self.version() != base:
            raise Stale(f"{self.folder} has moved on from {base}")
        named = {name: dict(of) for name, of in self.manifest(base).get("tables", {}).items()}
        for name, rows in tables.items():
            place = f"tables/{name}/{base + 1:012d}-{uuid.uuid4().hex}"
            rows.write.format(self.kind).save(f"{self.folder}/{place}")
            named[name] = {"path": place, "schema": json.loads(rows.schema.json())}
        return self._put(base + 1, {"version": base + 1, "base": base, "note": note, "tables": named})

    def _put(self, version: int, manifest: dict) -> int:
        draft, files = self._path(f"manifests/.{uuid.uuid4().hex}")
        final, _ = self._path(f"manifests/{version:012d}.json")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, never)
        except Exception as error:
            files.delete(draft, False)
            if files.exists(final):
                raise Stale(f"{self.folder}: {version} has been put by another writer") from error
            raise
        return version


class Snapshot:
    """The tables of one manifest."""

    def __init__(self, store: Store, version: int, manifest: dict):
        self.store, self.version, self.note = store, version, manifest.get("note", "")
        self.tables: dict = manifest.get("tables", {})

    def read(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        held = self.tables[name]
        return self.store.spark.read.format(self.store.kind).schema(StructType.fromJson(held["schema"])).load(f"{self.store.folder}/{held['path']}")


def export(source: Snapshot, views: Mapping[str, Callable[[Snapshot], DataFrame]], target: Store) -> int:
    """Write several public views of one snapshot as one consistent set; until all are there, readers keep the set before.

    A set of the same snapshot isn't written again.
    """
    base = target.version()
    note = f"of {source.version}"
    if base and target.pin(base).note == note and set(target.pin(base).tables) == set(views):
        return base
    return target.commit(base, {name: view(source) for name, view in views.items()}, note)


def stored(store: Store, step: Callable[[Snapshot, DataFrame], Mapping[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that changes tables by each batch exactly once: the manifest that makes a batch's tables current
    also says that the batch is done, so a batch that comes again, whatever its first try has left, changes nothing more."""

    def run(batch: DataFrame, batch_id: int) -> None:
        held = store.pin()
        done = int(held.note.removeprefix("batch ")) if held.note.startswith("batch ") else -1
        if batch_id > done:
            store.commit(held.version, step(held, batch), f"batch {batch_id}")

    return run
