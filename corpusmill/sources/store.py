"""Collections: Parquet tables by name in one folder, with the operations of a document store.

A collection's rows lie in buckets by the hash of its key column. A change reads and writes only the buckets
that hold a key of it; all others keep their files. What counts is told by a manifest, a small file
that names each bucket's folder: a change is there when its manifest is, so that readers see one state or the other and a
failed job leaves the old one. A second writer of the same state fails, for manifests aren't replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new collection. A collection keeps its number; choose it so that a bucket has some hundred MB.
BUCKETS = 16
_BUCKET = "__bucket"
#: Compression of the files.
CODEC = "zstd"


class Store:
    """Collections under ``root``, a folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _states(self, name: str) -> list[str]:
        return [f for f in self._names(f"{self.root}/{name}") if f.startswith("manifest-")]

    def _load(self, name: str, state: str) -> dict | None:
        """The manifest, or None if it isn't whole."""
        stream = self._fs.open(self._path(f"{self.root}/{name}/{state}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self, name: str) -> dict:
        """The newest state: number, key, buckets, schema, and the folder of each bucket that has rows."""
        for state in reversed(self._states(name)):
            if found := self._load(name, state):
                return found
        raise KeyError(f"no collection {name}")

    def _publish(self, name: str, manifest: dict) -> None:
        at = self._path(f"{self.root}/{name}/manifest-{manifest['number']:08d}.json")
        out = self._fs.create(at, False)  # fails if another writer has made this state
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        states = self._states(name)
        if len(states) > 2:  # the state before may still be read by a plan
            held = {f for s in states[-2:] for f in ((self._load(name, s) or {}).get("files") or {}).values()}
            for state in states[:-2]:
                for old in set(((self._load(name, state) or {}).get("files") or {}).values()) - held:
                    self._fs.delete(self._path(f"{self.root}/{name}/{old}"), True)
                self._fs.delete(self._path(f"{self.root}/{name}/{state}"), False)

    # Reading

    def collections(self) -> list[str]:
        """Names of all collections."""
        return [n for n in self._names(self.root) if self._states(n)]

    def exists(self, name: str) -> bool:
        """Whether there is a collection of that name."""
        return bool(self._states(name))

    def _rows(self, name: str, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/{name}/{f}" for b, f in manifest["files"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """The collection's rows."""
        return self._rows(name, self.manifest(name))

    def bucket(self, manifest: dict, key: str | Column | None = None) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(key if key is not None else manifest["key"]), F.lit(manifest["buckets"])).cast("int")

    def touched(self, name: str, keys: DataFrame, key: str | None = None) -> set[int]:
        """The buckets that hold the keys of ``keys``, whatever their number."""
        manifest = self.manifest(name)
        return {r[0] for r in keys.select(self.bucket(manifest, key or manifest["key"])).distinct().collect()}

    def read_touched(self, name: str, keys: DataFrame, key: str | None = None) -> DataFrame:
        """The rows of all buckets that hold a key of ``keys``; no other bucket's files are read."""
        return self._rows(name, self.manifest(name), self.touched(name, keys, key))

    def get(self, name: str, ids: DataFrame) -> DataFrame:
        """The rows of ``ids`` (a column named like the collection's key)."""
        key = self.manifest(name)["key"]
        return self.read_touched(name, ids).join(ids.select(key).distinct(), key, "left_semi")

    def peek(self, name: str, n: int = 10) -> DataFrame:
        """Any ``n`` rows."""
        return self.read(name).limit(n)

    def count(self, name: str) -> int:
        """Number of rows."""
        return self.read(name).count()

    # Writing

    def _write(self, name: str, rows: DataFrame, manifest: dict, sort: list[str], placed: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, str]:
        """Write ``rows`` by bucket; returns each one's folder.

        A bucket is one file or, beyond the advised size of a partition, several, so that no task sorts more than that. Where
        ``placed`` holds, rows are written from the tasks where they are.
        """
        at = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumn(_BUCKET, self.bucket(manifest))
        dealt = (rows if placed else rows.hint("rebalance", _BUCKET)).sortWithinPartitions(_BUCKET, *sort)
        (then(dealt) if then else dealt).write.partitionBy(_BUCKET).option("compression", CODEC).parquet(f"{self.root}/{name}/{at}")
        made = [f for f in self._names(f"{self.root}/{name}/{at}") if f.startswith(f"{_BUCKET}=")]
        return {f.partition("=")[2]: f"{at}/{f}" for f in made}

    def write(self, name: str, rows: DataFrame, key: str = "id", buckets: int | None = None, sort: list[str] | None = None, placed: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Make ``rows`` the collection, in buckets by ``key``, sorted in a file by ``sort`` (the key by default).

        ``then`` is done to each row when it has been sorted, and keeps the key. With ``placed`` rows aren't shuffled: each task writes a file to each
        bucket that it has rows of.
        """
        states = self._states(name)
        number = int(states[-1].removeprefix("manifest-").removesuffix(".json")) + 1 if states else 1
        manifest = {"number": number, "key": key, "buckets": buckets or self.buckets, "sort": sort or [key], "schema": (then(rows) if then else rows).schema.jsonValue()}
        self._publish(name, manifest | {"files": self._write(name, rows, manifest, manifest["sort"], placed, then)})
        return self.read(name)

    def rewrite(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], placed: bool = False) -> DataFrame:
        """Replace the rows of the buckets that hold a key of ``keys`` by what ``change`` makes of them.

        ``change`` may only take away or add rows whose keys are among ``keys``. Nothing is written if there are none. ``placed`` is as in ``write``.
        """
        manifest = self.manifest(name)
        touched = self.touched(name, keys, manifest["key"])
        if touched:
            now = self._rows(name, manifest, touched)
            files = {b: f for b, f in manifest["files"].items() if int(b) not in touched}
            made = self._write(name, change(now).select(*now.columns), manifest, manifest["sort"], placed)
            self._publish(name, manifest | {"number": manifest["number"] + 1, "files": files | made})
        return self.read(name)

    def add(self, name: str, rows: DataFrame) -> DataFrame:
        """Append rows whose keys the collection doesn't hold yet."""
        if not self.exists(name):
            return self.write(name, rows)
        key = self.manifest(name)["key"]
        return self.rewrite(name, rows, lambda now: now.unionByName(rows.join(now.select(key), key, "left_anti").select(*now.columns)))

    def update(self, name: str, rows: DataFrame) -> DataFrame:
        """Replace rows by key; keys that the collection doesn't hold are passed over."""
        key = self.manifest(name)["key"]

        def change(now: DataFrame) -> DataFrame:
            new = rows.join(now.select(key), key, "left_semi").select(*now.columns)
            return now.join(new.select(key), key, "left_anti").select(*now.columns).unionByName(new)

        return self.rewrite(name, rows, change)

    def put(self, name: str, rows: DataFrame, placed: bool = False) -> DataFrame:
        """Replace rows by key, and append those whose keys the collection doesn't hold; ``placed`` is as in ``write``."""
        if not self.exists(name):
            return self.write(name, rows, placed=placed)
        key = self.manifest(name)["key"]
        return self.rewrite(name, rows, lambda now: now.join(rows.select(key), key, "left_anti").select(*now.columns).unionByName(rows.select(*now.columns)), placed)

    def delete(self, name: str, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """Without the rows of ``ids`` (by key) or those for which ``where`` holds."""
        key = self.manifest(name)["key"]
        if ids is not None:
            self.rewrite(name, ids, lambda now: now.join(ids.select(key), key, "left_anti"))
        if where is not None:
            hit = F.coalesce(where, F.lit(False))
            self.rewrite(name, self.read(name).where(hit), lambda now: now.where(~hit))
        return self.read(name)

    def truncate(self, *names: str) -> None:
        """Take all rows out of the collections, which stay."""
        for name in names:
            manifest = self.manifest(name)
            self._publish(name, manifest | {"number": manifest["number"] + 1, "files": {}})

    def drop(self, *names: str) -> None:
        """Remove the collections."""
        for name in names:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def rename(self, name: str, new: str) -> None:
        """Give the collection another name, which must be free."""
        if self.exists(new):
            raise ValueError(f"collection {new} exists")
        self._fs.rename(self._path(f"{self.root}/{name}"), self._path(f"{self.root}/{new}"))
