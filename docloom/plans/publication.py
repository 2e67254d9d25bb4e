"""Folders that readers see whole: versions, and small numbered manifests that point to them.

A version is written to a folder of its own, which no reader knows.  One small
file then names it, ``manifests/<number>.json``, created only if it is not
there; the highest whole manifest decides what is published.  A crash before
that leaves a folder without a manifest, which :func:`clean` removes.  All
goes through Hadoop's file systems, so any store that Spark writes to will do.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

DIGITS = 12
#: Published versions that stay, and seconds after which a folder without a manifest counts as left behind.
KEPT, ORPHANED_AFTER = 5, 86_400


class Store:
    """A folder of versions and manifests."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, name: str) -> str:
        return f"{self.root}/versions/{name}"

    def _listed(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change in seconds) of a folder's entries."""
        at = self._path(f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getModificationTime() // 1000) for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def manifests(self) -> dict[int, str]:
        """Version by number; a manifest that is not whole yet is none."""
        out = {}
        for name, _ in self._listed("manifests"):
            number = name.removesuffix(".json")
            if name.endswith(".json") and number.isdigit() and (version := self._read(int(number))):
                out[int(number)] = version
        return out

    def _manifest(self, number: int):
        return self._path(f"{self.root}/manifests/{number:0{DIGITS}d}.json")

    def _read(self, number: int) -> str | None:
        try:
            stream = self.fs.open(self._manifest(number))
        except Exception:  # removed since it was listed
            return None
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)["version"]
        except (ValueError, KeyError):
            return None

    def current(self) -> str | None:
        """The folder of the published version; None before the first."""
        known = self.manifests()
        return self.version(known[max(known)]) if known else None

    def put(self, version: str) -> int:
        """Point readers to a version that is whole; the manifest's number."""
        text = json.dumps({"version": version, "at": int(time.time())}).encode()
        while True:
            number = max([0, *(int(n.removesuffix(".json")) for n, _ in self._listed("manifests") if n.endswith(".json") and n.removesuffix(".json").isdigit())]) + 1
            try:
                out = self.fs.create(self._manifest(number), False)
            except Exception:
                if not self.fs.exists(self._manifest(number)):
                    raise
                continue  # another publisher took the number
            out.write(text)
            out.close()
            return number

    def publish(self, write: Callable[[str], None]) -> str:
        """Let ``write`` fill a new version's folder, then publish it; the folder."""
        name = uuid.uuid4().hex
        write(self.version(name))
        if not self.fs.exists(self._path(self.version(name))):
            raise RuntimeError(f"nothing was written to {self.version(name)}")
        self.put(name)
        return self.version(name)

    def clean(self, keep: int = KEPT, orphaned_after: float = ORPHANED_AFTER) -> list[str]:
        """Remove all but the last ``keep`` published versions, and folders that no manifest names; their names.

        Manifests go before their folders, so a reader never finds one that
        points nowhere.  A folder younger than ``orphaned_after`` may still be
        written to and stays.
        """
        known = self.manifests()
        for number in sorted(known)[: -keep or None]:
            self._delete(self._manifest(number))
        named, gone, now = set(self.manifests().values()), [], time.time()
        for name, changed in self._listed("versions"):
            published_once = name in known.values()
            if name not in named and (published_once or now - changed >= orphaned_after):
                self._delete(self._path(self.version(name)))
                gone.append(name)
        return gone

    def _delete(self, path) -> None:
        if not self.fs.delete(path, True) and self.fs.exists(path):
            raise RuntimeError(f"could not delete {path}")
