"""Tables in partitions that are staged by build and published together in one step.

Files lie under data/<build>/<table>/_part=<n>; a manifest lists the folder of every table's partition. A build writes only
the partitions that it changes, into its own folder, which nothing reads until a new manifest is put in place by one
rename; that names the new folders and, for all other partitions, the old ones, whose files are never touched. A build that
is lost half way leaves the published tables whole, and two builds that started from one manifest can't both be published.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: table -> partition -> folder
Manifest = dict[str, dict[int, str]]


def part_of(key: Column, n_parts: int) -> Column:
    """Partition number of a key, the same in every build."""
    return F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")


class Builds:
    """Published tables under a path of any store that Spark can reach, and the builds that are staged beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *under: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path("/".join([self.path, *under]))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, *under: str) -> list[str]:
        fs, at = self._fs(*under)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def version(self) -> int:
        """Number of the published manifest; 0 before the first."""
        return max((int(n[1:9]) for n in self._names("manifests") if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        v = self.version() if version is None else version
        if not v:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/v{v:08d}.json", wholetext=True).first()[0]
        return {t: {int(p): f for p, f in parts.items()} for t, parts in json.loads(text)["tables"].items()}

    def read(self, table: str, manifest: Manifest | None = None, parts: list[int] | None = None) -> DataFrame | None:
        """A published table (or one of another manifest), all of it or some partitions; None if there is nothing."""
        held = (self.manifest() if manifest is None else manifest).get(table, {})
        folders = [f for p, f in sorted(held.items()) if parts is None or p in parts]
        return self.spark.read.parquet(*folders) if folders else None

    def start(self) -> str:
        """A build's name; it holds the version that the build starts from."""
        return f"b{self.version():08d}-{uuid.uuid4().hex[:8]}"

    def stage(self, build: str, table: str, df: DataFrame, part: Column) -> list[int]:
        """Write df into the build, a folder for each partition number; returns the partitions that have rows."""
        df.withColumn("_part", part).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/data/{build}/{table}")
        return self.staged(build, table)

    def staged(self, build: str, table: str) -> list[int]:
        return sorted(int(n.removeprefix("_part=")) for n in self._names("data", build, table) if n.startswith("_part="))

    def overlay(self, build: str, replaced: dict[str, list[int] | None]) -> Manifest:
        """The manifest that publishing the build would give. replaced: partitions that the build rewrites (None: all).

        A rewritten partition without staged rows is empty from then on.
        """
        out = {t: dict(parts) for t, parts in self.manifest(int(build[1:9])).items()}
        for table, parts in replaced.items():
            mine = self.staged(build, table)
            kept = {} if parts is None else {p: f for p, f in out.get(table, {}).items() if p not in parts}
            if parts is not None and set(mine) - set(parts):
                raise ValueError(f"build {build} staged partitions of {table} that it doesn't replace")
            out[table] = kept | {p: f"{self.path}/data/{build}/{table}/_part={p}" for p in mine}
        return out

    def publish(self, build: str, replaced: dict[str, list[int] | None], note: dict | None = None) -> int:
        """Put the build's partitions of all tables in place at once; returns the new version.

        Fails if another build was published since this one started.
        """
        v = int(build[1:9]) + 1
        body = json.dumps({"build": build, "note": note or {}, "tables": self.overlay(build, replaced)})
        fs, temporary = self._fs("manifests", f".{build}.json")
        _, final = self._fs("manifests", f"v{v:08d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(body.encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise RuntimeError(f"version {v} was published by another build")
        return v

    def vacuum(self) -> list[str]:
        """Delete builds that the published manifest doesn't name; returns their names. No build may be under way."""
        named = {f.split("/data/")[1].split("/")[0] for parts in self.manifest().values() for f in parts.values()}
        gone = [b for b in self._names("data") if b not in named]
        for b in gone:
            fs, at = self._fs("data", b)
            fs.delete(at, True)
        return gone
