"""Published tables that readers always see whole.

``root``/data holds a folder for each write of each table; nothing there is ever overwritten.
``root``/versions holds one small file for each commit, which lists the folders that make up each
table.  A commit writes its folders, counts what can be read back, and renames its file into place
as the last step: whoever reads before sees all tables as they were, whoever reads after sees all of
them as they are, and a commit that dies on the way leaves nothing but folders that no version
names.  Two writers cannot both make the same version: the rename does not replace a file, so the
second raises and starts again from the tables it then finds.

Snapshots are replaced, logs are added to.  Folders may be partitioned by columns, so that readers
that filter on them open few files.  The folder has to be one that all executors share, in a store
whose rename is atomic.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

BATCH = "_batch"


class Snapshots:
    """The tables under ``root``, as of the newest version or of ``version``."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self.versions()
        self.version = (found[-1] if found else 0) if version is None else version
        self.tables: dict[str, dict] = self._manifest(self.version) if self.version else {}

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _file(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}.json"

    def _manifest(self, version: int) -> dict[str, dict]:
        return json.loads(self.spark.read.text(self._file(version), wholetext=True).first()[0])

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, name: str, schema: str | StructType | None = None) -> DataFrame:
        """A table; an empty one of ``schema`` if it was never written."""
        if name not in self.tables:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        entry = self.tables[name]
        kind = StructType.fromJson(entry["schema"])
        base = f"{self.root}/data/{name}"
        if not entry["folders"]:
            return self.spark.createDataFrame([], kind)
        stored = StructType(list(kind.fields)).add(BATCH, StringType())
        paths = [f"{base}/{BATCH}={folder}" for folder in entry["folders"]]
        return self.spark.read.option("basePath", base).schema(stored).parquet(*paths).select(*kind.names)

    def _write(self, name: str, df: DataFrame, by: list[str]) -> tuple[str, int]:
        """Folder and rows of one write; no folder is left if there are none."""
        folder = f"{self.version + 1:010d}-{uuid.uuid4().hex}"
        path = f"{self.root}/data/{name}/{BATCH}={folder}"
        seen = Observation(f"written {name}")
        rows = df.observe(seen, F.count(F.lit(1)).alias("n"))
        writer = rows.repartition(*by).write.partitionBy(*by) if by else rows.write
        writer.parquet(path)
        try:
            expected = seen.get["n"]
        except Py4JJavaError:  # found to be empty on the way, so that nothing was left to observe
            expected = 0
        got = self.spark.read.schema(df.schema).option("basePath", path).parquet(path).count()
        if expected != got:
            raise ValueError(f"{name}: {got} rows can be read of {expected} written")
        if got == 0:
            self._fs.delete(self._path(path), True)
            return "", 0
        return folder, got

    def commit(self, replaced: dict[str, DataFrame], added: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None) -> DataFrame:
        """Make the next version: ``replaced`` tables hold the given rows alone, ``added`` ones these
        besides what they had, all others stay.  Returns table, n_rows (of this commit) and total."""
        partitions = partitions or {}
        tables, counts = dict(self.tables), []
        for name, df in {**replaced, **added}.items():
            before = self.tables.get(name)
            kind = before["schema"] if before and name in added else json.loads(df.schema.json())
            rows = df.select(*[f["name"] for f in kind["fields"]])
            if before and name in added and [f["type"] for f in json.loads(rows.schema.json())["fields"]] != [f["type"] for f in kind["fields"]]:
                raise ValueError(f"{name}: the rows to add differ in type from the table")
            folder, n = self._write(name, rows, partitions.get(name, []))
            kept = (before or {"folders": [], "rows": 0}) if name in added else {"folders": [], "rows": 0}
            tables[name] = {"folders": kept["folders"] + ([folder] if folder else []), "rows": kept["rows"] + n, "schema": kind}
            counts.append((name, n, tables[name]["rows"]))
        self._publish(tables)
        return self.spark.createDataFrame(counts, "table string, n_rows long, total long")

    def _publish(self, tables: dict[str, dict]) -> None:
        """The last step: the version's file appears, or another writer's stands there already."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        draft, final = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}.tmp"), self._path(self._file(self.version + 1))
        out = self._fs.create(draft, False)
        out.write(json.dumps(tables).encode())
        out.close()
        plain = self._jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = plain
        context.rename(draft, final, options)
        self.version, self.tables = self.version + 1, tables

    def expire(self, keep: int = 10) -> list[str]:
        """Delete all but the newest ``keep`` versions and every folder that none of these names,
        what failed commits left included.  Not to be run beside a commit.  Returns the folders."""
        found = self.versions()
        kept = found[-keep:]
        named = {(t, f"{BATCH}={f}") for v in kept for t, entry in self._manifest(v).items() for f in entry["folders"]}
        for version in found[: len(found) - len(kept)]:
            self._fs.delete(self._path(self._file(version)), False)
        gone = []
        data = self._path(f"{self.root}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                name = table.getPath().getName(), folder.getPath().getName()
                if name not in named:
                    self._fs.delete(folder.getPath(), True)
                    gone.append("/".join(name))
        return gone
