"""Tables of published versions: a write that fails leaves the last version as it was.

Every write goes to new folders under ``data``; nothing that a version names is ever changed. When all tasks are done, a
small file ``versions/<number>`` that lists the folders of the new version is created; creating it is the
publication. A reader takes the highest number. Two writers that started from one version both try to create the same
file, and the second one fails. A run stopped half-way leaves folders that no version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "__part"


class PublishedTable:
    """A table under ``path``; where ``partition`` is given, folders hold one value of that column each."""

    def __init__(self, spark: SparkSession, path: str, partition: str | None = None):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), partition
        self._jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def version(self) -> int:
        """The last published version; 0 where there is none."""
        folder = self._at("versions")
        if not self._fs.exists(folder):
            return 0
        return max([0, *(int(n) for f in self._fs.listStatus(folder) if (n := f.getPath().getName()).isdigit())])

    def _folders(self, version: int) -> dict[str, list[str]]:
        """Folders by text of the partition value ("" without partitions)."""
        if not version:
            return {}
        stream = self._fs.open(self._at(f"versions/{version:08d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, version: int, folders: dict[str, list[str]]) -> None:
        """Create the list of ``version``; an error where another writer has done so."""
        hidden, target = self._at(f"versions/.{uuid.uuid4().hex}"), self._at(f"versions/{version:08d}")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(folders).encode()))
        finally:
            stream.close()
        # A rename shows the list whole or not at all, and does not replace one that is there.
        if self._fs.exists(target) or not self._fs.rename(hidden, target):
            raise RuntimeError(f"version {version} of {self.path} has been published by another writer")

    def read(self, version: int | None = None) -> DataFrame:
        """A version, the last one by default; columns that a folder lacks are null."""
        folders = self._folders(self.version() if version is None else version)
        paths = [f"{self.path}/data/{f}" for some in folders.values() for f in some]
        if not paths:
            raise FileNotFoundError(f"{self.path} has no published rows")
        return self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*paths)

    def _write(self, df: DataFrame) -> dict[str, list[str]]:
        name = uuid.uuid4().hex
        if self.partition is None:
            df.write.parquet(f"{self.path}/data/{name}")
            return {"": [name]}
        # The value stays in the files; the name of a folder only tells partitions apart.
        text = F.coalesce(F.md5(F.col(f"`{self.partition}`").cast("string")), F.lit("null"))
        df.withColumn(PART, text).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/data/{name}")
        made = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"data/{name}")) if f.isDirectory()]
        return {n.partition("=")[2]: [f"{name}/{n}"] for n in made if n.startswith(PART + "=")}

    def replace(self, df: DataFrame) -> int:
        """New rows in a new schema."""
        version = self.version() + 1
        self._publish(version, self._write(df))
        return version

    def truncate(self, df: DataFrame) -> int:
        """New rows in the old columns and types; further columns are added as text."""
        version = self.version()
        if version and self._folders(version):
            old = self.read(version).schema
            known = {f.name: f.dataType for f in old.fields}
            columns = [F.col(f"`{n}`").cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in known.items()]
            df = df.select(*columns, *[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns if c not in known])
        self._publish(version + 1, self._write(df))
        return version + 1

    def append(self, df: DataFrame) -> int:
        """Further rows beside those there are."""
        version = self.version()
        folders = self._folders(version)
        for part, some in self._write(df).items():
            folders[part] = [*folders.get(part, []), *some]
        self._publish(version + 1, folders)
        return version + 1

    def merge(self, df: DataFrame, keys: Sequence[str]) -> int:
        """Delete the rows whose keys ``df`` has and insert ``df``: rows that repeat a key all come in, null keys are equal.

        Copy on write: only partitions that ``df`` touches are read and written anew; the others are named by the new
        version as they are. The same load twice gives the same table.
        """
        version = self.version()
        folders = self._folders(version)
        fresh = self._write(df)
        touched = {p: folders[p] for p in fresh if p in folders} if self.partition else folders
        if touched and fresh:
            paths = [f"{self.path}/data/{f}" for some in touched.values() for f in some]
            read = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
            old, new = read.parquet(*paths), read.parquet(*[f"{self.path}/data/{f}" for some in fresh.values() for f in some])
            gone = new.select(*[F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}"))
            kept = self._write(old.join(gone, same, "left_anti"))
            fresh = {p: [*kept.get(p, []), *fresh.get(p, [])] for p in {*kept, *fresh}}
        rest = {p: some for p, some in folders.items() if p not in touched or not fresh}
        self._publish(version + 1, rest | fresh)
        return version + 1
