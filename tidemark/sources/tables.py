"""Versioned Parquet store: folders of rows, and numbered commits that list them.

A write makes new folders and then one commit file that names the folders of every
table. The commit appears under its number at once or not at all, so readers see
all tables as they were before or after it, and a crash leaves the last commit. Of
two writers that started from one commit the second fails. An append adds a folder
and rewrites nothing. Old folders and commits stay until :func:`Store.vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import KEYS, TABLES


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the last commit, and the folders of each table."""
        folder, fs = self._path(f"{self.root}/_commits")
        if not fs.exists(folder):
            return 0, {}
        numbers = [n for status in fs.listStatus(folder) if (n := status.getPath().getName()).isdigit()]
        if not numbers:
            return 0, {}
        p, _ = self._path(f"{self.root}/_commits/{max(numbers)}")
        source = fs.open(p)
        try:
            return int(max(numbers)), json.loads(source.readUTF())
        finally:
            source.close()

    def read(self, name: str) -> DataFrame:
        folders = self._latest()[1].get(name)
        schema = TABLES[name]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _rows(self, name: str, rows: DataFrame) -> str:
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]])
        folder = uuid.uuid4().hex
        shaped.write.parquet(f"{self.root}/{name}/{folder}")
        return folder

    def commit(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> None:
        """Replace some tables and append to others, all at once.

        Columns beyond the schemas are dropped, types are cast. The rows may come
        from the tables that they replace.
        """
        number, tables = self._latest()
        made = {name: [self._rows(name, rows)] for name, rows in (replace or {}).items()}
        made |= {name: [*tables.get(name, []), self._rows(name, rows)] for name, rows in (append or {}).items()}
        fresh, fs = self._path(f"{self.root}/_commits/.next-{uuid.uuid4().hex}")
        out = fs.create(fresh)
        out.writeUTF(json.dumps(tables | made))
        out.close()
        place, _ = self._path(f"{self.root}/_commits/{number + 1:020d}")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fresh, place, no_overwrite)  # fails if another writer has taken the number

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace one table."""
        self.commit({name: rows})

    def compact(self, name: str) -> None:
        """Bring the folders of many appends into one."""
        self.commit({name: self.read(name)})

    def vacuum(self, name: str) -> None:
        """Delete the folders that the last commit doesn't list."""
        keep = self._latest()[1].get(name, [])
        folder, fs = self._path(f"{self.root}/{name}")
        for status in fs.listStatus(folder):
            if status.isDirectory() and status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

    def duplicate_keys(self, name: str) -> DataFrame:
        """Keys that more than one row has; any row is a fault."""
        return self.read(name).groupBy(*KEYS[name]).agg(F.count("*").alias("rows")).filter("rows > 1")
