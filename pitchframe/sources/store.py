"""Stored tables, parameters and models with a time limit.

A version is written to a folder of its own first and then entered in a list, in
one small append. Only listed versions are ever read, so a writer that dies
half-way leaves nothing behind that counts, and readers of an older version are
not disturbed. Two writers at once store two versions, of which the newer one is
used from then on.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchframe.operators.boosting import Boosted, Setting

ENTRY = "name string, key string, created date, number long, path string"


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame:
        """The list of versions; empty before the first one."""
        try:
            return self.spark.read.schema(ENTRY).json(f"{self.folder}/entries")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], ENTRY)

    def latest(self, name: str, key: str, today: datetime.date, days: int) -> str | None:
        """Folder of the newest version that is at most ``days`` old, if any."""
        own = self.entries().where((F.col("name") == name) & (F.col("key") == key) & (F.col("created") <= F.lit(today)))
        newest = own.orderBy(F.desc("created"), F.desc("number"), F.desc("path")).limit(1).collect()
        return newest[0]["path"] if newest and (today - newest[0]["created"]).days <= days else None

    def put(self, name: str, key: str, today: datetime.date, write: Callable[[str], None]) -> str:
        path = f"{self.folder}/versions/{name}-{uuid.uuid4().hex}"
        write(path)
        number = self.entries().where((F.col("name") == name) & (F.col("key") == key)).count()
        entry = self.spark.createDataFrame([(name, key, today, number, path)], ENTRY)
        entry.coalesce(1).write.mode("append").json(f"{self.folder}/entries")
        return path

    def _kept(self, name, key, today, days, write) -> str:
        return self.latest(name, key, today, days) or self.put(name, key, today, write)

    def table(self, name: str, key: str, today: datetime.date, days: int, build: Callable[[], DataFrame]) -> DataFrame:
        """The stored table, or ``build()`` written and read back."""
        return self.spark.read.parquet(self._kept(name, key, today, days, lambda path: build().write.parquet(path)))

    def pipeline(self, name: str, key: str, today: datetime.date, days: int, fit: Callable[[], PipelineModel]) -> PipelineModel:
        return PipelineModel.load(self._kept(name, key, today, days, lambda path: fit().write().save(path)))

    def document(self, name: str, key: str, today: datetime.date, days: int, make: Callable[[], Mapping]) -> dict:
        """A small JSON document, such as the parameters of a model."""
        frame = lambda: self.spark.createDataFrame([(json.dumps(make()),)], "document string").coalesce(1)
        return json.loads(self.table(name, key, today, days, frame).first()["document"])

    def setting(self, name: str, key: str, today: datetime.date, days: int, search: Callable[[], Setting]) -> Setting:
        return Setting(**self.document(name, key, today, days, lambda: vars(search())))

    def boosted(self, name: str, key: str, today: datetime.date, days: int, fit: Callable[[], Boosted]) -> Boosted:
        return Boosted.from_document(self.document(name, key, today, days, lambda: fit().document()))
