"""A log of analysis jobs as an append-only Parquet table; the latest row of a job is its state."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "id string, status string, created_at timestamp, updated_at timestamp, config string, files string, error string, result string, duration_ms bigint, deleted boolean, version bigint"
#: From which states a job may go to a state.
ALLOWED = {"running": {"pending", "failed"}, "completed": {"running"}, "failed": {"running"}}


class Jobs:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, row: dict) -> None:
        self.spark.createDataFrame([Row(**{k.split()[0]: row.get(k.split()[0]) for k in SCHEMA.split(", ")})], SCHEMA).write.mode("append").parquet(self.path)

    def _latest(self) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
        return rows.withColumn("_n", newest).where("_n = 1 and not deleted").drop("_n", "deleted")

    def create(self, config: dict, files: list[dict]) -> str:
        now, name = datetime.now(timezone.utc), str(uuid.uuid4())
        self._write({"id": name, "status": "pending", "created_at": now, "updated_at": now, "config": json.dumps(config), "files": json.dumps(files), "deleted": False, "version": 0})
        return name

    def get(self, name: str) -> Row:
        found = self._latest().where(F.col("id") == name).first()
        if found is None:
            raise KeyError(name)
        return found

    def update(self, name: str, **changes) -> None:
        """A change of state that isn't allowed is an error."""
        now = self.get(name)
        to = changes.get("status")
        if to is not None and now.status not in ALLOWED.get(to, set()):
            raise ValueError(f"a {now.status} job can't become {to}")
        self._write(now.asDict() | {"deleted": False} | changes | {"updated_at": datetime.now(timezone.utc), "version": now.version + 1})

    def delete(self, name: str) -> None:
        now = self.get(name)
        self._write(now.asDict() | {"deleted": True, "version": now.version + 1})

    def list(self, limit: int = 50) -> DataFrame:
        """The newest first; 200 at most."""
        return self._latest().orderBy(F.desc("created_at")).limit(min(limit, 200))
