"""A stored rollup whose ranges are rebuilt by operations that happen once and whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataward.functions.shared_files import CommitLog, Files

TIME = "period_start"


class OperationConflict(ValueError):
    """An operation id that stands for another request, or a commit that another writer made first."""


@dataclass(frozen=True)
class RangeStore:
    """Rollup rows by day below ``root``, and a log of commits that name the live folder of each day.

    An operation writes new folders for the days that it touches and then its commit; until that is there,
    readers see the table as it was, and what a failed attempt has written is never read. The commit carries the
    operation's id and its counts: an operation that is repeated returns them and changes nothing. The log has
    an entry a day and commit, whatever the number of rows.
    """

    spark: SparkSession
    root: str

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.root}/log")

    def _marker(self, operation_id: str) -> str:
        return f"{self.root}/operations/{hashlib.sha256(operation_id.encode()).hexdigest()}"

    def done(self, operation_id: str) -> dict | None:
        """The commit of an operation, None if it has not come to an end."""
        files, marker = Files(self.spark), self._marker(operation_id)
        # Each attempt notes the number that it is going to commit under; only the last note can have led to one.
        for name in reversed(files.names(marker)):
            commit = self.log.get(int(name))
            if commit and commit["operation"] == operation_id:
                return commit
        return None

    def _days(self) -> dict[str, str]:
        last = self.log.latest()
        return last[1]["days"] if last else {}

    def _read(self, days: dict[str, str]) -> DataFrame | None:
        paths = [f"{self.root}/data/{folder}/period_date={day}" for day, folder in sorted(days.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """All rows as of the newest commit, None while there are none."""
        return self._read(self._days())

    def store(self, rows: DataFrame, operation_id: str) -> dict:
        """Put whole days in place: every day that ``rows`` holds."""
        return self._apply(rows, operation_id, {"kind": "store"}, None)

    def replace(self, rows: DataFrame, operation_id: str, key: dict[str, str], start: str, end: str) -> dict:
        """Put ``rows`` in place of all rows with the values of ``key`` in ``[start, end)``, and leave all else.

        Hours without a new row end empty. Days outside the range are neither read nor written.
        """
        at = lambda x: F.lit(x).cast("timestamp_ntz")
        hit = (F.col(TIME) >= at(start)) & (F.col(TIME) < at(end))
        for column, value in key.items():
            hit = hit & F.col(column).eqNullSafe(F.lit(value))
        return self._apply(rows, operation_id, {"kind": "replace", "key": key, "start": start, "end": end}, hit)

    def _apply(self, rows: DataFrame, operation_id: str, request: dict, hit: Column | None) -> dict:
        if (commit := self.done(operation_id)) is not None:
            if commit["request"] != request:
                raise OperationConflict(f"operation {operation_id} was another request")
            return commit
        last = self.log.latest()
        number, days = (last[0] + 1, dict(last[1]["days"])) if last else (0, {})
        Files(self.spark).create(f"{self._marker(operation_id)}/{number:012d}", json.dumps(request, sort_keys=True))
        folder = f"{number:012d}-{uuid.uuid4().hex}"
        fresh = rows if hit is None else rows.where(hit)
        deleted = 0
        if hit is None:
            touched = {str(r[0]) for r in rows.select(F.to_date(TIME)).distinct().collect()}
            whole = fresh
            if (old := self._read({d: f for d, f in days.items() if d in touched})) is not None:
                deleted = old.count()
        else:
            touched = {d for d in days if request["start"][:10] <= d <= request["end"][:10]}
            old = self._read({d: days[d] for d in touched})
            whole = fresh
            if old is not None:
                deleted = old.where(hit).count()
                whole = fresh.select(*old.columns).unionByName(old.where(~F.coalesce(hit, F.lit(False))))
        path = f"{self.root}/data/{folder}"
        whole.withColumn("period_date", F.to_date(TIME)).write.partitionBy("period_date").parquet(path)
        written = {n.split("=", 1)[1] for n in Files(self.spark).names(path) if n.startswith("period_date=")}
        days = {d: f for d, f in days.items() if d not in touched} | dict.fromkeys(written, folder)
        kept = self._read(dict.fromkeys(written, folder))
        inserted = 0 if kept is None else (kept if hit is None else kept.where(hit)).count()
        commit = {"operation": operation_id, "request": request, "days": days, "deleted": deleted, "inserted": inserted, "number": number}
        if not self.log.append(number, commit):
            raise OperationConflict(f"another writer made commit {number}")
        return commit
