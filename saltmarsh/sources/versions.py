"""Tables in versions: immutable files, a manifest for each version, and commits that change several tables at once."""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.operators.pit import first_by

#: Folders that a table is dealt to by a hash; a commit writes those anew that it touches.
BUCKETS = 16

_MANIFEST = "commit string, note string, schemas map<string,string>, files array<struct<table_name:string,bucket_no:int,path:string>>"


class Conflict(Exception):
    """Another commit made the same version."""


@dataclass
class Change:
    """What a commit does to one table: the rows that take the place of all rows with their keys, and keys whose rows just go.

    ``latest``: of the rows with equal keys, old and new, the one with the greatest value of this column stays instead.
    """

    rows: DataFrame
    keys: list[str]
    gone: DataFrame | None = None
    latest: str | None = None


class VersionedStore:
    """Tables under one folder. ``tables`` names for each the columns whose hash deals its rows to buckets.

    A version is a manifest: for each table and bucket a folder of Parquet files that is never written again. A commit
    writes the buckets that it touches to new folders, for all its tables, and then one manifest file, which Spark's
    committer moves into place as a whole. A run that dies before that leaves files that no version names, and the version
    before stays as it was. Old versions stay readable. One writer at a time is meant; one that comes second to the
    same version is refused.
    """

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, list[str]], buckets: int = BUCKETS):
        self.spark, self.root, self.tables, self.buckets = spark, root, tables, buckets

    def manifests(self) -> DataFrame:
        schema = T.StructType([*T.StructType.fromDDL(_MANIFEST).fields, T.StructField("version", T.LongType())])
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/manifests")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self) -> list[int]:
        return sorted(r["version"] for r in self.manifests().select("version").distinct().collect())

    def current(self) -> int:
        """The newest version; 0 before the first commit."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def _state(self, version: int) -> tuple[dict[str, str], dict[str, dict[int, str]]]:
        """Schemas, and the folders of each table by bucket, of a version."""
        found = self.manifests().where(F.col("version") == version).orderBy("commit").limit(1).collect() if version else []
        if version and not found:
            raise ValueError(f"no version {version} under {self.root}")
        schemas, folders = (dict(found[0]["schemas"]) if found else {}), {t: {} for t in self.tables}
        for f in found[0]["files"] if found else []:
            folders.setdefault(f["table_name"], {})[f["bucket_no"]] = f["path"]
        return schemas, folders

    def _rows(self, schemas: dict[str, str], paths: list[str], table: str) -> DataFrame | None:
        if table not in schemas:
            return None
        schema = T.StructType.fromJson(json.loads(schemas[table]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest unless given)."""
        schemas, folders = self._state(self.current() if version is None else version)
        rows = self._rows(schemas, sorted(folders.get(table, {}).values()), table)
        if rows is None:
            raise ValueError(f"no table {table!r} in this version of {self.root}")
        return rows

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[table]), F.lit(self.buckets)).cast("int")

    def stage(self, base: int, changes: dict[str, Change], commit: str) -> tuple[dict[str, str], list[tuple[str, int, str]]]:
        """Write what a commit changes, and say which schemas and files its version has. Nothing refers to them yet."""
        schemas, folders = self._state(base)
        for table, change in changes.items():
            keys = change.rows.select(*change.keys)
            keys = (keys if change.gone is None else keys.unionByName(change.gone.select(*change.keys))).distinct()
            touched = sorted(r[0] for r in keys.select(self._bucket(table)).distinct().collect())  # no more than there are buckets
            old = self._rows(schemas, [folders[table][b] for b in touched if b in folders[table]], table)
            if old is None:
                rows = change.rows
            elif change.latest:
                rows = old.unionByName(change.rows, allowMissingColumns=True)
            else:
                rows = old.join(keys, change.keys, "left_anti").unionByName(change.rows, allowMissingColumns=True)
            if change.latest:
                rows = first_by(rows, change.keys, [F.desc(change.latest)])
            path = f"{self.root}/data/{table}/{commit}"
            rows.withColumn("bucket_no", self._bucket(table)).repartition("bucket_no", F.pmod(F.xxhash64(*change.keys), F.lit(8))).write.partitionBy("bucket_no").parquet(path)
            schemas[table] = rows.schema.json()
            stored = T.StructType([T.StructField("bucket_no", T.IntegerType())])
            written = {r["bucket_no"] for r in self.spark.read.schema(stored).parquet(path).distinct().collect()}
            folders[table] = {b: p for b, p in folders[table].items() if b not in touched} | {b: f"{path}/bucket_no={b}" for b in written}
        return schemas, [(t, b, p) for t, held in folders.items() for b, p in held.items()]

    def publish(self, version: int, commit: str, note: str | None, schemas: dict[str, str], files: list[tuple[str, int, str]]) -> None:
        """Make a version visible: its manifest appears as a whole or not at all."""
        try:
            self.spark.createDataFrame([(commit, note, schemas, files)], _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifests/version={version}")
        except AnalysisException as error:
            raise Conflict(f"version {version} of {self.root} is there already") from error
        first = self.manifests().where(F.col("version") == version).agg(F.min("commit")).first()[0]
        if first != commit:
            raise Conflict(f"version {version} of {self.root} is of commit {first}")

    def commit(self, changes: dict[str, Change], note: str | None = None) -> int:
        """Change tables in one version and return its number. A commit whose ``note`` an earlier one has does nothing again."""
        if note is not None:
            done = self.manifests().where(F.col("note") == note).agg(F.min("version")).first()[0]
            if done is not None:
                return done
        base, commit = self.current(), uuid4().hex
        self.publish(base + 1, commit, note, *self.stage(base, changes, commit))
        return base + 1


#: The tables of logged sessions; all rows of a session are in one bucket.
SESSION_TABLES = {"sessions": ["session_id"], "flags": ["session_id"], "tearsheets": ["session_id"], "headlines": ["session_id"]}


def session_store(spark: SparkSession, root: str) -> VersionedStore:
    return VersionedStore(spark, root, SESSION_TABLES)


def replace_sessions(store: VersionedStore, sessions: DataFrame, flags: DataFrame, tearsheets: DataFrame, headlines: DataFrame) -> int:
    """Put the sessions (one row each), with their flags and those flags' children, in the place of what the store has of them."""
    keys = ["session_id"]
    return store.commit({t: Change(rows, keys, sessions.select(*keys)) for t, rows in (("sessions", sessions), ("flags", flags), ("tearsheets", tearsheets), ("headlines", headlines))})


def replace_children(store: VersionedStore, tearsheets: DataFrame, headlines: DataFrame) -> int:
    """Give the flags of ``tearsheets`` (session_id, canonical_id, ...) these and no other tearsheets and headlines."""
    keys = ["session_id", "canonical_id"]
    return store.commit({"tearsheets": Change(tearsheets, keys), "headlines": Change(headlines, keys, tearsheets.select(*keys))})


def delete_sessions(store: VersionedStore, gone: DataFrame) -> int:
    """Remove all that the store has of the sessions in ``gone``."""
    keys = ["session_id"]
    return store.commit({t: Change(store.read(t).limit(0), keys, gone.select(*keys).distinct()) for t in SESSION_TABLES})
