"""Dumps kept in a version history: a Spark data source that reads one committed dump per task."""

from __future__ import annotations

import json
import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from worldloom.sources import textdump


def _git(path: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", path, *args], check=True, capture_output=True).stdout


def chain(path: str, ref: str = "HEAD") -> list[dict]:
    """Commits of the first-parent chain, oldest first: hash, committer seconds."""
    rows = _git(path, "log", "--first-parent", "--reverse", "--format=%H %ct", ref).decode().split("\n")
    return [{"commit": h, "at": int(t)} for h, t in (r.split() for r in rows if r)]


def resolve_date(path: str, seconds: int, ref: str = "HEAD") -> str | None:
    """The newest commit of the chain at or before a time; clocks may run backwards, so the chain's order decides."""
    found = [c["commit"] for c in chain(path, ref) if c["at"] <= seconds]
    return found[-1] if found else None


def blob(path: str, commit: str, name: str) -> bytes:
    """A committed dump: a file, or a folder of pieces with its manifest."""
    if _git(path, "cat-file", "-t", f"{commit}:{name}").strip() == b"blob":
        return _git(path, "cat-file", "blob", f"{commit}:{name}")
    listed = _git(path, "cat-file", "blob", f"{commit}:{name}/MANIFEST").decode().splitlines()
    return b"".join(_git(path, "cat-file", "blob", f"{commit}:{os.path.normpath(os.path.join(name, row.split(chr(9))[0]))}") for row in listed)


class _Commit(InputPartition):
    def __init__(self, commit: str, at: int) -> None:
        super().__init__(commit)
        self.commit, self.at = commit, at


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.name, self.ref = options["path"], options["dump"], options.get("ref", "HEAD")

    def partitions(self) -> list[_Commit]:
        return [_Commit(c["commit"], c["at"]) for c in chain(self.repo, self.ref)]

    def read(self, partition: _Commit):
        for section, ord_, payload in textdump.rows(textdump.parse(blob(self.repo, partition.commit, self.name))):
            yield partition.commit, partition.at, section, ord_, json.dumps(payload, ensure_ascii=False)


class CommittedDumps(DataSource):
    """``spark.read.format("committeddumps").option("dump", NAME).load(REPOSITORY)``: one task per commit."""

    @classmethod
    def name(cls) -> str:
        return "committeddumps"

    def schema(self) -> str:
        return "commit string, at bigint, section string, ord bigint, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def load(spark: SparkSession, repository: str, dump: str, ref: str = "HEAD") -> dict[str, DataFrame]:
    """The tables of all committed dumps, each with ``commit`` and ``at``."""
    spark.dataSource.register(CommittedDumps)
    raw = spark.read.format("committeddumps").option("dump", dump).option("ref", ref).load(repository)
    return {t: raw.filter(F.col("section") == t).select("commit", "at", F.from_json("payload", schema).alias("r")).select("commit", "at", "r.*") for t, schema in textdump.TABLES.items()}
