"""Versioned tables: snapshots, appended logs and keyed caches as Parquet under one folder.

A version is a folder that is written once; a small registry row makes it visible. Nothing is
changed in place, so readers never see half a table and a lost executor costs a retry.
"""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Tables under ``root``, which any Hadoop path may be."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{name}")
        return fs.exists(p)

    def delete(self, name: str) -> bool:
        fs, p = self._fs(f"{self.root}/{name}")
        return fs.delete(p, True)

    def write(self, df: DataFrame, name: str, mode: str = "errorifexists", *by: str) -> str:
        path = f"{self.root}/{name}"
        out = df.write.mode(mode)
        (out.partitionBy(*by) if by else out).parquet(path)
        return path

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """All columns, or those of ``columns`` that there are."""
        df = self.spark.read.parquet(f"{self.root}/{name}")
        return df.select(*[c for c in columns if c in df.columns]) if columns else df

    # --- snapshots ----------------------------------------------------------------------------------

    @staticmethod
    def snapshot_id(datasets: list[str], params: dict, version: str = "1") -> str:
        told = json.dumps([sorted(datasets), params, version], sort_keys=True)
        return hashlib.sha1(told.encode()).hexdigest()[:16]

    def create_snapshot(self, corpus: DataFrame, datasets: list[str], params: dict) -> str:
        """Write a corpus once; the same datasets and parameters give the snapshot that is there."""
        sid = self.snapshot_id(datasets, params)
        if not self.exists(f"snapshots/{sid}/data/_SUCCESS"):
            self.write(corpus, f"snapshots/{sid}/data", "overwrite")
            row = [(sid, sorted(datasets), json.dumps(params, sort_keys=True), datetime.now(UTC).isoformat())]
            entry = self.spark.createDataFrame(row, "snapshot_id string, datasets array<string>, params string, created string")
            self.write(entry.coalesce(1), f"snapshots/{sid}/entry", "overwrite")
        return sid

    def snapshots(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/snapshots/*/entry")

    def open_snapshot(self, sid: str, where: str | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
        df = self.read(f"snapshots/{sid}/data")
        df = df.where(where) if where else df
        df = df.select(*columns) if columns else df
        return df.limit(limit) if limit is not None else df

    def drop_snapshot(self, sid: str) -> bool:
        return self.delete(f"snapshots/{sid}")

    def purge_snapshots(self, keep: list[str]) -> list[str]:
        """Delete all snapshots but those of ``keep`` and the active one; returns what went."""
        stays = {*keep, self.active()}
        gone = sorted(r.snapshot_id for r in self.snapshots().select("snapshot_id").collect() if r.snapshot_id not in stays)
        for sid in gone:
            self.drop_snapshot(sid)
        return gone

    def active(self) -> str | None:
        return self.read("active").first()[0] if self.exists("active/_SUCCESS") else None

    def activate(self, sid: str) -> bool:
        """Make a snapshot the active one; False if it was. Slices frozen on another one are no longer valid."""
        if not self.exists(f"snapshots/{sid}/data/_SUCCESS"):
            raise ValueError(f"there is no snapshot {sid}")
        if self.active() == sid:
            return False
        self.write(self.spark.createDataFrame([(sid,)], "snapshot_id string").coalesce(1), "active", "overwrite")
        return True

    # --- frozen slices and checkpoints ----------------------------------------------------------------

    def freeze(self, name: str, rows: DataFrame, key: str = "_row_idx") -> None:
        """Save the row indices of a slice of the active snapshot."""
        self.write(rows.select(key, F.lit(self.active()).alias("snapshot_id")), f"slices/{name}", "overwrite")

    def frozen(self, name: str) -> DataFrame:
        """The rows of a frozen slice; an error if another snapshot is active now."""
        rows = self.read(f"slices/{name}")
        told = rows.select("snapshot_id").limit(1).collect()
        if told and told[0][0] != self.active():
            raise ValueError(f"the slice {name} was frozen on another snapshot")
        return rows.drop("snapshot_id")

    def split(self, prefix: str, chunks: DataFrame, k: int) -> list[str]:
        """Freeze the ``k`` chunks of rows (``_row_idx``, ``chunk``) as slices of their own."""
        names = [f"{prefix}_{i + 1}" for i in range(k)]
        for i, name in enumerate(names):
            self.freeze(name, chunks.where(F.col("chunk") == i))
        return names

    def checkpoint(self, codebook: str, tags: DataFrame, note: str = "", keep: int = 10) -> str:
        """Save a codebook's tags; the last ``keep`` checkpoints of each codebook stay."""
        cid = datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
        self.write(tags.withColumn("_note", F.lit(note)), f"checkpoints/{codebook}/{cid}", "overwrite")
        for old in self.checkpoints(codebook)[:-keep]:
            self.delete(f"checkpoints/{codebook}/{old}")
        return cid

    def checkpoints(self, codebook: str) -> list[str]:
        """Ids, the oldest first."""
        fs, p = self._fs(f"{self.root}/checkpoints/{codebook}")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def reverted(self, codebook: str, cid: str) -> DataFrame:
        """The tags of a checkpoint; batches after it are gone, so nothing can be undone or redone."""
        return self.read(f"checkpoints/{codebook}/{cid}").drop("_note")

    def sql(self, sid: str, query: str, **params: object) -> DataFrame:
        """SQL over a snapshot as the view ``corpus``; values go in as named parameters."""
        self.open_snapshot(sid).createOrReplaceTempView("corpus")
        return self.spark.sql(query, args=params or None)

    # --- appended logs ------------------------------------------------------------------------------

    def append(self, name: str, rows: DataFrame) -> None:
        self.write(rows, name, "append")

    def record(self, action: str, **params: object) -> None:
        """One provenance entry."""
        row = [(datetime.now(UTC).isoformat(), action, json.dumps(params, sort_keys=True, default=str))]
        self.append("provenance", self.spark.createDataFrame(row, "ts string, action string, params string").coalesce(1))

    def provenance(self) -> DataFrame:
        return self.read("provenance").orderBy("ts")


def answer_key(text: Column, codebook: str, version: str, prompt: str, categories: list[str]) -> Column:
    """The SHA-1 that a classifier's answer is cached under."""
    parts = [F.lit(x) for x in (codebook, version, prompt, ",".join(sorted(categories)))]
    return F.sha1(F.concat_ws("|", *parts, F.coalesce(text, F.lit(""))).cast("binary"))


def cached(rows: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of rows against a cache whose last answer of a key counts."""
    last = cache.groupBy(key).agg(F.max_by(F.struct(*[c for c in cache.columns if c != key]), "seq").alias("a")).select(key, "a.*")
    return rows.join(last, key), rows.join(last, key, "left_anti")
