"""Tables cut in buckets by page, changed by copy on write, under one manifest that is committed by compare-and-swap.

A manifest names the folder of every bucket of every table. A change writes new folders of the buckets it touches and then a manifest
of the next number, which only one writer can create; so what several tables change becomes visible together or not at all. A
writer who finds another's manifest goes on if that one left its buckets alone, else it has lost and must read again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folders

BUCKETS = 64
_IN = "in_bucket"


class LostCommit(RuntimeError):
    """Another writer has changed the same buckets meanwhile."""


@dataclass(frozen=True)
class Manifest:
    version: int
    buckets: int
    #: Folder of each bucket that has rows, by table.
    tables: dict[str, dict[int, str]] = field(default_factory=dict)
    #: What is known of each bucket beside its rows, by table; a few values each.
    facts: dict[str, dict[int, list]] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)

    def with_changes(self, changes: dict, facts: dict, meta: dict[str, str]) -> Manifest:
        def changed(old: dict, new: dict) -> dict:
            return {k: {b: v for b, v in (old.get(k, {}) | new.get(k, {})).items() if v is not None} for k in old | new}

        return Manifest(self.version + 1, self.buckets, changed(self.tables, changes), changed(self.facts, facts), self.meta | meta)


class BucketedTables:
    """Tables of rows with a page_key below `root`; `schemas` names their columns. The number of buckets is that of the first commit."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.schemas, self.buckets, self.folders = spark, root.rstrip("/"), schemas, buckets, Folders(spark)

    def _versions(self) -> list[str]:
        return sorted(n for n in self.folders.names(f"{self.root}/manifests") if n.endswith(".json") and n[0].isdigit())

    def head(self) -> Manifest:
        found = self._versions()
        if not found:
            return Manifest(0, self.buckets)
        read = json.loads(self.folders.text(f"{self.root}/manifests/{found[-1]}"))
        for part in ("tables", "facts"):
            read[part] = {t: {int(b): v for b, v in x.items()} for t, x in read[part].items()}
        return Manifest(**read)

    def bucket(self, base: Manifest, key: str | Column = "page_key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(base.buckets)).cast("int")

    def touched(self, base: Manifest, rows: DataFrame, key: str = "page_key") -> set[int]:
        """The buckets of the rows; no more numbers than there are buckets."""
        return {r[0] for r in rows.select(self.bucket(base, key)).distinct().collect()}

    def read(self, name: str, base: Manifest | None = None, only: Iterable[int] | None = None) -> DataFrame:
        base = base or self.head()
        held = base.tables.get(name, {})
        paths = [held[b] for b in sorted(held if only is None else set(only) & set(held))]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def staged(self, name: str, base: Manifest, rows: DataFrame, touched: set[int]) -> dict[int, str | None]:
        """Writes the rows of all touched buckets anew and gives their folders; None for a bucket without rows.

        A bucket's pages are dealt over parts, so that however few buckets there are, tasks are as many as rows need; Spark joins small parts."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        parts = -(-2 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(touched)))
        rows.withColumn(_IN, self.bucket(base)).repartition(_IN, F.pmod(F.xxhash64("page_key", F.lit(_IN)), F.lit(parts))).write.partitionBy(_IN).parquet(folder)
        found = {int(n.partition("=")[2]): f"{folder}/{n}" for n in self.folders.names(folder) if n.startswith(f"{_IN}=")}
        if strays := set(found) - touched:
            raise ValueError(f"rows of buckets that aren't touched: {sorted(strays)[:5]}")
        return {b: found.get(b) for b in touched}

    def commit(self, base: Manifest, changes: dict[str, dict[int, str | None]], facts: dict[str, dict[int, list | None]] | None = None, meta: dict[str, str] | None = None) -> Manifest:
        """The manifest with the changes, which were made on `base`; LostCommit if others have changed their buckets since."""
        while True:
            head = self.head()
            if head.version != base.version and any(head.tables.get(t, {}).get(b) != base.tables.get(t, {}).get(b) for t, x in changes.items() for b in x):
                raise LostCommit(f"commit on {base.version} met {head.version}")
            new = head.with_changes(changes, facts or {}, meta or {})
            if self.folders.created(f"{self.root}/manifests/{new.version:020d}.json", json.dumps(asdict(new))):
                return new

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last manifests and the folders that none of those names; not while others write, nor what they read."""
        old = self._versions()[:-keep] if keep else []
        held = {p for n in self._versions()[len(old):] for x in json.loads(self.folders.text(f"{self.root}/manifests/{n}"))["tables"].values() for p in x.values()}
        for n in old:
            self.folders.delete(f"{self.root}/manifests/{n}")
        gone = 0
        for name in self.schemas:
            for run in self.folders.names(f"{self.root}/{name}"):
                for part in self.folders.names(f"{self.root}/{name}/{run}"):
                    path = f"{self.root}/{name}/{run}/{part}"
                    if part.startswith(f"{_IN}=") and path not in held:
                        self.folders.delete(path)
                        gone += 1
        return gone
