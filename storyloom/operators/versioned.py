"""Tables of Parquet folders in which the newest row of a key counts, under one manifest.

A commit writes the rows it touches to ``<table>/<part>=…/version=N`` and then one manifest, a line of JSON that
names the live folders of every part; what the manifest does not name does not exist. So a commit is all or
nothing, costs what it touches, and can be tried again after a failure. The first live folder of a part holds
its rows, the later ones what replaces or removes some of them; ``merge`` folds long lists into one folder and
``vacuum`` deletes folders that no recent manifest names. One writer at a time; readers keep what they opened.
"""

from __future__ import annotations

import dataclasses
import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small, delete_path, list_paths

VERSION, GONE = "version", "gone"
_NULL_PART = "__HIVE_DEFAULT_PARTITION__"


@dataclasses.dataclass(frozen=True)
class Layout:
    """Columns of a table, the key whose newest row counts (none: rows only add up), and the column it is parted by."""

    schema: T.StructType
    key: tuple[str, ...]
    part: str
    part_type: T.DataType = dataclasses.field(default_factory=T.DateType)

    @property
    def stored(self) -> T.StructType:
        extra = [T.StructField(GONE, T.BooleanType()), T.StructField(self.part, self.part_type), T.StructField(VERSION, T.LongType())]
        return T.StructType([*self.schema.fields, *extra])


@dataclasses.dataclass
class Manifest:
    version: int
    #: table -> part -> versions of its live folders, oldest first.
    live: dict[str, dict[str, list[int]]]
    facts: dict


def part_text(value) -> str:
    """A part value as its folder spells it."""
    if value is None:
        return _NULL_PART
    return value.isoformat() if isinstance(value, datetime.date) else str(value)


class VersionedTables:
    def __init__(self, spark: SparkSession, path: str, layouts: dict[str, Layout]):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), layouts

    def manifest(self) -> Manifest:
        """The newest manifest; before the first commit an empty one of version 0."""
        if not list_paths(self.spark, f"{self.path}/manifest/version=*"):
            return Manifest(0, {name: {} for name in self.layouts}, {})
        lines = self.spark.read.schema("value string, version bigint").text(f"{self.path}/manifest")
        row = lines.orderBy(F.desc(VERSION)).first()
        return Manifest(row.version, **json.loads(row.value)) if row else Manifest(0, {name: {} for name in self.layouts}, {})

    def _folders(self, name: str, parts: dict[str, list[int]], pick) -> DataFrame:
        layout = self.layouts[name]
        paths = [f"{self.path}/{name}/{layout.part}={p}/version={v}" for p, versions in parts.items() for v in pick(versions)]
        if not paths:
            return self.spark.createDataFrame([], layout.stored)
        return self.spark.read.schema(layout.stored).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def read(self, name: str, parts=None, at: Manifest | None = None) -> DataFrame:
        """The current rows: columns, part and version. ``parts`` (values) limits which folders are opened at all.

        Rows that later folders replace are left out by their keys, which are few next to the rows.
        """
        layout, live = self.layouts[name], (at or self.manifest()).live[name]
        if parts is not None:
            wanted = {part_text(p) for p in parts}
            live = {p: v for p, v in live.items() if p in wanted}
        columns = [*layout.schema.fieldNames(), layout.part, VERSION]
        if not layout.key:
            return self._folders(name, live, lambda v: v).select(*columns)
        first = self._folders(name, live, lambda v: v[:1])
        if not any(len(v) > 1 for v in live.values()):
            return first.where(~F.col(GONE)).select(*columns)
        later = self._folders(name, live, lambda v: v[1:])
        key = [*layout.key, layout.part]
        # The newest version of what later folders hold, by keys alone, so that a read of some columns stays narrow.
        tip = later.groupBy(*key).agg(F.max(VERSION).alias("__newest"))
        tip = broadcast_if_small(tip.withColumnsRenamed({k: f"__{k}" for k in key}))
        same = lambda df: [df[k].eqNullSafe(tip[f"__{k}"]) for k in key]
        kept = first.join(tip, same(first), "left_anti")
        newest = later.join(tip, [*same(later), later[VERSION] == tip["__newest"]], "left_semi")
        return kept.select(*columns, GONE).unionByName(newest.select(*columns, GONE)).where(~F.col(GONE)).select(*columns)

    def _write(self, changes: dict[str, DataFrame], version: int) -> dict[str, list[str]]:
        """Write rows of tables as a version; returns the parts that have some. The rows are gone through twice."""
        parts = None
        for name, rows in changes.items():
            layout = self.layouts[name]
            if GONE not in rows.columns:
                rows = rows.withColumn(GONE, F.lit(False))
            rows = rows.withColumn(VERSION, F.lit(version).cast("bigint")).select(*layout.stored.fieldNames())
            out = rows.hint("rebalance", layout.part).write.option("partitionOverwriteMode", "dynamic")
            out.partitionBy(layout.part, VERSION).mode("overwrite").parquet(f"{self.path}/{name}")
            own = rows.select(F.lit(name).alias("name"), F.col(layout.part).cast("string").alias("part"))
            parts = own if parts is None else parts.unionByName(own)
        written = {name: [] for name in changes}
        for r in parts.distinct().collect() if parts is not None else []:
            written[r.name].append(part_text(r.part))
        return written

    def _publish(self, manifest: Manifest) -> Manifest:
        line = json.dumps({"live": manifest.live, "facts": manifest.facts})
        self.spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={manifest.version}")
        return manifest

    def commit(self, changes: dict[str, DataFrame], facts: dict | None = None, drop: dict[str, list[str]] | None = None, base: Manifest | None = None) -> Manifest:
        """Add rows to tables in one step (they are gone through twice); ``facts`` are merged into the manifest's.

        ``drop`` names folder parts of tables that are given up as a whole.
        """
        old = base or self.manifest()
        live = {name: dict(parts) for name, parts in old.live.items()}
        for name, parts in (drop or {}).items():
            live[name] = {p: v for p, v in live[name].items() if p not in parts}
        for name, parts in self._write(changes, old.version + 1).items():
            for part in parts:
                live[name][part] = [*live[name].get(part, []), old.version + 1]
        return self._publish(Manifest(old.version + 1, live, old.facts | (facts or {})))

    def long_parts(self, name: str, most: int) -> list[str]:
        return [p for p, v in self.manifest().live[name].items() if len(v) > most]

    def merge(self, name: str, parts: list[str], rows: DataFrame | None = None, drop: dict[str, list[str]] | None = None) -> Manifest:
        """Rewrite folder parts of a table as one folder each, from ``rows`` (their current rows by default)."""
        old = self.manifest()
        if rows is None:
            rows = self.read(name, parts, old)
        live = {n: dict(p) for n, p in old.live.items()}
        for n, gone in (drop or {}).items():
            live[n] = {p: v for p, v in live[n].items() if p not in gone}
        written = self._write({name: rows}, old.version + 1)[name]
        live[name] = {p: v for p, v in live[name].items() if p not in parts} | {p: [old.version + 1] for p in written}
        return self._publish(Manifest(old.version + 1, live, old.facts))

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders and manifests that none of the last ``keep`` manifests needs; returns the number of folders."""
        lines = self.spark.read.schema("value string, version bigint").text(f"{self.path}/manifest").orderBy(F.desc(VERSION)).limit(keep).collect()
        needed = {f"{n}/{self.layouts[n].part}={p}/version={v}" for line in lines for n, parts in json.loads(line.value)["live"].items() for p, versions in parts.items() for v in versions}
        oldest, gone = min(line.version for line in lines), 0
        for name in self.layouts:
            for folder in list_paths(self.spark, f"{self.path}/{name}/*/version=*"):
                if "/".join(folder.rstrip("/").split("/")[-3:]) not in needed:
                    delete_path(self.spark, folder)
                    gone += 1
        for folder in list_paths(self.spark, f"{self.path}/manifest/version=*"):
            if int(folder.rsplit("=", 1)[1]) < oldest:
                delete_path(self.spark, folder)
        return gone

