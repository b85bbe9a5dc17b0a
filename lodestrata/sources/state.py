"""The catalog as a base and deltas, merged when it is read, with versions that are put and never replaced.

    base-ID/objects, base-ID/blobs     Parquet, bucketed and sorted by (bucket, object_key) and by (bucket, hash)
    delta-ID/objects, delta-ID/blobs   what a scan has written and deleted
    delta-ID/marks                     blobs that nothing names, the epoch that found them so, and which of them are due
    CURRENT-N                          version N: its base, its deltas, the scopes seen last, totals, settings, marks, open sweeps

A scan writes one delta, so what it writes follows what has changed.  That an object was seen is not a
write at all: a scope's last complete listing is a line of the version, and `last_seen_scan` comes from
there.  Joins of a listing or of touched blobs with the base are planned on its buckets: the base isn't
shuffled.  When the deltas outgrow COMPACTED of the base, a commit writes a new one.

IDs are the writer's own, and CURRENT-N is made by an operation that fails if the file exists.  So of two
writers at one version one is first; the other takes its changes to the new version if the two have
no object in common and no blob that one of them removes, else it fails and its changes are as if never made.

Collection in two phases: a scan marks the blobs that nothing names; a later one that finds a mark old enough takes
the blob out of the catalog, commits that, and only then deletes it from storage.  The version lists the sweep as
open until a further one closes it, so a driver lost in between leaves a list of what is to be deleted.  Whoever is about
to name a marked blob takes the mark off first, by a commit of its own: of the two commits one is
first and the other one fails, before anything is deleted or any object is replaced.

Nothing that a kept version names is removed, and nothing that no version has named: it may be in the making.
Paths may be of any file system whose rename fails on an existing target; local folders use hard links.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import changes
from lodestrata.operators.changes import BLOB, BLOB_CHANGES, OBJECT_CHANGES, TOTALS
from lodestrata.operators.filters import PUSHED_SCOPES, filter_scopes, in_any_scope
from lodestrata.schemas import BLOBS, KEY, OBJECTS, struct

#: Deltas may have this part of the base's bytes, a base under SMALL bytes counting as that large; so many they may be; and
#: rows of a bucket of the base, about.
COMPACTED, SMALL, MOST_DELTAS, BUCKET_ROWS = 0.25, 8 << 20, 50, 1_000_000
MARKS = struct("bucket string, hash string, blob_key string, size bigint, since bigint, due boolean")
_BASE_OBJECTS = T.StructType([*OBJECTS.fields, T.StructField("seq", T.LongType())])


class Conflict(Exception):
    """Another writer has committed changes of the same objects or blobs."""


class Behind(Conflict):
    """Another writer has committed anything at all."""


@dataclass
class Version:
    """What a marker holds.  `seen`: (bucket, prefix, scan id, version) of each scope's last complete listing; `epoch`: scans
    that were committed; `marks` and `sweeps`: the folders that hold them."""

    version: int = 0
    meta: dict = field(default_factory=dict)
    base: dict | None = None
    deltas: list[str] = field(default_factory=list)
    own: str = ""
    seen: list[list] = field(default_factory=list)
    totals: dict[str, list[int]] = field(default_factory=dict)
    epoch: int = 0
    marks: str = ""
    sweeps: list[str] = field(default_factory=list)

    @property
    def folders(self) -> set[str]:
        named = {self.own, *self.deltas, self.marks, *self.sweeps, self.base["id"] if self.base else ""}
        return named - {""}


class Snapshot:
    """A version that is read."""

    def __init__(self, store: StateStore, at: Version):
        self._store, self.at, self.version, self.meta = store, at, at.version, at.meta

    @cached_property
    def _base_objects(self) -> DataFrame:
        return self._store._base(self.at.base, "objects", _BASE_OBJECTS, KEY)

    @cached_property
    def _base_blobs(self) -> DataFrame:
        return self._store._base(self.at.base, "blobs", BLOBS, BLOB)

    @cached_property
    def _latest(self) -> DataFrame:
        return changes.newest(self._store._deltas(self.at.deltas, "objects", OBJECT_CHANGES), KEY)

    @cached_property
    def _folded(self) -> DataFrame:
        return changes.fold_blobs(self._store._deltas(self.at.deltas, "blobs", BLOB_CHANGES))

    @property
    def with_seq(self) -> DataFrame:
        merged = changes.merge_objects(self._base_objects, self._latest)
        return _last_seen(merged, self.at.seen) if self.at.seen else merged

    @property
    def objects(self) -> DataFrame:
        return self.with_seq.drop("seq")

    @property
    def blobs(self) -> DataFrame:
        return changes.merge_blobs(self._base_blobs, self._folded)

    @property
    def totals(self) -> dict[str, int]:
        return {name: sum(t[i] for t in self.at.totals.values()) for i, name in enumerate(TOTALS)}

    @property
    def marks(self) -> DataFrame:
        """Blobs that nothing names and that are still in the catalog, with `since`, the epoch that marked them."""
        return self._store._deltas([self.at.marks] if self.at.marks else [], "marks", MARKS).where("not due")

    def sweeping(self, sweeps: list[str] | None = None) -> DataFrame:
        """Blobs of open sweeps: out of the catalog, and to be deleted unless it has them again."""
        due = self._store._deltas(self.at.sweeps if sweeps is None else sweeps, "marks", MARKS).where("due").select(*BLOB, "blob_key", "size").distinct()
        return self.lookup_blobs(due).where("blob is null").drop("blob")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Rows of (bucket, object_key, ...) with `old`, the catalog's row of the key or null.  Only the rows move."""
        kept = [c for c in OBJECTS.fieldNames() if c not in (*KEY, "last_seen_scan")]
        base = self._base_objects.select(*KEY, F.struct(kept).alias("__base"))
        latest = self._latest.select(*KEY, F.struct(*kept, "deleted").alias("__new"))
        known = F.when(F.col("__new").isNull(), F.col("__base")).when(~F.col("__new.deleted"), F.struct(*[F.col(f"__new.{c}").alias(c) for c in kept]))
        return rows.join(base, KEY, "left").join(latest, KEY, "left").withColumn("old", known).drop("__base", "__new")

    def lookup_blobs(self, rows: DataFrame) -> DataFrame:
        """Rows of (bucket, hash, ...) with `blob`, the catalog's blob_key, size, ref_count and stored, or null."""
        names = ["blob_key", "size", "ref_count", "stored"]
        base = self._base_blobs.select(*BLOB, F.struct(names).alias("__base"))
        folded = self._folded.select(*BLOB, F.col("change").alias("__change"), F.col("last").alias("__last"))
        count = F.coalesce("__base.ref_count", F.lit(0)) + F.col("__change")
        now = F.struct(F.col("__last.blob_key").alias("blob_key"), F.col("__last.size").alias("size"), count.cast("long").alias("ref_count"), F.col("__last.stored").alias("stored"))
        known = F.when(F.col("__last").isNull(), F.col("__base")).when(~F.col("__last.removed"), now)
        return rows.join(base, BLOB, "left").join(folded, BLOB, "left").withColumn("blob", known).drop("__base", "__change", "__last")

    def missing(self, listed: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
        """Objects of the scopes whose key is not listed, with `old`."""
        named = changes.merge_objects(self._base_objects, self._latest).select(*KEY, "blob_bucket", "blob_hash").join(listed.select(KEY), KEY, "left_anti")
        gone = in_any_scope(named, scopes)
        return gone.select(*KEY, F.struct("blob_bucket", "blob_hash").alias("old"))


def _last_seen(merged: DataFrame, seen: list[list]) -> DataFrame:
    """`last_seen_scan`: the scan that wrote an object, or a later one that listed a scope that it is in."""
    if len(seen) <= PUSHED_SCOPES:
        scopes = F.array(*[F.struct(F.lit(n).cast("long").alias("seq"), F.lit(scan).alias("scan"), F.lit(b).alias("bucket"), F.lit(p).alias("prefix")) for b, p, scan, n in seen])
        covering = F.filter(scopes, lambda s: (s["bucket"] == F.col("bucket")) & F.col("object_key").startswith(s["prefix"]) & (s["seq"] > F.col("seq")))
        return merged.withColumn("last_seen_scan", F.coalesce(F.array_max(covering)["scan"], "last_seen_scan"))
    scans = merged.sparkSession.createDataFrame([tuple(x) for x in seen], "scope_bucket string, scope_prefix string, scan string, at bigint")
    held = filter_scopes(merged.select(*KEY, "seq"), [(b, p) for b, p, *_ in seen]).join(scans, ["scope_bucket", "scope_prefix"]).where("at > seq")
    latest = held.groupBy(KEY).agg(F.max(F.struct("at", "scan")).alias("__last"))
    return merged.join(latest, KEY, "left").withColumn("last_seen_scan", F.coalesce("__last.scan", "last_seen_scan")).drop("__last")


class CatalogStore(Protocol):
    """What a scan needs of the place where its catalog lives."""

    def load(self) -> Snapshot: ...

    def draft(self, before: Snapshot) -> Draft: ...

    def commit(self, draft: Draft, meta: dict, scan_id: str = "", seen: list[tuple[str, str]] | None = None) -> Snapshot: ...

    def rescue(self, named: DataFrame) -> None: ...

    def close(self) -> None: ...


class Draft:
    """A delta that is being written on top of a version; nothing reads it before it is committed."""

    def __init__(self, store: StateStore, before: Snapshot):
        self.store, self.before, self.id, self.seq = store, before, f"delta-{uuid.uuid4().hex}", before.version + 1
        self.totals: dict[str, list[int]] = {}
        self.written = self.marked = self.swept = False
        self.closed: set[str] = set()

    def write(self, objects: DataFrame, blobs: DataFrame) -> None:
        """Changes of objects, and of blobs with n_before."""
        self.written = True
        self.store._write(objects.select(OBJECT_CHANGES.fieldNames()), self.id, "objects")
        self.store._write(blobs.select(*BLOB_CHANGES.fieldNames(), "n_before"), self.id, "blobs")
        self.totals = _by_bucket(changes.total_changes(self.store._read(self.id, "blobs", T.StructType([*BLOB_CHANGES.fields, T.StructField("n_before", T.LongType())]))))

    def snapshot(self) -> Snapshot:
        """The catalog with this draft, as it is before a commit."""
        at = self.before.at
        return Snapshot(self.store, Version(self.seq, at.meta, at.base, [*at.deltas, self.id], self.id, at.seen, _added(at.totals, self.totals)))

    def mark(self, unreferenced: DataFrame, after: int) -> None:
        """Marks blobs that nothing names.  Those that were marked `after` epochs ago, and that nothing named at the version
        before this draft either, leave the catalog: their sweep is open as soon as the draft is committed."""
        epoch = self.before.at.epoch + 1
        aged = self.before.lookup_blobs(unreferenced.select(*BLOB, "blob_key", "size")).join(self.before.marks.select(*BLOB, F.col("since").alias("__since")), BLOB, "left")
        since = F.coalesce(F.when(F.col("blob.ref_count") == 0, F.col("__since")), F.lit(epoch).cast("long"))
        self.marks(aged.select(*BLOB, "blob_key", "size", since.alias("since")).withColumn("due", F.col("since") <= epoch - after))
        due = self.store._read(self.id, "marks", MARKS).where("due")
        self.swept = not due.isEmpty()
        if self.swept:
            self.remove_blobs(due)

    def marks(self, rows: DataFrame) -> None:
        self.marked = True
        self.store._write(rows.select(MARKS.fieldNames()), self.id, "marks")

    def remove_blobs(self, gone: DataFrame) -> None:
        """Blobs (bucket, hash) that are gone from storage and that nothing names."""
        rows = gone.select(*BLOB, F.lit(None).cast("string").alias("blob_key"), F.lit(None).cast("long").alias("size"), F.lit(False).alias("stored"), F.lit(0).cast("long").alias("change"), F.lit(True).alias("removed"), F.lit(self.seq).cast("long").alias("seq"), F.lit(0).cast("long").alias("n_before"))
        self.store._write(rows, self.id, "blobs", "append")


def _table(folder: str, name: str) -> str:
    return f"lodestrata_{folder.replace('-', '_')}_{name}"


def _by_bucket(rows: DataFrame) -> dict[str, list[int]]:
    return {r["bucket"]: [r[name] for name in TOTALS] for r in rows.collect()}  # a row for each configured bucket


def _added(a: dict[str, list[int]], b: dict[str, list[int]]) -> dict[str, list[int]]:
    none = [0] * len(TOTALS)
    return {k: [x + y for x, y in zip(a.get(k, none), b.get(k, none))] for k in sorted({*a, *b})}


class StateStore:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2, compacted: float = COMPACTED, small: int = SMALL):
        if not path:
            raise ValueError("state path must not be empty")
        self.spark, self.path, self.keep, self.compacted, self.small = spark, path.rstrip("/"), keep, compacted, small
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))
        self._closed = False

    # -------------------------------------------------------------- tables

    def _write(self, rows: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(f"{self.path}/{folder}/{name}")

    def _read(self, folder: str, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}")

    def _deltas(self, ids: list[str], name: str, schema: T.StructType) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{i}/{name}" for i in ids])

    def _base(self, base: dict | None, name: str, schema: T.StructType, key: list[str]) -> DataFrame:
        if base is None:
            return self.spark.createDataFrame([], schema)
        table = _table(base["id"], name)  # known to this session only
        if not self.spark.catalog.tableExists(table):
            columns, keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), ", ".join(key)
            at = str(self._fs.makeQualified(self._path(f"{self.path}/{base['id']}/{name}"))).replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {base[name]} BUCKETS LOCATION '{at}'")
        return self.spark.table(table)

    def _write_base(self, snap: Snapshot) -> dict:
        base: dict = {"id": f"base-{uuid.uuid4().hex}"}
        for name, rows, key in (("objects", snap.with_seq, KEY), ("blobs", snap.blobs, BLOB)):
            n = base[name] = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / BUCKET_ROWS))
            table = f"lodestrata_new_{uuid.uuid4().hex}"
            rows.repartition(n, *key).write.format("parquet").bucketBy(n, *key).sortBy(*key).option("path", f"{self.path}/{base['id']}/{name}").saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # the name only: its files are not the session's
        return base

    def bytes_of(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.path}/{folder}")).getLength()

    # -------------------------------------------------------------- versions

    def _markers(self) -> list[int]:
        """Versions with a marker, the latest first."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted((int(n) for x in names if x.startswith("CURRENT-") and (n := x.removeprefix("CURRENT-")).isdigit()), reverse=True)

    def _marker(self, version: int) -> Version | None:
        stream = self._fs.open(self._path(f"{self.path}/CURRENT-{version}"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes())))
        except (ValueError, TypeError):  # cut off while it was written, by a file system that does not rename
            return None
        finally:
            stream.close()

    def _head(self) -> Version:
        return next((found for v in self._markers() if (found := self._marker(v)) is not None), Version())

    def load(self) -> Snapshot:
        if self._closed:
            raise ValueError("the catalog is closed")
        return Snapshot(self, self._head())

    def _put_if_absent(self, name: str, data: bytes) -> bool:
        """Whether this call has made the file, whole; False if it was there."""
        target, made = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/_{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(made, True)
        stream.write(bytearray(data))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                source, link = (os.fspath(self._fs.makeQualified(p).toUri().getPath()) for p in (made, target))
                os.link(source, link)
                return True
            jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
            options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(made), self._fs.makeQualified(target), options)
            return True
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        finally:
            self._fs.delete(made, False)

    def draft(self, before: Snapshot) -> Draft:
        return Draft(self, before)

    def rescue(self, named: DataFrame) -> None:
        """Takes the marks off blobs (bucket, hash) that are about to be named.  Raises Conflict if one of them was taken out."""
        while True:
            now = self.load()
            found = now.lookup_blobs(named.select(*BLOB).distinct())
            if not found.where("blob is null").isEmpty():
                raise Conflict("a blob is being collected")
            draft = self.draft(now)
            touched = found.select(*BLOB, "blob.blob_key", "blob.size", "blob.stored", F.lit(0).cast("long").alias("change"), F.lit(False).alias("removed"), F.lit(draft.seq).cast("long").alias("seq"), F.col("blob.ref_count").alias("n_before"))
            draft.write(self._deltas([], "objects", OBJECT_CHANGES), touched)
            draft.marks(now.marks.join(named.select(*BLOB), BLOB, "left_anti"))
            try:
                self.commit(draft, now.meta, exact=True)
                return
            except Behind:
                continue

    def commit(self, draft: Draft, meta: dict, scan_id: str = "", seen: list[tuple[str, str]] | None = None, exact: bool = False) -> Snapshot:
        """Makes the draft a version, of the one that it was made on or, unless `exact`, of a later one with which it does not conflict.

        `seen` are the scopes that were listed whole.  Raises Conflict; the catalog is then as the other writer left it.
        Marks are those of the draft if it is on top of what it was made on, else they stay for the next scan to take up.
        """
        base = None
        while True:
            head = self._head()
            same = head.version == draft.before.version
            if exact and not same:
                raise Behind("another writer has committed")
            moved = draft.totals if same or not draft.written else self._rebased(draft, head)
            own = [draft.id] if draft.written else []
            number = max([head.version, *self._markers()[:1]]) + 1
            scopes = {(b, p): [b, p, scan, n] for b, p, scan, n in head.seen} | {s: [*s, scan_id, number] for s in seen or []}
            new = Version(
                number, meta, head.base, [*head.deltas, *own], "".join(own), sorted(scopes.values()), _added(head.totals, moved), head.epoch + (draft.written and not exact),
                draft.id if draft.marked and same else head.marks, [s for s in [*head.sweeps, *(own if draft.swept else [])] if s not in draft.closed],
            )
            held = sum(self.bytes_of(i) for i in new.deltas)
            if held > self.compacted * max(self.small, self.bytes_of(head.base["id"]) if head.base else 0) or len(new.deltas) > MOST_DELTAS:
                new.base, new.deltas = self._write_base(Snapshot(self, new)), []
                base = new.base
            if self._put_if_absent(f"CURRENT-{number}", json.dumps(new.__dict__).encode()):
                break
            if base is not None:  # of a version that did not come about
                self._fs.delete(self._path(f"{self.path}/{base['id']}"), True)
        self._clean(new)
        return Snapshot(self, new)

    def _rebased(self, draft: Draft, head: Version) -> dict[str, list[int]]:
        """How the draft moves the totals of a later version."""
        since = [self._marker(v) for v in self._markers() if draft.before.version < v <= head.version]
        if len(since) < head.version - draft.before.version or None in since:
            raise Conflict("the version that was changed is no longer known")
        ids = [v.own for v in since if v.own]
        mine, theirs = (self._deltas(i, "objects", OBJECT_CHANGES).select(KEY) for i in ([draft.id], ids))
        if not mine.join(theirs, KEY, "left_semi").isEmpty():
            raise Conflict("another writer has changed the same objects")
        own, others = (self._deltas(i, "blobs", BLOB_CHANGES) for i in ([draft.id], ids))
        both = own.select(*BLOB, F.struct("removed", "blob_key", "size").alias("a")).join(others.select(*BLOB, F.struct("removed", "blob_key", "size").alias("b")), BLOB)
        if not both.where("a.removed or b.removed or a.blob_key <> b.blob_key or a.size <> b.size").isEmpty():
            raise Conflict("another writer has removed or made the same blobs")
        touched = Snapshot(self, head).lookup_blobs(own).withColumn("n_before", F.coalesce("blob.ref_count", F.lit(0)))
        return _by_bucket(changes.total_changes(touched))

    def _clean(self, head: Version) -> None:
        """Removes versions that are `keep` scans old, and what only they name."""
        found = {v: self._marker(v) for v in self._markers()}
        names = lambda v: v.folders if v else set()
        recent = {v for v, x in found.items() if (x.epoch > head.epoch - self.keep if x else v > head.version - self.keep)}
        kept = set().union(*[names(found[v]) for v in recent])
        for old, x in found.items():
            if old not in recent:
                self._fs.delete(self._path(f"{self.path}/CURRENT-{old}"), False)
                for folder in names(x) - kept:
                    self._fs.delete(self._path(f"{self.path}/{folder}"), True)
                    for name in ("objects", "blobs"):
                        self.spark.sql(f"DROP TABLE IF EXISTS {_table(folder, name)}")

    def close(self) -> None:
        """Ends the use of the catalog; nothing stays open between calls, so nothing can be lost."""
        self._closed = True
