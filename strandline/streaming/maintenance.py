"""Keeping an index up to date with a stream of entries.

Each micro-batch is folded into a stored index.  Branches are dealt into buckets by
a hash, and a batch only writes the buckets of the branches that it touches: its
entries beside those that are there, and the index of those buckets anew.  In them a
branch whose rows only go on from what was there is appended to; one with an edit of
an older row, an id that was there already or another history is built anew.

Rows beyond a branch's boundary are cut into terms as they come and kept in the
index, but not eligible: searches and statistics don't see them.  A compaction that
takes them in makes them eligible without cutting them again.

Snapshots are versions.  A batch writes its files, then a pointer file of its own
name; the greatest whole pointer is the current one.  So there always is one, a
reader keeps what it points to until two further versions are there, and a batch
that is run again after a failure writes the same version.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandline.operators import branch
from strandline.operators.index import PARTS, Index, build, sums

BUCKETS = 32
#: Snapshots that stay readable, and parts of a bucket's entries before they are written as one.
KEPT, MOST_PARTS = 3, 8
_KEY = ["branch_id", "rowid"]


class Store:
    """Entries and index of many branches under a path, by version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ------------------------------------------------------------ files

    def _file(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, folder: str = "") -> list[str]:
        target, system = self._file(folder) if folder else self._file(".")
        return sorted(s.getPath().getName() for s in system.listStatus(target)) if system.exists(target) else []

    def _pointer(self, version: int) -> dict | None:
        """What a version consists of; None if it never was finished."""
        target, system = self._file(f"POINTER-{version:012d}.json")
        if not system.exists(target):
            return None
        try:
            return json.loads("\n".join(r[0] for r in self.spark.read.text(target.toString()).collect()))
        except ValueError:
            return None

    def versions(self) -> list[int]:
        """The versions that have a pointer, in order."""
        return [int(n[8:20]) for n in self._names() if n.startswith("POINTER-") and n.endswith(".json")]

    def version(self) -> int | None:
        """The batch that the current snapshot holds."""
        return next((v for v in reversed(self.versions()) if self._pointer(v) is not None), None)

    def _point(self, version: int, held: dict) -> None:
        """Make a version the current one: its pointer is written beside and gets its name when it is whole."""
        part, system = self._file(f".pointer-{version}.part")
        target, _ = self._file(f"POINTER-{version:012d}.json")
        out = system.create(part, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if system.exists(target):  # of this version's own unfinished attempt
            system.delete(target, False)
        if not system.rename(part, target):
            raise OSError(f"can't point {target.toString()} to version {version}")

    def _clean(self) -> None:
        """Remove what no kept snapshot refers to."""
        whole = [v for v in self.versions() if self._pointer(v) is not None]
        kept = whole[-KEPT:]
        used = {f"{folder}/bucket={b}" for k in kept for _, b, folders in self._parts(self._pointer(k)) for folder in folders}
        for v in whole[:-KEPT]:
            target, system = self._file(f"POINTER-{v:012d}.json")
            system.delete(target, False)
        for folder in self._names():
            # A later version than the current one is another batch's work.
            if folder.startswith("v") and folder[1:].isdigit() and kept and int(folder[1:]) <= kept[-1]:
                for kind in self._names(folder):
                    for name in self._names(f"{folder}/{kind}"):
                        if name.startswith("bucket=") and f"{folder}/{kind}/{name}" not in used:
                            target, system = self._file(f"{folder}/{kind}/{name}")
                            system.delete(target, True)

    @staticmethod
    def _parts(held: dict):
        """Kind of rows, bucket and folders of what a snapshot consists of."""
        for b, folders in held["entries"].items():
            yield "entries", b, folders
        for kind in ("documents", "postings", "stats"):
            for b, v in held["index"].items():
                yield kind, b, [f"v{v}/{kind}"]

    def _read(self, held: dict, kind: str, schema, buckets: list[str] | None = None) -> DataFrame:
        """A kind of rows of a snapshot, of some buckets or all."""
        paths = [f"{folder}/bucket={b}" for k, b, folders in self._parts(held) for folder in folders if k == kind and (buckets is None or b in buckets)]
        there = [f"{self.path}/{p}" for p in paths if self._file(p)[1].exists(self._file(p)[0])]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, version: int, kind: str, *order: str) -> None:
        rows = df.withColumn("bucket", self._bucket(F.col("branch_id")))
        if order:
            rows = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", *order)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}/{kind}")

    def _bucket(self, name: Column) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(self.buckets))

    # ------------------------------------------------------------ snapshots

    def entries(self, version: int) -> DataFrame:
        return self._read(self._held(version), "entries", branch.ENTRY)

    def _held(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        held = None if version is None else self._pointer(version)
        if held is None:
            raise FileNotFoundError("nothing has been indexed yet")
        return held

    def index(self, version: int | None = None) -> Index:
        """The index of a version, the current one unless told: what is eligible."""
        held = self._held(version)
        parts = [self._read(held, kind, schema).where("eligible").drop("eligible") for kind, schema in (("documents", DOCUMENTS), ("postings", POSTINGS))]
        return Index(*parts, self._read(held, "stats", STATS))

    def pending(self, version: int | None = None) -> DataFrame:
        """Documents beyond their branch's boundary, which are cut into terms already."""
        return self._read(self._held(version), "documents", DOCUMENTS).where("NOT eligible")

    def update(self, new: DataFrame, version: int) -> dict[str, int]:
        """Fold new entries in; how many branches were appended to and built anew."""
        before = self.version()
        if before is not None and before >= version:
            return {"appended": 0, "rebuilt": 0}
        held = {"version": version, "entries": {}, "index": {}} if before is None else self._pointer(before) | {"version": version}
        self._write(new.select(*branch.ENTRY.names), version, "entries")
        added = self.spark.read.schema(branch.ENTRY).parquet(f"{self.path}/v{version}/entries").select(*branch.ENTRY.names)
        touched = [n[7:] for n in self._names(f"v{version}/entries") if n.startswith("bucket=")]
        full = [b for b in touched if len(held["entries"].get(b, [])) >= MOST_PARTS]
        old = self._read(held, "entries", branch.ENTRY, touched)
        everything = old.unionByName(added)
        parts = {b: [*held["entries"].get(b, []), f"v{version}/entries"] for b in touched}
        if full:
            # Many small parts become one.
            named = everything.withColumn("bucket", self._bucket(F.col("branch_id"))).where(F.col("bucket").isin([int(b) for b in full]))
            named.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{version}/entries-whole")
            parts |= {b: [f"v{version}/entries-whole"] for b in full}
        held["entries"] = held["entries"] | parts
        counts = self._reindex(everything, held, added, touched, version)
        held["index"] = held["index"] | dict.fromkeys(touched, version)
        self._point(version, held)
        self._clean()
        return counts

    def _reindex(self, everything: DataFrame, held: dict, added: DataFrame, touched: list[str], version: int) -> dict[str, int]:
        """Write the index of the touched buckets."""
        ends = branch.boundaries(everything)
        # In branches where an id stands twice the boundary decides which of its rows counts, so only eligible rows are taken.
        rows = branch.projected(branch.edited(everything)).join(ends, "branch_id", "left").withColumn("eligible", F.coalesce(F.col("pos") < F.col("end"), F.lit(False)))
        said = rows.where("searchable IS NOT NULL").select("branch_id", "pos", "id", "role", "ts", F.col("searchable").alias("text"), "eligible")
        twice = said.groupBy("branch_id", "id").agg(F.count("*").alias("n")).where("n > 1").select("branch_id").distinct()
        now = said.join(twice.withColumn("twice", F.lit(True)), "branch_id", "left").where("eligible OR twice IS NULL").drop("twice").persist()
        documents, postings = (self._read(held, kind, schema, touched) for kind, schema in (("documents", DOCUMENTS), ("postings", POSTINGS)))
        old = Index(documents.drop("eligible"), postings.drop("eligible"), self._read(held, "stats", STATS, touched))
        active = added.select("branch_id").distinct()
        rebuild = self._changed(old, now, active, twice).persist()
        try:
            fresh = build(now.join(rebuild, "branch_id", "left_semi").drop("eligible"))
            kept = [part.join(rebuild, "branch_id", "left_anti") for part in (old.documents, old.postings)]
            known = kept[0].select("branch_id", "id")
            more = build(now.join(rebuild, "branch_id", "left_anti").join(known, ["branch_id", "id"], "left_anti").where("text <> ''").drop("eligible"), unique_ids=True)
            flags = now.groupBy("branch_id", F.col("id")).agg(F.max("eligible").alias("eligible"))
            all_documents = functools.reduce(DataFrame.unionByName, [kept[0], more.documents, fresh.documents]).join(flags, ["branch_id", "id"])
            self._write(all_documents.select(*DOCUMENTS.names), version, "documents")
            written = self._read({"entries": {}, "index": dict.fromkeys(touched, version)}, "documents", DOCUMENTS)
            all_postings = functools.reduce(DataFrame.unionByName, [kept[1], more.postings, fresh.postings]).join(written.select(*_KEY, "eligible"), _KEY)
            self._write(all_postings.select(*POSTINGS.names), version, "postings", "term", *_KEY)
            cut = self._read({"entries": {}, "index": dict.fromkeys(touched, version)}, "postings", POSTINGS)
            self._write(sums(written.where("eligible"), cut.where("eligible")), version, "stats")
            rebuilt = rebuild.count()
            return {"appended": active.count() - rebuilt, "rebuilt": rebuilt}
        finally:
            rebuild.unpersist()
            now.unpersist()

    @staticmethod
    def _changed(old: Index, now: DataFrame, active: DataFrame, twice: DataFrame) -> DataFrame:
        """Active branches that can't be appended to: new ones, those in which an indexed row is gone or reads otherwise or an id stands twice."""
        plain = build(now.drop("eligible").join(active, "branch_id", "left_semi"), unique_ids=True).documents.select("branch_id", "id", "content_hash", F.col("rowid").alias("at"))
        was = old.documents.join(active, "branch_id", "left_semi").select("branch_id", "id", F.col("content_hash").alias("was"), F.col("rowid").alias("was_at"))
        other = was.join(plain, ["branch_id", "id"], "left").where("content_hash IS NULL OR content_hash <> was OR at <> was_at").select("branch_id")
        unknown = active.join(old.documents.select("branch_id"), "branch_id", "left_anti")
        return functools.reduce(DataFrame.union, [other, unknown, twice.join(active, "branch_id", "left_semi")]).distinct()


POSTINGS = T.StructType([*PARTS.fields, T.StructField("eligible", T.BooleanType())])
_STRING, _LONG = T.StringType(), T.LongType()
DOCUMENTS = T.StructType(
    [T.StructField(n, _LONG if n in ("rowid", "recency") else _STRING) for n in ("branch_id", "rowid", "id", "role", "ts", "recency", "text", "date", "content_hash")]
    + [T.StructField("eligible", T.BooleanType())]
)
STATS = T.StructType([T.StructField("branch_id", _STRING), T.StructField("n", _LONG), T.StructField("length", _LONG)])


def maintain(entries: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the index under ``path`` up to date with a stream of entries; ``trigger`` as for ``writeStream.trigger``."""
    spark = entries.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            Store(spark, path).update(batch, number)

    stream = entries.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (stream.trigger(**trigger) if trigger else stream).start()


def with_deadline(spark: SparkSession, seconds: float, run):
    """What ``run()`` returns, or a TimeoutError: its jobs are cancelled when the time is over."""
    import threading
    import uuid

    group = uuid.uuid4().hex
    context = spark.sparkContext
    context.setJobGroup(group, "a query with a deadline", interruptOnCancel=True)
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.start()
    try:
        return run()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from error
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
