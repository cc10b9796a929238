"""A bucket on disk: immutable Parquet files of facts, and numbered snapshots that say which of them count.

Data files are written first; then one snapshot file is renamed to a name that must not exist yet, so of two writers one
fails and a reader sees all of a commit or nothing. A commit spans partitions. Everything goes through Hadoop's file
systems, not through local paths.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import partition_of, partition_of_key, valid_key
from ..operators.blob import latest_parts
from ..operators.clock import MAX_SKEW_MILLIS, HybridClock
from ..operators.compaction import L0_STALL, compact, expired_uploads, referenced
from ..operators.resolve import live, max_clock

FACTS = (
    "key string, p bigint, l int, n int, type int, content_type string, user_meta map<string,string>, created_at bigint, "
    "parts array<struct<len:bigint,chunk:int,crc:bigint,segs:array<struct<blob:bigint,first:bigint,last:bigint>>>>, owner string, grants array<struct<grantee:string,ops:array<string>>>"
)
RANGES = "s string, e string, p bigint, l int, n int"
CHUNKS = "blob bigint, entry_id bigint, crc bigint, data binary"
UPLOADS = "upload_id string, key string, content_type string, user_meta string, created_at bigint, open boolean, seq bigint"
PARTS = "upload_id string, part_number int, seq bigint, len bigint, chunk int, crc bigint, blob bigint"
KINDS = {"ranges": RANGES, "chunks": CHUNKS, "uploads": UPLOADS, "parts": PARTS}


@dataclass
class Snapshot:
    version: int = 0
    facts: list[str] = field(default_factory=list)
    ranges: list[str] = field(default_factory=list)
    chunks: list[str] = field(default_factory=list)
    uploads: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    obsolete: list[list] = field(default_factory=list)  # [file, when it became obsolete]


class Conflict(RuntimeError):
    """Another writer made this version."""


class Busy(RuntimeError):
    """So many files of facts wait for a compaction that writers have to wait too."""


class Bucket:
    def __init__(self, spark: SparkSession, path: str, partition_count: int = 8, node: int = 0, stall: int = L0_STALL, max_skew: int = MAX_SKEW_MILLIS):
        self.spark, self.path, self.partition_count, self.stall = spark, path.rstrip("/"), partition_count, stall
        self.clock = HybridClock(node, max_skew=max_skew)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        newest = max_clock(self.log(), self.ranges()).first()
        if newest.p is not None:
            self.clock.observe(newest.p, newest.l)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or a given one."""
        folder = self._path("snapshots")
        if not self._fs.exists(folder):
            return Snapshot()
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        name = names[-1] if version is None and names else f"{version:012d}.json" if version else None
        if name is None:
            return Snapshot()
        stream = self._fs.open(self._path(f"snapshots/{name}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def _publish(self, new: Snapshot) -> None:
        """Writes the snapshot under a name of its own, then renames it to one that must not exist: a reader never meets
        half a file, and a writer that dies in between leaves nothing that counts."""
        draft, at = self._path(f"snapshots/draft-{uuid.uuid4().hex}"), self._path(f"snapshots/{new.version:012d}.json")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(at), options)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(at):
                raise Conflict(f"version {new.version} exists") from error
            raise

    def _write(self, df: DataFrame, kind: str, partitioned: bool) -> str:
        name = f"data/{kind}-{uuid.uuid4().hex}"
        if partitioned:
            rows = df.withColumn("part", partition_of(F.col("key"), self.partition_count)).repartition("part").sortWithinPartitions("part", "key")
            rows.write.partitionBy("part").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        else:
            df.write.parquet(f"{self.path}/{name}")
        return name

    def log(self, key: str | None = None, version: int | None = None) -> DataFrame:
        """All facts of a snapshot; with a key, of its partition alone."""
        files = self.snapshot(version).facts
        if not files:
            return self.spark.createDataFrame([], FACTS)
        df = None
        for f in files:
            one = self.spark.read.schema(FACTS + ", part int").parquet(f"{self.path}/{f}")
            df = one if df is None else df.union(one)
        if key is not None:
            df = df.where((F.col("part") == partition_of_key(key, self.partition_count)) & (F.col("key") == key))
        return df.drop("part")

    def rows(self, kind: str, version: int | None = None) -> DataFrame:
        """All rows of ranges, chunks, uploads or parts."""
        files = getattr(self.snapshot(version), kind)
        return self.spark.read.schema(KINDS[kind]).parquet(*[f"{self.path}/{f}" for f in files]) if files else self.spark.createDataFrame([], KINDS[kind])

    def ranges(self, version: int | None = None) -> DataFrame:
        return self.rows("ranges", version)

    def live(self, version: int | None = None) -> DataFrame:
        return live(self.log(version=version), self.ranges(version))

    def get(self, key: str) -> DataFrame:
        """The live fact of one key, or no row."""
        return live(self.log(key), self.ranges())

    def commit(self, facts: DataFrame | None = None, **more: DataFrame) -> int:
        """Appends stamped facts, ranges, chunks, uploads and parts as one version."""
        old = self.snapshot()
        new = replace(old, version=old.version + 1, facts=list(old.facts))
        if facts is not None:
            if len(old.facts) >= self.stall:
                raise Busy(f"{len(old.facts)} files wait for a compaction")
            have = set(facts.columns)
            schema = self.spark.createDataFrame([], FACTS).schema
            rows = facts.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            if not rows.where(~valid_key(F.col("key"))).isEmpty():
                raise ValueError("a key is empty or too long")
            new.facts.append(self._write(rows, "facts", True))
        for kind, rows in more.items():
            schema = self.spark.createDataFrame([], KINDS[kind]).schema
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
            setattr(new, kind, [*getattr(old, kind), self._write(rows.sortWithinPartitions(rows.columns[0]), kind, False)])
        self._publish(new)
        return new.version

    def compact(self, now: int, grace: int) -> int:
        """All files into one, as the bottommost compaction; the old files are obsolete until collect()."""
        old = self.snapshot()
        facts, ranges = compact(self.log(), self.ranges(), True, now, grace)
        new = replace(old, version=old.version + 1, facts=[self._write(facts, "facts", True)], ranges=[self._write(ranges, "ranges", False)], obsolete=[*old.obsolete, *self._now_obsolete(old.facts, old.ranges)])
        self._publish(new)
        return new.version

    def _now_obsolete(self, *files: list[str]) -> list[list]:
        at = self.clock.wall()
        return [[f, at] for some in files for f in some]

    def referenced_blobs(self) -> DataFrame:
        """Blobs that a fact or an open upload refers to."""
        of_facts = self.log().select(F.explode("parts").alias("x")).select(F.explode("x.segs").alias("y")).select(F.col("y.blob").alias("blob"))
        return referenced(of_facts, latest_parts(self.rows("parts")).join(self.open_uploads().select("upload_id"), "upload_id"))

    def open_uploads(self) -> DataFrame:
        last = self.rows("uploads").groupBy("upload_id").agg(F.max(F.struct("seq", "open", "key", "content_type", "user_meta", "created_at")).alias("w"))
        return last.where("w.open").select("upload_id", "w.key", "w.content_type", "w.user_meta", "w.created_at")

    def drop_orphans(self) -> int:
        """Rewrites the chunks that are still referred to; the old chunk files become obsolete."""
        old = self.snapshot()
        kept = self.rows("chunks").join(self.referenced_blobs(), "blob", "left_semi")
        new = replace(old, version=old.version + 1, chunks=[self._write(kept.sortWithinPartitions("blob"), "chunks", False)], obsolete=[*old.obsolete, *self._now_obsolete(old.chunks)])
        self._publish(new)
        return new.version

    def maintain(self, now: int, grace: int, upload_ttl: int, passes: int = 1) -> None:
        """A bounded round of upkeep: compaction, old uploads, orphaned chunks, then files no snapshot needs."""
        for _ in range(passes):
            if len(self.snapshot().facts) > 1:
                self.compact(now, grace)
        old = expired_uploads(self.open_uploads(), now, upload_ttl)
        if not old.isEmpty():
            self.commit(uploads=old.select("*", F.lit(False).alias("open"), F.lit(self.clock.tick()[0] * 1_000_000).cast("bigint").alias("seq")))
        if self.snapshot().chunks:
            self.drop_orphans()
        self.collect(now, grace)

    def collect(self, now: int | None = None, grace: int = 0) -> int:
        """Deletes the files that have been obsolete for the grace time, then says so in a version of its own. Readers of
        a version have that long to end; without a grace time they must be gone."""
        old = self.snapshot()
        now = self.clock.wall() if now is None else now
        due = [f for f, at in old.obsolete if at <= now - grace]
        for f in due:
            self._fs.delete(self._path(f), True)
        if due:
            self._publish(replace(old, version=old.version + 1, obsolete=[x for x in old.obsolete if x[0] not in set(due)]))
        return len(due)

    def view(self, name: str) -> DataFrame:
        """The live view as a temporary view for SQL."""
        out = self.live()
        out.createOrReplaceTempView(name)
        return out
