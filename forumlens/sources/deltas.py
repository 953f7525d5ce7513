"""Tables with a key that are changed by small deltas.

Rows are dealt into buckets by a hash of their key. A run writes its rows as one
file folder per bucket it touches and then one commit; readers merge on read: of the
rows of a key the one of the latest commit counts. ``compact`` rewrites only the
buckets whose deltas have grown beyond a share of their base.

    data/_seq=<commit>/_run=<id>/_bucket=<n>/...   rows, never changed
    commits/<number>.json                          which of them make up the table

A commit is a file that is renamed into place and never replaced, so every reader
sees the table before a run or after it. Data of a run that died is not named by any
commit. A run that is given an id does nothing if a commit has that id already, so a
caller that does not know whether its run came through may start it again. Of two
runs that change rows at the same time the later one fails and can be started again;
a compaction next to a run is no conflict.

A bucket is as large as the table divided by the buckets, which are chosen when the
table is made; within a bucket Spark splits the writing by size.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.functions.keyed import arrival, keep_one, not_stored
from forumlens.sources.tables import read_version

#: Buckets of a new table, and the share of its base that the deltas of a bucket may reach.
BUCKETS, RATIO = 64, 0.25
#: Bucket of the rows that have no key: they are all kept.
KEYLESS = -1
PLACE = ("_seq", "_run", "_bucket")


class Conflict(RuntimeError):
    """Another run has changed the table meanwhile."""


@dataclass(frozen=True)
class Part:
    """The rows of one run in one bucket; those of a compaction are its base. Keys of ``fresh`` rows are in no older part."""

    seq: int
    run: str
    bucket: int
    bytes: int
    base: bool
    fresh: bool = False

    @property
    def folder(self) -> str:
        return f"_seq={self.seq}/_run={self.run}/_bucket={self.bucket}"


@dataclass(frozen=True)
class State:
    """What a commit says: its number, how often rows were changed, the runs, columns, rows (if counted) and parts."""

    number: int
    seq: int
    runs: tuple[str, ...]
    schema: str
    rows: int | None
    buckets: int
    parts: tuple[Part, ...]

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"parts": [p.__dict__ for p in self.parts]})

    @classmethod
    def of(cls, text: str) -> State:
        found = json.loads(text)
        return cls(**found | {"runs": tuple(found["runs"]), "parts": tuple(Part(**p) for p in found["parts"])})

    def without(self, gone: Sequence[Part]) -> tuple[Part, ...]:
        if not set(gone) <= set(self.parts):
            raise Conflict("parts to be replaced are gone")
        return tuple(p for p in self.parts if p not in set(gone))


#: Ids of runs that a commit remembers.
RUNS_KEPT = 1000


class KeyedTable:
    """A table at a path, with one row per value of ``key``."""

    def __init__(
        self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS, partition_by: Sequence[str] = ()
    ):
        self.spark, self.path, self.key, self.new_buckets, self.partition_by = spark, path, key, buckets, list(partition_by)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        root = self._hadoop.Path(path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    # --- commits --------------------------------------------------------------

    def _at(self, *names: str):
        return self._hadoop.Path(posixpath.join(self.path, *names))

    def state(self) -> State | None:
        """The latest commit, or None if there is none."""
        folder = self._at("commits")
        if not self._files.exists(folder):
            return None
        numbers = [f.getPath().getName() for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json")]
        return self._read(max(numbers)) if numbers else None

    def _read(self, name: str) -> State:
        return State.of(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(
            self._files.open(self._at("commits", name)), "UTF-8"))

    def _advance(self, change: Callable[[State | None], State]) -> State:
        """Commit what ``change`` makes of the latest state; if another commit came first, of that one."""
        while True:
            head = self.state()
            state = replace(change(head), number=head.number + 1 if head else 1)
            if self._commit(state):
                return state

    def _commit(self, state: State) -> bool:
        """Make a state the latest one; False if there is one of its number."""
        target = self._at("commits", f"{state.number:012d}.json")
        partial = self._at("commits", f".{uuid.uuid4().hex}")
        out = self._files.create(partial, False)
        try:
            out.write(bytearray(state.text().encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            # Fails if the target exists.
            context.rename(self._files.makeQualified(partial), self._files.makeQualified(target), no_options)
        except Exception:
            if not self._files.exists(target):
                raise
            self._files.delete(partial, False)
            return False
        return True

    # --- reading --------------------------------------------------------------

    def _load(self, state: State, parts: Sequence[Part], columns: Sequence[str] | None = None) -> DataFrame:
        """Rows of parts with their place."""
        schema = T.StructType.fromJson(json.loads(state.schema))
        own = [f for f in schema if columns is None or f.name in columns]
        places = [T.StructField("_seq", T.LongType()), T.StructField("_run", T.StringType()), T.StructField("_bucket", T.IntegerType())]
        root = posixpath.join(self.path, "data")
        return self.spark.read.schema(T.StructType([*own, *places])).option("basePath", root).parquet(
            *[posixpath.join(root, p.folder) for p in parts])

    def _merged(self, state: State, parts: Sequence[Part], columns: Sequence[str] | None = None) -> DataFrame:
        """One row per key of the given parts: those of deltas are few and replace what the bases have."""
        newest = max((p.seq for p in parts if not p.base and not p.fresh), default=None)
        # Fresh rows replace nothing; if nothing later replaces them either, they are added without a join.
        added = [p for p in parts if p.fresh and not p.base and (newest is None or p.seq > newest)]
        parts = [p for p in parts if p not in set(added)]
        bases, deltas = [p for p in parts if p.base], [p for p in parts if not p.base]
        rows = self._load(state, bases, columns) if bases else None
        if deltas:
            found = self._load(state, deltas, columns)
            keyed = found.filter(F.col("_bucket") != KEYLESS)
            # A run has each key once.
            last = keyed if len({p.seq for p in deltas}) == 1 else keep_one(keyed, [self.key], [F.desc("_seq")])
            new = last.unionByName(found.filter(F.col("_bucket") == KEYLESS))
            rows = new if rows is None else rows.join(keyed.select(self.key), self.key, "left_anti").unionByName(new)
        if added:
            own = self._load(state, added, columns)
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def read(self, state: State | None = None, columns: Sequence[str] | None = None) -> DataFrame | None:
        """The table as of a commit, by default the latest; None if there is none.

        Buckets without deltas are only scanned. Of the others the rows of deltas, which
        Spark broadcasts while they are small, decide which base rows count.
        """
        state = state or self.state()
        if state is None:
            return None
        names = [f["name"] for f in json.loads(state.schema)["fields"] if columns is None or f["name"] in columns]
        asked = None if columns is None else {*columns, self.key}
        changed = {p.bucket for p in state.parts if not p.base}
        frames = []
        for some in ([p for p in state.parts if p.bucket in changed], [p for p in state.parts if p.bucket not in changed]):
            if some:
                frames.append(self._merged(state, some, asked).select(*names))
        if not frames:
            schema = T.StructType.fromJson(json.loads(state.schema))
            return self.spark.createDataFrame([], schema).select(*names)
        return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])

    # --- writing --------------------------------------------------------------

    def _write(self, rows: DataFrame, seq: int, buckets: int, base: bool) -> list[Part]:
        """Write rows by bucket; they are in no commit yet."""
        run = uuid.uuid4().hex
        bucket = F.when(F.col(self.key).isNull(), F.lit(KEYLESS)).otherwise(
            F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int"))
        folder = posixpath.join(self.path, "data", f"_seq={seq}", f"_run={run}")
        rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy(
            "_bucket", *self.partition_by).parquet(folder)
        sizes: dict[int, int] = {}
        files = self._files.listFiles(self._hadoop.Path(folder), True)
        while files.hasNext():
            status = files.next()
            for name in status.getPath().toString().split("/"):
                if name.startswith("_bucket="):
                    number = int(name.removeprefix("_bucket="))
                    sizes[number] = sizes.get(number, 0) + status.getLen()
        return [Part(seq, run, number, size, base) for number, size in sorted(sizes.items())]

    def _schema(self, state: State | None, rows: DataFrame) -> str:
        """Columns of the table and those that come in, in first-seen order."""
        known = T.StructType.fromJson(json.loads(state.schema)) if state else T.StructType()
        new = [T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in known.fieldNames()]
        return T.StructType([*known, *new]).json()

    def _runs(self, state: State | None, run_id: str | None) -> tuple[str, ...]:
        return (*(state.runs if state else ()), *([run_id] if run_id else ()))[-RUNS_KEPT:]

    def upsert(
        self, rows: DataFrame, run_id: str | None = None, mode: str = "update", order: Sequence[Column] | None = None,
        drop: Sequence[str] = (), count: bool = False,
    ) -> State:
        """Bring rows in: the last one per key replaces what is stored, or with ``mode='ignore'`` the first one if nothing is.

        Rows without a key are all added. ``order`` tells which row of a key comes first
        in the batch; by default its arrival does. Columns to ``drop`` may tell that order
        and are not stored. ``count`` keeps the number of rows in the commit, which costs a
        scan of the stored keys.
        """
        state = self.state()
        if state is None and (old := read_version(self.spark, self.path)) is not None:
            # Written whole, before tables had deltas.
            state = self.replace(old)
        if state and run_id and run_id in state.runs:
            return state
        has_key = F.col(self.key).isNotNull()
        # Every row without a key is a group of its own; the batch is read once.
        alone = rows.withColumn("_alone", F.when(~has_key, F.monotonically_increasing_id()))
        one = keep_one(alone, [self.key, "_alone"], order or arrival(rows, newest_first=mode == "update")).drop("_alone")
        # Only where it is asked: a table of many runs has many folders to be listed.
        stored = None if state is None or not (count or mode == "ignore") else self.read(state, [self.key])
        if mode == "ignore" and stored is not None:
            one = not_stored(one, stored, [self.key], rows.filter(has_key))
        one = one.drop(*drop)
        seq = state.seq + 1 if state else 1
        parts = tuple(self._write(one, seq, state.buckets if state else self.new_buckets, state is None))
        if mode == "ignore" and state is not None:
            parts = tuple(replace(p, fresh=True) for p in parts)
        schema = self._schema(state, one)
        held = None
        if count and (state is None or state.rows is not None):
            # Counted from what was written: the batch may be costly to make again.
            held = state.rows if state else 0
            if parts:
                keys = self._load(State(0, seq, (), schema, None, 0, parts), parts, [self.key])
                held += keys.count()
                if stored is not None and mode == "update":
                    held -= stored.join(keys.filter(has_key).select(self.key), self.key, "left_semi").count()

        def changed(head: State | None) -> State:
            if (head.seq if head else 0) != seq - 1:
                raise Conflict(f"change {seq} was made by another run")
            return State(
                0, seq, self._runs(head, run_id), schema, held, head.buckets if head else self.new_buckets,
                (*(head.parts if head else ()), *parts))

        return self._advance(changed)

    def replace(self, rows: DataFrame, run_id: str | None = None) -> State:
        """Put rows, one per key, in the place of all that is stored."""
        state = self.state()
        if state and run_id and run_id in state.runs:
            return state
        seq, buckets = state.seq + 1 if state else 1, state.buckets if state else self.new_buckets
        parts = tuple(self._write(rows, seq, buckets, True))
        schema = self._schema(None, rows)
        now = State(0, seq, (), schema, None, buckets, parts)
        held = self._load(now, parts, [self.key]).count() if parts else 0

        def changed(head: State | None) -> State:
            if (head.seq if head else 0) != seq - 1:
                raise Conflict(f"change {seq} was made by another run")
            return replace(now, runs=self._runs(head, run_id), rows=held)

        return self._advance(changed)

    def compact(self, ratio: float = RATIO) -> list[int]:
        """Rewrite the buckets whose deltas hold more than ``ratio`` of the bytes of their base; returns them."""
        state = self.state()
        if state is None:
            return []
        sizes: dict[int, list[int]] = {}
        for p in state.parts:
            sizes.setdefault(p.bucket, [0, 0])[p.base] += p.bytes
        chosen = sorted(b for b, (delta, base) in sizes.items() if delta > ratio * base)
        if not chosen:
            return []
        old = [p for p in state.parts if p.bucket in set(chosen)]
        # The new base is as old as what it was made of: a run that commits meanwhile stays newer.
        parts = self._write(self._merged(state, old).drop(*PLACE), state.seq, state.buckets, True)
        self._advance(lambda head: replace(head, parts=(*head.without(old), *parts)))
        return chosen

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete data that none of the newest ``keep`` commits names; returns the folders that went.

        Nothing calls it by itself: readers may hold an older commit, and a run that is
        writing has no commit yet, so the owner of the table says when.
        """
        folder = self._at("commits")
        names = sorted(
            f.getPath().getName() for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json"))
        named = {p.folder.rsplit("/", 1)[0] for name in names[-keep:] for p in self._read(name).parts}
        gone = []
        for seq in self._files.listStatus(self._at("data")):
            for run in self._files.listStatus(seq.getPath()):
                own = f"{seq.getPath().getName()}/{run.getPath().getName()}"
                if own not in named:
                    self._files.delete(run.getPath(), True)
                    gone.append(own)
        return sorted(gone)
