"""Problem 1: new batches against all history.

The accepted documents and the pending files are kept in a folder as an index of graph shards: a segment for the documents
and one for each batch, each divided into cells, each cell a navigable small-world graph over 64 random projections of a
text's runs of three words. Beside its shards a segment holds its keys, the digests and hashes of word sequences. A batch
that comes looks its keys up among those of all segments, adds a segment of its own, and asks the shards of the cells near
to its texts with a widened beam; then FAN_IN finished segments of one size are compacted into one of the next. No text of a
former batch is read for this, and no segment is built again but by the schedule. What was met is ranked by the exact
similarity.

Every step leaves a manifest in the folder, so an index can be opened again and goes on after its last whole step. The cells
are fitted once, on a bounded sample of the documents, and kept with the index.

Defined results: digests count however they are written (case, white space, a prefix), null or malformed ones never; null
texts and texts under MIN_WORDS words are similar to nothing; rows of one pending_id are one record; a null batch_id comes
before all others; files without pending rows are left out; empty tables give no rows.
"""

from __future__ import annotations

import io
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import BROADCAST_ROWS, cut, names_in, parts, read_bytes, remove, shared_dir, small, write_bytes
from .cells import Cells
from .graph import beam_search, build, entry_points, nearest
from .near import MIN_WORDS, shingle_set
from .ragged import flat, pack, runs, unpack
from .vectors import cells_of

BITS, SHINGLE = 64, 3
#: Documents that the cells are fitted on: so many, so many for each cell, and at most.
FIT_ROWS, FIT_EACH, FIT_MOST = 20_000, 32, 200_000
#: Queries put together for a shard; a shard is made for this many rows at most, times 1.5.
QUERY_ROWS = 4096
#: Neighbours chosen at insertion and kept in all, and the beams of building and of asking; ``measure.py`` compares them with
#: exhaustive search.
FORWARD, DEGREE, BUILD_WIDTH, WIDTH = 12, 24, 24, 48
#: Cells asked: at most PROBES, whose centroids are within MARGIN of the nearest. Texts as similar as 0.8 have a cosine near 0.89.
PROBES, MARGIN, FLOOR = 8, 0.15, 0.6
FAN_IN = 4
#: A batch of so few records is marked by one task. It changes no result.
ONE_TASK = 5000
RECORD = "id long, batch long, sha string, w string, v binary"
KEY = "key string, first long"
SHARD = "start long, size long, cell long, sub long, ids binary, v binary, graph binary"


def digest(sha: Column) -> Column:
    """64 hex digits of a SHA-256 in whatever spelling, else null."""
    hexes = F.regexp_replace(F.regexp_replace(F.lower(sha), "^\\W*sha-?_?256\\W*", ""), "[\\s:_-]", "")
    return F.when(hexes.rlike("^[0-9a-f]{64}$"), hexes)


def projections(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors: sums of random signs, one of 64 for each distinct bit of a shingle's hash."""
    h, off = runs(values, offsets, SHINGLE)
    out = np.zeros((len(off) - 1, BITS), np.float32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, off[some], axis=0, dtype=np.int32)
        x = 2.0 * ones - np.diff(off)[some, None]
        out[some] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return out


def segments_before(batch: int, fan_in: int = FAN_IN) -> list[tuple[int, int]]:
    """(start, size) of the segments that hold the batches before this one under the compaction schedule."""
    out, at = [], 0
    while at < batch:
        size = 1
        while at % (size * fan_in) == 0 and at + size * fan_in <= batch:
            size *= fan_in
        out.append((at, size))
        at += size
    return out


#: The segment of the documents.
DOCUMENTS = (-1, 1)


def recorded(rows: DataFrame) -> DataFrame:
    """(id, batch, sha, w, v) from (id, batch, sha, text): w names the sequence of words and v is its vector, both null under MIN_WORDS words."""

    def work(batches):
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                v = pack(projections(*flat(b.column(4))))
                v = v.take(pa.array(np.arange(len(v)), mask=b.column(3).is_null().to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], v], names=["id", "batch", "sha", "w", "v"])

    w = rows.select("id", "batch", "sha", T.word_hashes(F.col("text")).alias("words")).select("id", "batch", "sha", F.when(F.size("words") >= MIN_WORDS, F.col("words")).alias("words"))
    name = F.concat(F.hex(F.xxhash64("words")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "words")))
    return w.select("id", "batch", "sha", F.when(F.col("words").isNotNull(), name).alias("w"), "words").mapInArrow(work, RECORD)


def segment_shards(points: DataFrame, cells: Cells, n: int, segment: tuple[int, int]) -> DataFrame:
    """The shards of n points (id, v) as those of one segment: one row each, with its points and its graph."""
    most = max(QUERY_ROWS, int(1.5 * n / len(cells.share)))
    cells = replace(cells, subs=np.maximum(1, np.ceil(cells.share * n / most)).astype(np.int64))
    ones = np.ones(len(cells.share), np.int64)

    def deal(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                t = b.slice(s, 2000)
                ids, x = t.column(0).to_numpy(), unpack(t.column(1), np.float32, BITS)
                r, cell, sub, *_ = cells.deal(ids, x, ones, ask=False)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sub), pa.array(ids[r]), pack(x[r])], names=["cell", "sub", "id", "v"])

    def work(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), unpack(t.column("v"), np.float32, BITS)
        at = np.unique(ids, return_index=True)[1]
        at = np.random.default_rng(len(at)).permutation(at)
        x, ids = np.ascontiguousarray(x[at]), ids[at]
        graph = build(x, DEGREE, BUILD_WIDTH, choose=nearest, forward=FORWARD)
        kinds = [pa.int64()] * 4 + [pa.binary()] * 3
        values = [*segment, t.column("cell")[0].as_py(), t.column("sub")[0].as_py(), ids.tobytes(), x.tobytes(), graph.tobytes()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["start", "size", "cell", "sub", "ids", "v", "graph"])

    # a task for about each shard, fewer where shards are small
    tasks = max(1, min(20_000, int(cells.subs.sum()), -(-n // 500)))
    dealt = points.mapInArrow(deal, "cell long, sub long, id long, v binary")
    return dealt.repartition(tasks, "cell", "sub").groupBy("cell", "sub").applyInArrow(work, SHARD)


def ask_shards(shards: DataFrame, points: DataFrame, cells: Cells, n: int, own: int, floor: float = FLOOR, width: int = WIDTH) -> DataFrame:
    """(id, met, cosine): what n points (id, v) meet in the shards; of the segment that starts with ``own`` only smaller ids.

    The queries of a cell are put together; where all of them are few they are sent to where the shards lie.
    """
    salts = cells.salts(n, QUERY_ROWS)

    def deal(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                t = b.slice(s, 2000)
                ids, x = t.column(0).to_numpy(), unpack(t.column(1), np.float32, BITS)
                near, ok = cells.near(x)
                r, j = np.nonzero(ok)
                cell = near[r, j]
                salt = (ids[r].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % salts[cell].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(salt.astype(np.int64)), pa.array(ids[r]), pack(x[r])], names=["cell", "salt", "id", "v"])

    def together(t: pa.Table) -> pa.Table:
        ids, x = t.column("id").to_numpy(), unpack(t.column("v"), np.float32, BITS)
        at = np.unique(ids, return_index=True)[1]
        values = [t.column("cell")[0].as_py(), ids[at].tobytes(), np.ascontiguousarray(x[at]).tobytes()]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int64(), pa.binary(), pa.binary()))], names=["cell", "q", "qv"])

    def search(batches):
        for b in batches:
            cols = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for k in range(b.num_rows):
                ids, q = (np.frombuffer(cols[c][k].as_py(), np.int64) for c in ("ids", "q"))
                x, qv = (np.frombuffer(cols[c][k].as_py(), np.float32).reshape(-1, BITS) for c in ("v", "qv"))
                graph = np.frombuffer(cols["graph"][k].as_py(), np.int32).reshape(len(x), -1)
                i, s = beam_search(x, graph, qv, width, entry_points(len(x)))
                r, c = np.nonzero((i >= 0) & (s >= floor))
                met = ids[i[r, c]]
                keep = met < q[r] if cols["start"][k].as_py() == own else np.ones(len(r), bool)
                yield pa.RecordBatch.from_arrays([pa.array(q[r][keep]), pa.array(met[keep]), pa.array(s[r, c][keep].astype(np.float64))], names=["id", "met", "cosine"])

    tasks = max(1, min(parts(points.sparkSession), int(salts.sum()), -(-n // 500)))
    asked = points.mapInArrow(deal, "cell long, salt long, id long, v binary").repartition(tasks, "cell", "salt").groupBy("cell", "salt").applyInArrow(together, "cell long, q binary, qv binary")
    asked = F.broadcast(asked) if n * cells.most <= BROADCAST_ROWS // 2 else asked  # each asks no more cells, with 264 bytes
    return shards.join(asked, "cell").mapInArrow(search, "id long, met long, cosine double")


class HistoryIndex:
    """The index in a folder. ``segments`` has the folder of each (start, size); ``next`` is the number the next batch gets."""

    def __init__(self, spark: SparkSession, path: str):
        """Opens the index as its newest manifest tells it."""
        self.spark, self.path = spark, path.rstrip("/")
        known = [n for n in names_in(spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        if not known:
            raise FileNotFoundError(f"no index in {path}")
        state = json.loads(read_bytes(spark, f"{self.path}/{known[-1]}"))
        self.step, self.next = state["step"], state["next"]
        self.pool, self.open, self.spent = ThreadPoolExecutor(3), [], []
        self.segments = {(a, b): at for a, b, at in state["segments"]}
        with np.load(io.BytesIO(read_bytes(spark, f"{self.path}/cells.npz"))) as z:
            self.cells = Cells(z["centroids"], z["begin"], z["share"], z["asked"], np.ones(len(z["share"]), np.int64), int(z["most"]), float(z["margin"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, cells: Cells) -> HistoryIndex:
        path, out = path.rstrip("/"), io.BytesIO()
        np.savez(out, centroids=cells.centroids, begin=cells.begin, share=cells.share, asked=cells.asked, most=cells.most, margin=cells.margin)
        write_bytes(spark, f"{path}/cells.npz", out.getvalue())
        write_bytes(spark, f"{path}/manifest-00000000.json", json.dumps({"step": 0, "next": DOCUMENTS[0], "segments": []}).encode())
        return cls(spark, path)

    def _commit(self, segments: dict, following: int) -> None:
        state = {"step": self.step + 1, "next": following, "segments": [[*k, at] for k, at in segments.items()]}
        write_bytes(self.spark, f"{self.path}/manifest-{self.step + 1:08d}.json", json.dumps(state).encode())
        self.step, self.next, self.segments = self.step + 1, following, segments

    def _folder(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/segment-{segment[0]}-{segment[1]}-{uuid.uuid4().hex[:8]}"

    def _read(self, what: str, schema: str, of: dict) -> DataFrame:
        if not of:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{at}/{what}" for at in of.values()))

    def take(self, records: DataFrame, out: str | None = None, wait: bool = True, n: int | None = None) -> None:
        """Takes a batch (id, sha, w, v) in as the next segment. With ``out``, appends to out/told (id, exact, same) the records
        whose digest or words a record before has, and to out/met (id, met, cosine) what the others' texts are near to; without
        ``wait`` that may still go on when the next batch is taken, up to ``settle``. ``n``: the number of records, if it is known."""
        segment = (self.next, 1)
        folder = self._folder(segment)
        held = records.select("id", "sha", "w", "v")
        n = held.count() if n is None else n
        if n <= ONE_TASK:
            held = held.coalesce(1)
        hint = F.broadcast if n <= BROADCAST_ROWS // 16 else (lambda df: df)  # a record has at most two keys of 80 characters, a segment a key once
        keys = held.select("id", F.explode(F.array_compact(F.array(F.concat(F.lit("d"), "sha"), F.concat(F.lit("w"), "w")))).alias("key"))
        firsts = keys.groupBy("key").agg(F.min("id").alias("first"))
        written = self.pool.submit(firsts.write.option("compression", "zstd").parquet, f"{folder}/keys")
        repeated = keys.join(hint(firsts), "key")
        if self.segments:
            old = self._read("keys", KEY, self.segments).join(hint(firsts.select("key")), "key", "left_semi").select("key", F.lit(True).alias("old"))
            repeated = repeated.join(hint(old), "key", "left").where("old or id <> first")
        else:
            repeated = repeated.where("id <> first")
        told = repeated.groupBy("id").agg(F.max(F.col("key").startswith("d")).alias("exact"), F.max(F.col("key").startswith("w")).alias("same"))
        marked = held.join(hint(told), "id", "left").select("id", "exact", "same", F.when(F.col("same").isNull() | ~F.col("same"), F.col("v")).alias("v"))
        marked.where("v is not null or exact or same").write.option("compression", "zstd").parquet(f"{folder}/taken")
        taken = self.spark.read.schema("id long, exact boolean, same boolean, v binary").parquet(f"{folder}/taken")
        points = taken.where("v is not null").select("id", "v")
        segment_shards(points, self.cells, n, segment).write.option("compression", "none").parquet(f"{folder}/shards")
        written.result()
        segments = {**self.segments, segment: folder}
        if out:
            shards = self._read("shards", SHARD, segments)
            self.open.append(self.pool.submit(taken.where("exact or same").select("id", "exact", "same").write.parquet, f"{out}/told/{segment[0]}"))
            self.open.append(self.pool.submit(ask_shards(shards, points, self.cells, n, segment[0]).write.parquet, f"{out}/met/{segment[0]}"))
        self.spent.append(f"{folder}/taken")
        self._commit(segments, self.next + 1)
        if wait:
            self.settle()
        self.compact()

    def settle(self) -> None:
        """Waits for what is still being asked."""
        while self.open:
            self.open.pop().result()
        while self.spent:
            remove(self.spark, self.spent.pop())

    def compact(self, fan_in: int = FAN_IN) -> None:
        """Joins every complete group of fan_in neighbouring segments of one size, until there is none. The documents' segment stays."""
        while True:
            groups: dict = {}
            for start, size in self.segments:
                if start >= 0:
                    groups.setdefault((start // (size * fan_in), size), []).append((start, size))
            full = [sorted(g) for g in groups.values() if len(g) == fan_in]
            if not full:
                return
            for g in full:
                self._join(g)

    def _join(self, g: list[tuple[int, int]]) -> None:
        def unroll(batches):
            for b in batches:
                for ids, v in zip(*(b.column(c).to_pylist() for c in range(2))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pack(np.frombuffer(v, np.float32).reshape(-1, BITS))], names=["id", "v"])

        old = {s: self.segments[s] for s in g}
        new = (g[0][0], g[0][1] * len(g))
        folder = self._folder(new)
        shards = self._read("shards", SHARD, old)
        n = shards.select(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 8).first()[0]
        points = shards.select("ids", "v").mapInArrow(unroll, "id long, v binary")
        segment_shards(points, self.cells, int(n), new).write.option("compression", "none").parquet(f"{folder}/shards")
        keys = self._read("keys", KEY, old)
        keys.groupBy("key").agg(F.min("first").alias("first")).coalesce(max(1, min(parts(self.spark), int(n) // 100_000))).write.option("compression", "zstd").parquet(f"{folder}/keys")
        self._commit({**{s: at for s, at in self.segments.items() if s not in old}, new: folder}, self.next)
        self.settle()  # what is asked reads the old segments
        for at in old.values():
            remove(self.spark, at)
        self.spark._jvm.System.gc()  # what many small jobs have sent to the executors is freed there when its owner is collected here


def cells_for(points: DataFrame, n: int) -> Cells:
    """Cells for an index of about n points (v), fitted on a bounded sample of them."""
    many = cells_of(n)
    want = min(FIT_MOST, max(FIT_ROWS, FIT_EACH * many))
    x = unpack(points.select("v").sample(min(1.0, 1.2 * want / max(1, n)), seed=5).limit(want).toArrow().column(0), np.float32, BITS)
    return Cells.of(x if len(x) else np.eye(1, BITS, dtype=np.float32), max(n, 1), many, PROBES, MARGIN)


def records(pending: DataFrame) -> DataFrame:
    """One row for each pending_id: its batch and digest."""
    return pending.where("pending_id is not null").groupBy(F.col("pending_id").cast("long").alias("pending_id")).agg(
        F.coalesce(F.min("batch_id").cast("long"), F.lit(-(2**20)).cast("long")).alias("batch_id"), F.max(digest(F.col("sha256"))).alias("sha")
    )


def exact_near(met: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """id of the (id, met) whose texts are similar; texts: (id, text), of which only the needed ones are read into sets."""
    needed = small(cut(met.select(F.explode(F.array("id", "met")).alias("id")).distinct()))
    held = texts.where("text is not null").join(needed, "id", "left_semi")
    sets = cut(held.select("id", T.word_hashes(F.col("text")).alias("w")).select("id", shingle_set(F.col("w")).alias("s")))
    pairs = met.join(sets.select("id", F.col("s").alias("sb")), "id").join(sets.select(F.col("id").alias("met"), F.col("s").alias("sa")), "met")
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.select("id", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("ab")).where(F.col("ab") >= (F.col("na") + F.col("nb") - F.col("ab")) * threshold - 1e-9)
    return near.select("id").distinct()


def found(documents: DataFrame, pending: DataFrame, staged: DataFrame, threshold: float = 0.8, path: str | None = None) -> DataFrame:
    """(pending_id, kind): exact or near, one row for each file that repeats something.

    The index is built in ``path``: the documents first, then batch by batch in order; without one it is built in the shared
    folder and removed after the last batch.
    """
    spark = documents.sparkSession
    files = cut(records(pending))
    batches = {r[0]: r[1] for r in files.groupBy("batch_id").count().orderBy("batch_id").collect()}  # two numbers for each batch
    empty = spark.createDataFrame([], "pending_id long, kind string")
    if not batches:
        return empty
    kept = path is not None
    path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    docs = documents.where("doc_id is not null").select(F.shiftleft(F.col("doc_id").cast("long"), 1).alias("id"), F.lit(DOCUMENTS[0]).cast("long").alias("batch"), digest(F.col("sha256")).alias("sha"), "text")
    told = staged.select(F.col("pending_id").cast("long").alias("pending_id"), "text").where("text is not null and pending_id is not null").dropDuplicates(["pending_id"])
    new = files.join(told, "pending_id", "left").select((F.shiftleft("pending_id", 1) + 1).alias("id"), F.col("batch_id").alias("batch"), "sha", "text")

    accepted = cut(recorded(docs))
    # a batch is a folder of its own, of a few files, so that to take it no other is read
    coming = cut(recorded(new).repartition(parts(spark), "batch", F.pmod(F.xxhash64("id"), F.lit(4))), ["batch"])
    points = accepted.where("v is not null")
    index = HistoryIndex.create(spark, f"{path}/index", cells_for(points, points.count()))
    index.take(accepted)
    for b, n in batches.items():
        index.take(coming.where(F.col("batch") == b), f"{path}/out", wait=False, n=n)
    index.settle()
    if not kept:
        remove(spark, f"{path}/index")

    told = spark.read.schema("id long, exact boolean, same boolean").option("recursiveFileLookup", "true").parquet(f"{path}/out/told")
    met = spark.read.schema("id long, met long, cosine double").option("recursiveFileLookup", "true").parquet(f"{path}/out/met").select("id", "met").distinct()
    near = exact_near(cut(met), docs.select("id", "text").unionByName(new.select("id", "text")), threshold)
    kinds = told.select("id", F.when(F.col("exact"), 0).otherwise(1).alias("k")).union(near.select("id", F.lit(1)))
    best = kinds.groupBy("id").agg(F.min("k").alias("k"))
    return best.select(F.shiftright("id", 1).alias("pending_id"), F.when(F.col("k") == 0, "exact").otherwise("near").alias("kind"))
