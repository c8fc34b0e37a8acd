"""Near duplicates by SetSketch registers.

Every text becomes the set of its distinct 5-word shingles, and the set becomes `REGISTERS`
registers: register i holds the smallest of exponentially spaced values over the set, truncated to an
integer power of `SPACING` (Ertl 2021). Registers of two sets merge by maximum; equal positions grow
likelier with similarity. Bands of registers give candidates, a likelihood estimate over the
registers drops those far below the threshold, and full sets decide the rest exactly.

Equal sets fold into one class first. Within a band bucket nobody is paired with everybody: each round
compares one leader per bucket, the member with most links so far, with the members of other components, what is linked is one component
from then on, and only members of different components are compared at the end, in large buckets block by block.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, work_path
from .graph import components
from .joins import counted
from .tokens import mix, slabs

WORDS = 5
SPACING = 1.001
RATE = 20.0
TOP = 65_534
ROWS, BANDS = 4, 32
REGISTERS = ROWS * BANDS
STARS = 1  # rounds of leaders before all that is open gets compared
BLOCK = 256  # members of a large bucket that one task compares with as many others
ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) | np.uint64(1)
ADD = mix(np.arange(1001, REGISTERS + 1001, dtype=np.uint64))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes; the empty set has zeros."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    low = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(shingles), 512):
        part = shingles[i : i + 512]
        np.minimum(low, (ODD[:, None] * part[None, :] + ADD[:, None]).min(axis=1), out=low)
    u = (low >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54
    value = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(SPACING))
    return np.clip(value, 0, TOP + 1).astype(np.uint16)


def shingle_sets(words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text has its whole sequence as the only one."""
    starts, hashes = words.windows(WORDS)
    cut = np.searchsorted(starts, words.first)
    out = []
    for i in range(words.texts.n):
        if words.count[i] >= WORDS:
            out.append(np.unique(hashes[cut[i] : cut[i + 1]]))
        elif words.count[i]:
            seq = words.hash[words.first[i] : words.first[i + 1]]
            value = np.uint64(len(seq))
            with np.errstate(over="ignore"):
                for w in seq:
                    value = mix(np.array([value * np.uint64(31) + w]))[0]
            out.append(np.array([value], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SKETCH = "doc_id long, tid long, n_shingles long, key binary, regs binary, bands array<long>"


def _sketch(batches):
    for batch in batches:
        ids, tids = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tid"))
        for lo, hi, texts in slabs(batch, fold=True):
            keys, regs, bands, sizes = [], [], [], []
            for s in shingle_sets(texts.words()):
                r = registers(s)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(r.tobytes())
                rows = r.reshape(BANDS, ROWS).astype(np.uint64)
                code = (rows[:, 0] << np.uint64(48)) | (rows[:, 1] << np.uint64(32)) | (rows[:, 2] << np.uint64(16)) | rows[:, 3]
                bands.append(mix(code + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    tids.slice(lo, hi - lo),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(regs, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), flat),
                ],
                names=["doc_id", "tid", "n_shingles", "key", "regs", "bands"],
            )


def _sets(batches):
    for batch in batches:
        for lo, hi, texts in slabs(batch, fold=True):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(texts.words())]
            keys = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "full"])


def estimate(n1: np.ndarray, n2: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Likeliest similarity, given both set sizes and how many registers are greater, smaller and equal."""
    share = n1 / (n1 + n2)
    grid = np.linspace(0, 1, 101)[None, :] * (np.minimum(n1, n2) / np.maximum(n1, n2))[:, None]
    step = (SPACING - 1) / SPACING
    ahead = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * step) / np.log(SPACING)
    p = ahead(share[:, None] - (1 - share)[:, None] * grid)
    q = ahead((1 - share)[:, None] - share[:, None] * grid)
    rest = np.clip(1 - p - q, 1e-12, 1)
    score = more[:, None] * np.log(p) + less[:, None] * np.log(q) + equal[:, None] * np.log(rest)
    return np.take_along_axis(grid, score.argmax(axis=1)[:, None], axis=1)[:, 0]


def _likely(floor: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b")]
            n1, n2 = (np.asarray(col[c]).astype(float) for c in ("n_a", "n_b"))
            more, less = (regs[0] > regs[1]).sum(axis=1), (regs[0] < regs[1]).sum(axis=1)
            fit = estimate(n1, n2, more, less, REGISTERS - more - less) >= floor
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(fit))

    return run


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            fit = []
            for x, y in zip(col["full_a"], col["full_b"]):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                fit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return run


def _compare(percent: int, columns: int = 4_096):
    """Of one pair of blocks the links between different components; shared shingles are counted by matrix products."""
    shape = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(rows):
        own, i, j = (np.asarray(rows[c]) for c in ("own", "i", "j"))
        comps, keys = rows["comp"].to_pylist(), rows["key"].to_pylist()
        sets = [np.frombuffer(f.as_buffer(), "<u8") for f in rows["full"]]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return shape.empty_table()
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
            a, b = np.searchsorted(column, [lo, lo + columns])
            have = np.zeros((len(sets), columns), np.float32)
            have[row[a:b], column[a:b] - lo] = 1
            both += have[left] @ have[right].T
        joint = size[left][:, None] + size[right][None, :] - both
        pairs = [(keys[left[x]], keys[right[y]]) for x, y in np.argwhere(100 * both >= percent * joint) if comps[left[x]] != comps[right[y]]]
        a, b = [min(p) for p in pairs], [max(p) for p in pairs]
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=shape)

    return run


class NearDuplicates:
    """Links and components of `docs` (doc_id, text) at `percent` of the union.

    Texts that are null or without words are in no class and linked with nothing. Rows with equal ids
    or equal texts are rows like any other; null ids are left out when the smallest id is taken.
    """

    def __init__(self, docs: DataFrame, percent: int = 75, margin: float = 0.2):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
        self.percent, self.floor = percent, percent / 100 - margin
        spark = docs.sparkSession
        path = work_path(spark, "sketches")
        self.docs.mapInArrow(_sketch, SKETCH).write.parquet(path)
        self.rows = spark.read.parquet(path)
        path = work_path(spark, "classes")
        self._classes(path)
        self.classes = spark.read.parquet(path)

    def _classes(self, path: str) -> None:
        (
            self.rows.where("key IS NOT NULL")
            .groupBy("key")
            .agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "tid")).alias("one"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
            .write.parquet(path)
        )

    def buckets(self) -> DataFrame:
        """(bucket, key) of all band buckets with two classes or more."""
        every = self.classes.select(F.explode("bands").alias("bucket"), "key")
        shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
        return every.join(shared.hint("merge"), "bucket")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of class keys those whose full sets reach the threshold."""
        spark = self.docs.sparkSession
        regs = self.classes.select("key", "n", "regs")
        side = lambda x: regs.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b")
        sized = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent)
        likely = materialize(sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(_likely(self.floor), "a binary, b binary"))
        nodes = likely.select(F.col("a").alias("key")).unionByName(likely.select(F.col("b").alias("key"))).distinct()
        full = self._full(nodes)
        side = lambda x: full.select(F.col("key").alias(x), F.col("full").alias(f"full_{x}"))
        both = likely.join(side("a"), "a").join(side("b"), "b").select("a", "b", "full_a", "full_b")
        return materialize(both.mapInArrow(_exact(self.percent), "a binary, b binary"))

    def _full(self, nodes: DataFrame) -> DataFrame:
        """(key, full): the whole sets of some classes."""
        wanted = self.classes.select("key", F.col("one.doc_id").alias("w_id"), F.col("one.tid").alias("w_tid")).join(nodes, "key", "left_semi")
        # the text that stands for each class, by its id and hash
        texts = self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tid") == F.col("w_tid"))).select("key", "text")
        path = work_path(self.docs.sparkSession, "sets")
        texts.mapInArrow(_sets, "key binary, full binary").write.parquet(path)
        return self.docs.sparkSession.read.parquet(path).dropDuplicates(["key"])

    def _blocks(self, live: DataFrame) -> DataFrame:
        """Links between components within large buckets: blocks of members against blocks of members."""
        sizes = live.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        rows = live.join(sizes.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        rows = rows.select("bucket", "key", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        rows = rows.select("bucket", "key", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        rows = rows.join(self._full(live.select("key").distinct()).hint("merge"), "key")
        tasks = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = rows.repartition(tasks, "bucket", "i", "j").groupBy("bucket", "i", "j").applyInArrow(_compare(self.percent), "a binary, b binary")
        return materialize(found.distinct())

    def links(self) -> DataFrame:
        """Verified pairs (a, b) of class keys that join all that belongs together."""
        buckets = materialize(self.buckets())
        found = None
        live = buckets.withColumn("comp", F.col("key"))
        for turn in range(STARS + 1):
            if turn:
                label = components(found).select(F.col("node").alias("key"), "root")
                named = buckets.join(label, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("comp"))
                mixed = named.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y")
                live = materialize(named.join(mixed.select("bucket", "n").hint("merge"), "bucket"))
            if turn == STARS:
                break
            # the member with most links so far is the likeliest centre of a group
            ranked = live.withColumn("links", F.lit(0).cast("long"))
            if turn:
                ends = found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
                ranked = live.join(ends, "key", "left").withColumn("links", F.coalesce("links", F.lit(0)))
            pick = F.struct((-F.col("links")).alias("links"), F.xxhash64("key", F.lit(turn)).alias("o"), "key", "comp")
            leader = ranked.groupBy("bucket").agg(F.min(pick).alias("l")).select("bucket", "l.key", "l.comp").toDF("bucket", "lead", "lead_comp")
            met = live.join(leader.hint("merge"), "bucket").where("comp <> lead_comp").select("key", "lead")
            more = self.verified(self._pairs(met))
            found = more if found is None else found.unionByName(more)
        # what is still open within buckets: pair by pair in small ones, block by block in large ones
        small = live.where(F.col("n") <= BLOCK // 4)
        other = small.select("bucket", F.col("key").alias("lead"), F.col("comp").alias("lead_comp"))
        met = small.join(other.hint("merge"), "bucket").where("comp < lead_comp").select("key", "lead")
        return found.unionByName(self.verified(self._pairs(met))).unionByName(self._blocks(live.where(F.col("n") > BLOCK // 4)))

    @staticmethod
    def _pairs(met: DataFrame) -> DataFrame:
        return materialize(met.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct())

    def components(self) -> DataFrame:
        """One row per document: doc_id, tid (hash of the text), n_shingles, component_id, kept.

        A row without an id is kept only if its whole component has none.
        """
        roots = components(self.links())
        named = self.classes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left")
        named = named.select("key", "doc_id", F.coalesce("root", "key").alias("root"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        ids = named.join(least, "root").select("key", "component_id")
        out = self.rows.select("doc_id", "tid", "n_shingles", "key").join(ids.hint("merge"), "key", "left")
        component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return out.select("doc_id", "tid", "n_shingles", component.alias("component_id")).withColumn(
            "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
        )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    return NearDuplicates(docs, percent).components().drop("tid")


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id; all columns stay.

    Of rows that agree in id and text one stays.
    """
    rows = materialize(NearDuplicates(docs, percent).components().select(F.col("doc_id").alias("_llm_id"), F.col("tid").alias("_llm_tid"), "kept"))
    gone = materialize(rows.where("not kept").select("_llm_id", "_llm_tid").distinct())
    twice = materialize(rows.where("kept").groupBy("_llm_id", "_llm_tid").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    keyed = docs.withColumn("_llm_key", F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_tid"))
    left = keyed.join(counted(gone), same, "left_anti")
    if not twice.isEmpty():
        few = counted(twice)
        left = left.join(few, same, "left_anti").unionByName(left.join(few, same, "left_semi").dropDuplicates(["doc_id", "_llm_key"]))
    return left.select(*docs.columns)
