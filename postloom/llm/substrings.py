"""Word passages that repeat anywhere in the corpus, by a suffix tree cut at the window's depth.

The suffixes of all texts, as word sequences, are split by prefixes of growing length. A suffix whose
prefix nobody else has leaves the tree. First step: prefixes of `PREFIX` words, looked at only where
they are the least of a window (minimisers), because two equal windows have the same least prefix at
the same place; this drops almost all suffixes for a tenth of the rows. Second step: what is left
grows to the full depth of `DEPTH` words. A node is named by 96 bits, two hashes of its path (their polynomials run over
different values of the words). A node at that depth with two leaves or more is a repeated window; leaves are counted before the shuffle, so a passage that a third of all texts share is one
row per task. Runs of repeated windows in one text are its maximal repeated stretches.

Equal texts fold first: one stands for all, and its leaves count double.
"""

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, tidied, work_path
from .joins import counted
from .tokens import mix, rolling, signed, slabs

DEPTH = 35
PREFIX = 8


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each `width` neighbours, by doubling."""
    pick = np.minimum if least else np.maximum
    have, out = 1, values
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[:-rest], out[rest:]) if rest else out


def _anchors(words, depth: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the prefixes that are the least of a window."""
    n = len(words.hash)
    if n < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, hashes = words.windows(prefix)
    grams = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    grams[starts] = np.maximum(hashes, np.uint64(1))
    width = depth - prefix + 1
    low = _sliding(grams[: n - prefix + 1], width, True)  # one for each window, by its start
    ends = np.repeat(words.first[1:], words.count)
    low[np.arange(len(low)) + depth > ends[: len(low)]] = 0  # not within one text
    pad = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([pad, low, pad]), width, False)
    at = np.flatnonzero(best == grams[: len(best)])
    return at, grams[at]


def _each(batch):
    """(lo, hi, texts) and the columns but the text."""
    other = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"}
    for lo, hi, texts in slabs(batch, fold=False):
        yield texts, {n: c.slice(lo, hi - lo) for n, c in other.items()}


def _find_anchors(depth, prefix):
    def run(batches):
        for batch in batches:
            for texts, cols in _each(batch):
                words = texts.words()
                at, keys = _anchors(words, depth, prefix)
                of = words.text_of()[at]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys)), *[cols[c].take(take) for c in ("t1", "t2", "leaves")], pa.array((at - words.first[of]).astype(np.int32))],
                    names=["p", "t1", "t2", "leaves", "at"],
                )

    return run


def _find_windows(depth, prefix):
    def run(batches):
        for batch in batches:
            for texts, cols in _each(batch):
                words = texts.words()
                marks = cols["anchors"].combine_chunks() if isinstance(cols["anchors"], pa.ChunkedArray) else cols["anchors"]
                lens = np.diff(np.asarray(marks.offsets))
                own = np.repeat(np.arange(texts.n), lens)
                at = np.asarray(marks.flatten()) + words.first[own]
                delta = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(delta, np.maximum(at - (depth - prefix), words.first[own]), 1)
                np.add.at(delta, at + 1, -1)
                near = np.cumsum(delta)[:-1] > 0
                starts, keys = words.windows(depth)
                keep = near[starts]
                starts, keys = starts[keep], keys[keep]
                more = rolling(mix(words.hash), starts, starts + depth)
                of = words.text_of()[starts]
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(keys)), pa.array(more.astype(np.uint32).view(np.int32)), *[cols[c].take(take) for c in ("num", "leaves")], pa.array((starts - words.first[of]).astype(np.int32))],
                    names=["node", "more", "num", "leaves", "at"],
                )

    return run


def _runs(depth):
    """Starts of repeated windows -> begin and end (exclusive) of the stretches of words they cover."""

    def run(batches):
        for batch in batches:
            begins, ends = [], []
            for x in batch.column(1):
                at = np.unique(np.frombuffer(x.values.buffers()[1], np.int32)[x.values.offset : x.values.offset + len(x.values)])
                cut = np.flatnonzero(np.diff(at) > depth)
                begins.append(at[np.concatenate([[0], cut + 1])].tolist())
                ends.append((at[np.concatenate([cut, [len(at) - 1]])] + depth).tolist())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begins, ints), pa.array(ends, ints)], names=["num", "begins", "ends"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _same(a: DataFrame, small: DataFrame, how: str) -> DataFrame:
    return a.join(small, ["t1", "t2"], how)


def repeated_spans(docs: DataFrame, depth: int = DEPTH, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """Two tables by text hashes (t1, t2): texts that occur more than once, and for all others the
    stretches `begins`, `ends` (word numbers) that repeated windows cover."""
    keyed = _keyed(docs)
    many = materialize(keyed.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1").select("t1", "t2"))
    few = counted(many)
    one = _same(keyed.select("t1", "t2", "text"), few, "left_anti").withColumn("leaves", F.lit(1))
    folded = _same(keyed.select("t1", "t2", "text"), few, "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = one.unionByName(folded.withColumn("leaves", F.lit(2)))

    anchors = texts.mapInArrow(_find_anchors(depth, prefix), "p long, t1 long, t2 long, leaves int, at int")
    # tables of their own: a join whose sides are both plain shuffles can have its hot keys split
    shared = materialize(anchors.groupBy("p").agg(F.sum("leaves").alias("n")).where("n > 1").select("p"))
    live = anchors.join(shared.hint("merge"), "p").groupBy("t1", "t2").agg(F.collect_list("at").alias("anchors"))
    # a number for each text, as windows are many; it is fixed by being written down
    live = materialize(live.withColumn("num", F.monotonically_increasing_id()))
    near = _same(texts, live.hint("merge"), "inner").select("num", "leaves", "anchors", "text")
    # written once, as they weigh less than the texts, which would move again for a second reading
    path = work_path(docs.sparkSession, "windows")
    kinds = "node long, more int, num long, leaves int, at int"
    near.mapInArrow(_find_windows(depth, prefix), kinds).write.parquet(path)
    windows = docs.sparkSession.read.schema(kinds).parquet(path)
    nodes = materialize(windows.groupBy("node", "more").agg(F.sum("leaves").alias("n")).where("n > 1").select("node", "more"))
    hit = windows.where("leaves = 1").join(nodes.hint("merge"), ["node", "more"]).groupBy("num").agg(F.collect_list("at").alias("starts"))
    spans = hit.mapInArrow(_runs(depth), "num long, begins array<int>, ends array<int>")
    return many, materialize(spans.join(live.select("num", "t1", "t2"), "num").drop("num"))


def _keep(depth):
    def run(batches):
        for batch in batches:
            for texts, cols in _each(batch):
                size, gone, digest = [], [], []
                data = texts.data.tobytes()
                for i in range(texts.n):
                    words = data[texts.at[i] : texts.at[i + 1]].split()
                    n = len(words)
                    if cols["copied"][i].as_py() and n >= depth:
                        words = []
                    elif cols["begins"][i].is_valid:
                        keep = np.ones(n, bool)
                        for a, b in zip(cols["begins"][i].as_py(), cols["ends"][i].as_py()):
                            keep[a:b] = False
                        words = list(compress(words, keep))
                    size.append(n)
                    gone.append(n - len(words))
                    digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [cols["doc_id"], pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return run


def dedup_substrings(docs: DataFrame, depth: int = DEPTH, prefix: int = PREFIX) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256 of the words left, joined by one space.

    A word goes if a window of `depth` words around it starts anywhere else too. Null texts have no
    words; texts below `depth` words lose none; repeated rows are elsewhere to each other.
    """
    with tidied(docs.sparkSession):
        many, spans = repeated_spans(docs, depth, prefix)
    rows = _same(_keyed(docs), counted(many.withColumn("copied", F.lit(True))), "left")
    rows = _same(rows, spans.hint("merge"), "left")
    rows = rows.select("doc_id", F.coalesce("copied", F.lit(False)).alias("copied"), "begins", "ends", "text")
    return rows.mapInArrow(_keep(depth), "doc_id long, n_words long, n_removed long, kept_sha256 string")
