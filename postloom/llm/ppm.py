"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The model is a trie of byte contexts up to `ORDER` bytes with counts over all training texts. A
symbol that a context has seen t times out of T, with d different symbols, gets t / (T + d); what is
left, d / (T + d), is the escape (method C) to the context one byte shorter, where all symbols that the
longer one knows are excluded. Below the empty context all remaining bytes are equal. A text is
preceded and followed by byte 0xFF, which UTF-8 never has.

A run of bytes of length ORDER + 1 determines its own probability, so the corpus needs one row per
distinct run. The scan is cut into blocks of `BLOCK_ROWS` neighbouring rows; each block lists its distinct
runs and words with their training counts, counts are summed over all blocks, every run is
scored by joins along the trie, and each block gets back exactly what it asked for. So neither the trie nor the
vocabulary is held anywhere as a whole.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, work_path
from .tokens import FOLD, slabs

ORDER = 3
EDGE = 0xFF
BLOCK_ROWS = 4_096
TALLY_BYTES = 1 << 20  # text that is counted at once; fewer, larger tallies hold fewer repeats


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """All runs of ORDER + 1 bytes, one for each byte and each end, as numbers, and the texts' shares of them."""
    size = np.diff(texts.at)
    at = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
    data = np.full(at[-1], EDGE, np.uint8)
    place = np.arange(len(texts.data)) + np.repeat(at[:-1] + ORDER - texts.at[:-1], size)
    data[place] = texts.data
    wide = data.astype(np.uint32)
    code = np.zeros(max(0, len(data) - ORDER), np.uint32)
    for j in range(ORDER + 1):
        code = (code << np.uint32(8)) | wide[j : len(code) + j]
    # the runs that reach into the next text's lead are no runs of this one
    first = np.concatenate([[0], np.cumsum(size + 1)])
    pick = np.arange(first[-1]) + np.repeat(np.arange(texts.n) * ORDER, size + 1)
    return code[pick], first


END_WORD = np.uint64(0)


def _tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by the end token, and where texts begin."""
    words = texts.words()
    first = words.first + np.arange(texts.n + 1)
    out = np.full(first[-1], END_WORD, np.uint64)
    out[np.arange(len(words.hash)) + words.text_of()] = words.hash >> np.uint64(1) | np.uint64(1)
    return out, first


class _Tally:
    """Distinct keys of one block and their counts in training texts."""

    def __init__(self):
        self.keys, self.counts = [], []

    def add(self, keys, weights):
        u, back = np.unique(keys, return_inverse=True)
        self.keys.append(u)
        self.counts.append(np.bincount(back, weights=weights, minlength=len(u)).astype(np.int64))

    def done(self):
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        u, back = np.unique(keys, return_inverse=True)
        return u, np.bincount(back, weights=counts, minlength=len(u)).astype(np.int64)


def _run_key(codes):
    """Runs are negative keys, words positive ones, the end token 0."""
    return -1 - codes.astype(np.int64)


def _requests(batches):
    block, tally = None, None

    def flush():
        keys, counts = tally.done()
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), block, np.int64)), pa.array(k), pa.array(counts[i : i + (1 << 16)])], names=["block", "key", "n"]
            )

    for batch in batches:
        blocks = np.asarray(batch.column(batch.schema.get_field_index("block")))
        train = np.asarray(batch.column(batch.schema.get_field_index("train")).cast(pa.int8()))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]) if len(blocks) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if blocks[a] != block:
                if tally is not None:
                    yield from flush()
                block, tally = blocks[a], _Tally()
            for lo, hi, texts in slabs(batch.slice(a, b - a), fold=False, size=TALLY_BYTES):
                learn = train[a + lo : a + hi]
                runs, first = _bytes_of(texts)
                tally.add(_run_key(runs), np.repeat(learn, np.diff(first)))
            for lo, hi, texts in slabs(batch.slice(a, b - a), fold=True, size=TALLY_BYTES):
                learn = train[a + lo : a + hi]
                tokens, first = _tokens(texts)
                tally.add(tokens.view(np.int64), np.repeat(learn, np.diff(first)))
    if tally is not None:
        yield from flush()


def score_runs(runs: DataFrame) -> DataFrame:
    """(run, lp): log10 probability of the last byte of every run after the bytes before it.

    `runs`: run, n, all distinct runs of ORDER + 1 bytes with their training counts, 0 included.
    """
    grams = [None] * (ORDER + 1)
    grams[ORDER] = runs.where("n > 0").select(F.col("run").alias("g"), "n")
    for k in range(ORDER - 1, -1, -1):  # counts of shorter runs: sums over the byte in front
        grams[k] = materialize(grams[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1)).alias("g")).agg(F.sum("n").alias("n")))
    contexts = []
    for k, g in enumerate(grams):
        c = g.select(F.shiftright("g", 8).alias("c"), "g", "n")
        if k:  # what the next shorter context counts for symbols that this one knows
            low = grams[k - 1].select(F.col("g").alias("low"), F.col("n").alias("low_n"))
            c = c.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(low, "low")
        else:
            c = c.withColumn("low_n", F.lit(0).cast("long"))
        contexts.append(materialize(c.groupBy("c").agg(F.sum("n").alias(f"t{k}"), F.count("*").alias(f"d{k}"), F.sum("low_n").alias(f"x{k}"))))
    out = runs.select("run")
    for k in range(ORDER, -1, -1):
        gram = F.col("run").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))
        out = out.withColumn("g", gram).join(grams[k].select("g", F.col("n").alias(f"n{k}")), "g", "left")
        out = out.withColumn("c", F.shiftright("g", 8)).join(contexts[k], "c", "left").drop("c", "g")
    # walk down: `known` symbols are excluded, with `gone` of the context's count
    lp = None
    before = F.lit(0.0)
    known, gone = F.lit(0), F.lit(0)
    for k in range(ORDER, -1, -1):
        total = F.coalesce(F.col(f"t{k}"), F.lit(0)) - gone
        kinds = F.coalesce(F.col(f"d{k}"), F.lit(0)) - known
        seen = F.col(f"n{k}").isNotNull()
        hit = before + F.log10(F.col(f"n{k}") / (total + kinds))
        lp = F.when(seen, hit) if lp is None else lp.when(seen, hit)
        # a context never met, or without anything left, escapes for certain
        before = before + F.when(total + kinds > 0, F.log10(F.when(kinds > 0, kinds).otherwise(F.lit(1)) / (total + kinds))).otherwise(0.0)
        known, gone = F.coalesce(F.col(f"d{k}"), F.lit(0)), F.coalesce(F.col(f"x{k}"), F.lit(0))
    lp = lp.otherwise(before - F.log10(F.lit(256) - known))
    return out.select("run", lp.alias("lp"))


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
SCORED = pa.schema(list(zip(NAMES, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()])))


def _scores(total: int):
    """Scores of one block's texts from what the block asked for; `total` is N + V + 1."""

    def run(key, docs, answers):
        keys, values = np.asarray(answers["key"]), np.asarray(answers["value"])
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        done = [SCORED.empty_table()]
        for batch in docs.to_batches():
            for lo, hi, texts in slabs(batch, fold=False):
                runs, first = _bytes_of(texts)
                score = np.add.reduceat(values[np.searchsorted(keys, _run_key(runs))], first[:-1])
                texts.data = FOLD[texts.data]
                tokens, begin = _tokens(texts)
                c = values[np.searchsorted(keys, tokens.view(np.int64))]
                base = np.add.reduceat(np.log10((c + 1) / total), begin[:-1])
                known = np.add.reduceat((c > 0).astype(np.int64), begin[:-1])
                part = [batch.column(batch.schema.get_field_index(n)).slice(lo, hi - lo) for n in NAMES[:2]]
                numbers = [pa.array(x) for x in (np.diff(begin).astype(np.int64), known, base, score)]
                done.append(pa.Table.from_arrays([*part, *numbers], schema=SCORED))
        return pa.concat_tables(done)

    return run


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def score_texts(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    A null text counts as empty: one end token, one end byte. Rows with a null id are learned from.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id()
    blocks = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.shiftright(row, 33).alias("part"), F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block_rows).alias("nth"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).select("doc_id", held_out().alias("held_out"), (F.shiftleft("part", 32) + F.col("nth")).alias("block"), "text")

    path = work_path(spark, "requests")
    asked = blocks.select("block", (~F.col("held_out")).alias("train"), "text")
    asked.mapInArrow(_requests, "block long, key long, n long").write.parquet(path)
    asked = spark.read.parquet(path)

    path = work_path(spark, "counts")
    asked.groupBy("key").agg(F.sum("n").alias("n")).write.parquet(path)
    counts = spark.read.parquet(path)
    sums = counts.where("key >= 0").agg(F.sum("n"), F.count_if(F.col("n") > 0)).head()
    n, v = sums[0] or 0, sums[1] or 0
    runs = materialize(counts.where("key < 0").select((F.lit(-1) - F.col("key")).alias("run"), "n"))
    values = counts.where("key >= 0").select("key", F.col("n").cast("double").alias("value")).unionByName(
        score_runs(runs).select((F.lit(-1) - F.col("run")).alias("key"), F.col("lp").alias("value"))
    )
    answers = asked.select("block", "key").join(values.hint("merge"), "key").select("block", "key", "value")
    scored = (
        blocks.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(_scores(n + v + 1), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
