"""Duplicate lines by a deletion-neighbourhood join.

Lines are compared as sequences of lower-case words. A line of `LOOSE` words or more goes if an
earlier line, whatever its length, lies within one inserted, deleted or replaced word; a shorter one, of at least
`least` words, goes if an earlier line equals it; lines below `least` words stay. So one edit leaves three quarters
of a line's words at the least, and the bound is one word for longer lines too. `least` is `LEAST` unless the caller
says otherwise; the registered queries say 1, so that lines of every length that have a word are compared.
Earlier means: by doc_id, then by place in the text. So the earliest line of any group always stays.

Equal lines fold first. One edit leaves the first half of the words or the last half intact, so only
lines that share either with another line can have a partner; of these all variants with one word of
the other half left out are emitted as hashed keys. Lines within one edit share a variant: both without
the same place, or one whole and one shortened. Each variant's earliest line is the witness for the
others, so a group is never paired with itself. Witnesses are then compared word by word.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, work_path
from .joins import counted
from .tokens import POWERS, Texts, mix, rolling, signed, slabs

LEAST, LOOSE = 3, 4


def _keyed(docs: DataFrame) -> DataFrame:
    """Lower-case texts with the hash of what they were."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _words(line: Column) -> Column:
    """Lower-case words of a line; one plain delimiter, as a pattern would be compiled anew for each line."""
    even = F.when(line.rlike(r"[\t\r\x0b\x0c]"), F.translate(line, "\t\r\x0b\x0c", "    ")).otherwise(line)
    return F.array_remove(F.split(F.lower(even), " "), "")


def _lines_of(texts: Texts):
    """Lines with a word: their words, text numbers, line numbers from 0, first and last (exclusive) words."""
    words = texts.words()
    of = words.text_of()
    breaks = np.flatnonzero(texts.data == 10)
    ln = np.searchsorted(breaks, words.begin) - np.searchsorted(breaks, texts.at[:-1])[of]
    cut = np.flatnonzero((np.diff(of) != 0) | (np.diff(ln) != 0)) + 1
    s = np.concatenate([[0], cut]) if len(of) else cut
    e = np.concatenate([cut, [len(of)]]) if len(of) else cut
    return words, of[s], ln[s], s, e


LISTED = "doc_id long, tid long, ln int, h long, g long, p1 long, s1 long, p2 long, s2 long"


def _list_lines(batches, least):
    """Lines of `least` words or more: two hashes of all words, and hashes of both halves of those that a pair may hold.

    A half is n // 2 words, as the shorter line of a pair counts; as the longer one it counts (n - 1) // 2. The shorter
    line of a pair may have a word less than `LOOSE`.
    """
    for batch in batches:
        ids, tids = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tid"))
        for lo, hi, texts in slabs(batch, fold=False):
            words, of, ln, s, e = _lines_of(texts)
            keep = e - s >= least
            of, ln, s, e = of[keep], ln[keep], s[keep], e[keep]
            n, take = e - s, pa.array(of + lo)
            halves = []
            for size, none in (((n - 1) // 2, n < LOOSE - 1), (n // 2, (n < LOOSE - 1) | (n % 2 == 1))):
                length = size.astype(np.uint64) << np.uint64(1)
                for x, side in ((rolling(words.hash, s, s + size), 0), (rolling(words.hash, e - size, e), 1)):
                    halves.append(pa.array(signed(mix(x + length + np.uint64(side))), mask=none))
            hashes = [pa.array(signed(rolling(v, s, e))) for v in (words.hash, mix(words.hash))]
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), tids.take(take), pa.array(ln.astype(np.int32)), *hashes, *halves], names=["doc_id", "tid", "ln", "h", "g", "p1", "s1", "p2", "s2"]
            )


ACTIVE = "doc_id long, tid long, ln int, front boolean, back boolean, line string"


def _cut_out(batches):
    """The lines that a text's `marks` name, from the first word to the last."""
    for batch in batches:
        at = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tid", "marks")}
        for lo, hi, texts in slabs(batch, fold=False):
            words, of, ln, s, e = _lines_of(texts)
            marks = at["marks"].slice(lo, hi - lo)
            own = np.repeat(np.arange(texts.n), np.diff(np.asarray(marks.offsets)))
            flat = marks.flatten()
            want = np.asarray(flat.field("ln"))
            # lines are sorted by text and number
            place = np.searchsorted((of.astype(np.int64) << 32) | ln, (own.astype(np.int64) << 32) | want)
            data = texts.data.tobytes()
            line = [data[words.begin[i] : words.end[j - 1]].decode() for i, j in zip(s[place], e[place])]
            take = pa.array(own + lo)
            yield pa.RecordBatch.from_arrays(
                [at["doc_id"].take(take), at["tid"].take(take), flat.field("ln"), flat.field("front"), flat.field("back"), pa.array(line, pa.string())],
                names=["doc_id", "tid", "ln", "front", "back", "line"],
            )


VARIANTS = "v long, i int, doc_id long, tid long, ln int"


def _leave_out(batches):
    """Hashes of each line whole (i = -1) and, from `LOOSE` words on, without its word i, for the places that an edit may have."""
    for batch in batches:
        at = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "tid", "ln")]
        front, back = (np.asarray(batch.column(batch.schema.get_field_index(c)).cast(pa.int8())) for c in ("front", "back"))
        for lo, hi, texts in slabs(batch, fold=False, column="line"):
            words = texts.words()
            s, e = words.first[:-1], words.first[1:]
            n = e - s
            half = (n - 1) // 2
            begin = np.where(back[lo:hi] > 0, 0, half)
            end = np.where(front[lo:hi] > 0, n, n - half)
            size = np.where(n < LOOSE, 0, end - begin)
            own = np.repeat(np.arange(texts.n), size)
            i = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[own]
            up, down = POWERS.to(len(words.hash) + 2)
            total = np.zeros(len(words.hash) + 1, np.uint64)
            np.cumsum(words.hash * up[: len(words.hash)], out=total[1:])
            a, z = s[own], e[own]
            cut = mix((total[a + i] - total[a]) * down[a] + (total[z] - total[a + i + 1]) * down[a + 1])
            v = np.concatenate([rolling(words.hash, s, e), cut])
            take = pa.array(np.concatenate([np.arange(texts.n), own]) + lo)
            place = np.concatenate([np.full(texts.n, -1), i]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(signed(v)), pa.array(place), *[c.take(take) for c in at]], names=["v", "i", "doc_id", "tid", "ln"])


def near_earlier(lines: DataFrame) -> DataFrame:
    """Of distinct lines (doc_id, tid, ln, front, back, line) the place `at` of those of `LOOSE` words with an earlier one within one edit."""
    at = F.struct("doc_id", "tid", "ln").alias("at")
    variants = materialize(lines.mapInArrow(_leave_out, VARIANTS).select("v", "i", at))
    first = variants.groupBy("v", "i").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1 or i < 0")
    same = variants.join(first.where("i >= 0").hint("merge"), ["v", "i"]).where("first < at").select("at", F.col("first").alias("by"))
    whole = first.where("i < 0").select("v", F.col("first").alias("whole"))
    cut = variants.where("i >= 0").join(whole.hint("merge"), "v").where("at <> whole")
    other = cut.select(F.greatest("at", "whole").alias("at"), F.least("at", "whole").alias("by"))
    pairs = same.unionByName(other).groupBy("at", "by").agg(F.lit(1).alias("one")).select("at", "by")
    words = lines.select(at, _words(F.col("line")).alias("words"))
    pairs = pairs.join(words, "at").join(words.select(F.col("at").alias("by"), F.col("words").alias("others")), "by")
    return pairs.where((F.size("words") >= LOOSE) & _within_one("words", "others")).select("at").distinct()


def _within_one(a: str, b: str) -> Column:
    """Whether two different word sequences are one edit apart: what differs is one place."""
    short, long = (F.when((F.size(a) <= F.size(b)) == flag, F.col(a)).otherwise(F.col(b)) for flag in (True, False))
    differs = F.filter(F.sequence(F.lit(1), F.size(short)), lambda i: F.element_at(short, i) != F.element_at(long, i))
    p = F.coalesce(F.get(differs, F.lit(0)) - 1, F.size(short))  # words before the first difference
    tail = F.slice(long, p + 2, F.size(long))
    rest = F.when(F.size(short) == F.size(long), F.slice(short, p + 2, F.size(short))).otherwise(F.slice(short, p + 1, F.size(short)))
    return (F.size(long) - F.size(short) <= 1) & (rest == tail)


def removed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, tid, gone): numbers from 0 of the lines to remove; tid is the hash of the text.

    Repeated rows of one document, equal in id and text, count as one.
    """
    spark = docs.sparkSession
    keyed = _keyed(docs)
    path = work_path(spark, "lines")
    keyed.mapInArrow(lambda batches: _list_lines(batches, least), LISTED).withColumn("at", F.struct("doc_id", "tid", "ln")).drop("doc_id", "tid", "ln").write.parquet(path)
    lines = spark.read.parquet(path)

    path = work_path(spark, "distinct-lines")
    halves = ("p1", "s1", "p2", "s2")
    folded = lines.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last"), *[F.max(c).alias(c) for c in halves])
    folded.write.parquet(path)
    distinct = spark.read.parquet(path)

    sides = F.array(*[F.struct(F.col(c).alias("k"), F.lit(c.startswith("p")).alias("front")) for c in halves])
    ends = distinct.where("p1 is not null").select("first", F.explode(sides).alias("x")).select("first", "x.*").where("k is not null")
    shared = ends.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    open_ = ends.join(shared.hint("merge"), "k").groupBy("first").agg(F.max("front").alias("front"), F.max(~F.col("front")).alias("back"))
    marks = F.collect_list(F.struct("first.ln", "front", "back"))
    wanted = materialize(open_.groupBy("first.doc_id", "first.tid").agg(marks.alias("marks")))
    texts = keyed.join(counted(wanted.toDF("w_id", "w_tid", "marks"), F.size("marks") + 2), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tid") == F.col("w_tid")))
    path = work_path(spark, "active-lines")
    cut = texts.select("doc_id", "tid", "marks", "text").mapInArrow(_cut_out, ACTIVE)
    cut.dropDuplicates(["doc_id", "tid", "ln"]).write.parquet(path)
    near = materialize(near_earlier(spark.read.parquet(path)))

    near = near.select(F.col("at").alias("first"), F.lit(True).alias("near"))
    judged = distinct.select("h", "g", "first", "last").join(near, "first", "left").where("near or first <> last")
    judged = materialize(judged.select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = lines.join(counted(judged), ["h", "g"]).where("near or at <> first").select("at").distinct()
    return gone.groupBy("at.doc_id", "at.tid").agg(F.collect_list("at.ln").alias("gone"))


def _cleaned(docs: DataFrame, least: int) -> DataFrame:
    gone = materialize(removed_lines(docs, least)).toDF("_llm_id", "_llm_tid", "_llm_gone")
    row = docs.withColumn("_llm_key", F.xxhash64("text"))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_tid"))
    last = F.size(F.split("text", "\n")) - 1
    kept = F.array_except(F.sequence(F.lit(0), last), "_llm_gone")
    # the lines are bound to a name, as they would be split anew for each number
    rest = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")), F.lit(0))
    text = F.when(F.col("_llm_gone").isNull(), F.col("text")).otherwise(rest)
    return row.join(counted(gone, F.size("_llm_gone") + 2), on, "left").withColumn("text", text)


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, least: int = LEAST) -> DataFrame:
    """`docs` with duplicate lines taken out of `text`; all other columns stay.

    Texts without a duplicate line stay byte for byte; null texts stay null. With `drop_emptied`
    documents that lose lines and keep no word go.
    """
    out = _cleaned(docs, least)
    if drop_emptied:
        out = out.where(F.col("_llm_gone").isNull() | F.col("text").rlike(r"\S"))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, its lines, how many of them go, and the text that is left."""
    plain = docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    return _cleaned(plain, least).select(
        "doc_id", "n_lines", F.coalesce(F.size("_llm_gone"), F.lit(0)).alias("n_removed"), "text"
    )
