"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per text. The ledger keeps the measurements and one bit per failed rule;
a policy is a named, versioned mask over these bits, so that changing a policy, or asking what a rule
alone removes, reads the ledger and no text.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import BYTE_CODE, rolling, slabs

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

# Bit number and condition of each rule; a bit never changes its meaning.
RULES: dict[str, tuple[int, str]] = {
    "too_few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "too_many_words": (2, "n_words > 1000000"),
    "symbol_heavy": (3, "10 * n_symbols > n_words"),
    "repeated_lines": (4, "100 * n_dup_lines > 30 * n_lines"),
    "short_words": (5, "word_chars < 2 * n_words"),
    "long_words": (6, "word_chars > 15 * n_words"),
}
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in set(self.rules))


POLICIES = (
    Policy("base", 1, BASE),
    Policy("standard", 1, (*BASE, "symbol_heavy", "repeated_lines")),
    Policy("standard", 2, (*BASE, "symbol_heavy", "repeated_lines", "short_words", "long_words", "too_many_words")),
)
CURRENT = POLICIES[-1]

SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)


def _lines(texts, words) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them that equal an earlier one."""
    data, at = texts.data, texts.at
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(at, breaks, "right") - 1
    # a text of length 0 has one empty line, which holds no word and need not be listed
    full = np.flatnonzero(np.diff(at))
    begin = np.concatenate([at[full], breaks + 1])
    of = np.concatenate([full, own])
    order = np.lexsort((begin, of))
    begin, of = begin[order], of[order]
    end = np.empty(len(begin), np.int64)
    if len(begin):
        end[:-1] = np.where(of[1:] == of[:-1], begin[1:] - 1, at[of[:-1] + 1])
        end[-1] = at[of[-1] + 1]
    worded = np.searchsorted(words.begin, begin) < np.searchsorted(words.begin, end)
    begin, end, of = begin[worded], end[worded], of[worded]
    key = rolling(BYTE_CODE[data], begin, end)
    order = np.lexsort((key, of))
    k, o = key[order], of[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    n = texts.n
    return np.bincount(of, minlength=n), np.bincount(o[again], minlength=n)


def _repeat_words(words, k: int = 3) -> np.ndarray:
    """Words that lie in a window of k words found twice or more in its text."""
    starts, keys = words.windows(k)
    of = words.text_of()
    own = of[starts]
    order = np.lexsort((keys, own))
    a, b = keys[order], own[order]
    same = np.zeros(len(a) + 1, bool)
    same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) if len(a) else False
    found = starts[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(of), bool)
    for i in range(k):
        cover[found + i] = True
    return np.bincount(of[cover], minlength=words.texts.n)


def _measure(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for lo, hi, texts in slabs(batch, fold=False):
            words = texts.words()
            n = texts.n
            of = words.text_of()
            # code points: bytes that don't continue one
            lead = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            chars = np.bincount(of, weights=lead[words.end] - lead[words.begin], minlength=n)
            hits = np.flatnonzero(SYMBOLS[texts.data])
            symbols = np.bincount(np.searchsorted(texts.at, hits, "right") - 1, minlength=n)
            lines, dup = _lines(texts, words)
            values = (words.count, chars, symbols, dup, _repeat_words(words), lines)
            arrays = [pa.array(np.asarray(v).astype(np.int64)) for v in values]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *arrays], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements, and `failed`: one bit per rule.

    A null text counts as empty, and an empty one has no words, hence fails `too_few_words`. Repeated
    rows are judged one by one.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in RULES.values()]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return plain.mapInArrow(_measure, SCHEMA).withColumn("failed", failed.cast("long"))


def passes(policy: Policy, failed: Column | str = "failed") -> Column:
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of a policy: texts that fail it, and texts that only this rule removes."""
    hit = F.col("failed").bitwiseAND(F.lit(policy.mask))
    by_mask = rows.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in sorted(set(policy.rules))]))
    return (
        by_mask.select("hit", "n", each.alias("r"))
        .groupBy(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("removed_by_it_alone"),
        )
    )


def judge(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with `base_failed` and the policy's verdict `kept`."""
    base = Policy("base", 1, BASE)
    return ledger(docs).withColumn("base_failed", ~passes(base)).withColumn("kept", ~F.col("base_failed") & passes(policy))
