"""Documents packed into sequences of bounded size by vector best-fit.

A document is its token ids and one end id; only longer ones than a sequence are cut. Every piece is a vector of
what it uses up of a sequence: tokens, documents, and attention cost (the square of its length). Within a chunk pieces go,
largest first, into the open sequence with room in every dimension that the rule likes best: `norm` takes the one whose
weighted residual, after the piece, is shortest; `dot` the one whose residual lies most along the piece. A new sequence is
opened only where none has room.

Chunks are packed side by side in tasks; sequences that a chunk leaves too empty are opened again in a second round,
where what all chunks left meets. No chunk depends on the size of the corpus.
"""

import json
import re
import zlib
from array import array
from dataclasses import dataclass
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, work_path
from .tokens import slabs

CHUNK = 16_384  # pieces that are packed at once
LOOSE = 0.01  # a sequence with a larger share of its tokens free is opened again
WINDOW = 1 << 18  # bytes of a text that are split into words at once
REMEMBERED_BYTES = 96 << 20
ENTRY_BYTES = 170  # of a table entry besides the bytes of word and ids
END = b"\0\0\0\0"
BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


# How the vocabulary at hand prepares a text, and what that comes to for printable ASCII and Latin-1 letters.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER = "a-zß-öø-ÿ"
PLAIN_SPLITTER = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it is printable, else the next one from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(other)}


def _prepares_plainly(definition: str) -> bool:
    """Whether the normalizer and the splitter are those above, so that plain words can go to the model piece by piece."""
    parts = json.loads(definition)
    normal, split = parts.get("normalizer") or {}, parts.get("pre_tokenizer") or {}
    first, *rest = split.get("pretokenizers") or [{}]
    return (
        [n["type"] for n in normal.get("normalizers", ())] == NORMALIZERS
        and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and first.get("pattern") == {"Regex": SPLITTER}
        and [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] == [("ByteLevel", False, False)]
    )


class Tokens:
    """Ids of texts; words between white space, which the tokenizer drops, are remembered in a table of bounded bytes.

    A new word goes through the tokenizer by itself. If it is printable ASCII or Latin-1 letters, and the vocabulary splits
    such words in the known way, its pieces go straight to the tokenizer's model, which gives the same ids sooner.
    """

    def __init__(self, definition: str):
        self.definition = definition
        self.tokenizer = None
        self.known: dict[bytes, bytes] = {}
        self.room = REMEMBERED_BYTES

    def __getstate__(self):
        return self.definition

    def __setstate__(self, definition):
        self.__init__(definition)

    def _load(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.definition)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = _prepares_plainly(self.definition) and all(re.search("[^A-Za-z]", s) for s in special)
        self.model = self.tokenizer.model if plain else None
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.letters = _byte_letters()

    def _piece(self, piece: bytes) -> bytes:
        ids = self.known.get(piece)
        if ids is None:
            letters = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.letters)
            ids = self.known[piece] = array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            self.room -= len(piece) + len(ids)
        return ids

    def _learn(self, words: set[bytes]) -> None:
        if self.tokenizer is None:
            self._load()
        known, piece, other, before = self.known, self._piece, [], len(self.known)
        for w in words if self.model else ():
            low = w.lower()
            if low.isalpha():
                known[w] = known.get(low) or piece(low)
            elif PLAIN.fullmatch(text := w.decode()) and not self.special.search(text):
                known[w] = b"".join([piece(p.encode()) for p in PLAIN_SPLITTER.findall(text.lower())])
            else:
                other.append(w)
        other = other if self.model else list(words)
        if other:
            coded = self.tokenizer.encode([w.decode() for w in other], is_pretokenized=True, add_special_tokens=False)
            ids, at = np.array(coded.ids, "<u4").tobytes(), np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(other) + 1)) * 4
            for i, w in enumerate(other):
                known[w] = ids[at[i] : at[i + 1]]
        self.room -= sum(map(len, words)) + ENTRY_BYTES * (len(known) - before)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of some texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        at = [0] * len(texts)
        left = [i for i, t in enumerate(texts) if t]
        while left:
            split = {}
            for i in left:
                text, begin = texts[i], at[i]
                end = begin + WINDOW
                if end < len(text):  # cut at white space
                    cut = BLANK.search(text, end)
                    end = cut.start() if cut else len(text)
                split[i] = text[begin:end].split()
                at[i] = end
            left = [i for i in left if at[i] < len(texts[i])]
            if self.room < 0:
                self.known, self.room = {}, REMEMBERED_BYTES
            new = set(chain.from_iterable(split.values())).difference(self.known)
            if new:
                self._learn(new)
            have = self.known.__getitem__
            for i, words in split.items():
                out[i].append(b"".join(map(have, words)))
        return [b"".join(x) for x in out]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(tokens: Tokens, size: int, with_ids: bool):
    def run(batches):
        for batch in batches:
            docs = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, texts in slabs(batch, fold=False):
                data = texts.data.tobytes()
                own, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(tokens.ids([data[a:b] for a, b in zip(texts.at[:-1], texts.at[1:])])):
                    raw += END
                    for k, at in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at : at + 4 * size]
                        own.append(lo + i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                cols = [docs.take(pa.array(own)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most. Unless told otherwise, only the tokens bind."""

    tokens: int = 2_048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"

    def capacity(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)

    @property
    def piece(self) -> int:
        """The longest piece that fits into a sequence of its own."""
        return min(self.tokens, isqrt(self.attention)) if self.attention else self.tokens


def best_fit(lengths: np.ndarray, limits: Limits) -> np.ndarray:
    """Sequence number of each piece; `lengths` must not grow."""
    full = limits.capacity()
    use = np.stack([lengths, np.ones(len(lengths)), lengths.astype(np.float64) ** 2], axis=1) / full
    weights = np.asarray(limits.weights)
    out = np.empty(len(lengths), np.int64)
    room = np.empty((256, 3))  # of the sequences that are still open
    number = np.empty(256, np.int64)
    open_, made = 0, 0
    slack = 1e-9
    smallest = use.min(axis=0) if len(use) else None
    for i, u in enumerate(use):
        if i % 512 == 0 and open_:
            keep = np.flatnonzero((room[:open_] >= smallest - slack).all(axis=1))
            room[: len(keep)], number[: len(keep)] = room[keep], number[keep]
            open_ = len(keep)
        left = room[:open_] - u
        fits = np.flatnonzero(left.min(axis=1) >= -slack) if open_ else ()
        if len(fits):
            if limits.rule == "dot":
                best = fits[(room[fits] @ (weights * u)).argmax()]
            else:
                best = fits[((left[fits] ** 2) @ weights).argmin()]
            room[best] = left[best]
            out[i] = number[best]
            continue
        if open_ == len(room):
            room, number = np.concatenate([room, np.empty_like(room)]), np.concatenate([number, np.empty_like(number)])
        room[open_], number[open_], out[i] = 1 - u, made, made
        open_, made = open_ + 1, made + 1
    return out


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack(limits: Limits, chunk: int, turn: int):
    def run(batches):
        first = (turn << 58) | (TaskContext.get().partitionId() << 34)
        held, rows = [], 0

        def done():
            nonlocal first
            table = pa.Table.from_batches(held).combine_chunks()
            cols = {n: table.column(n).to_numpy() for n in NAMES[1:]}
            ids = table.column("doc_id").combine_chunks()
            keys = np.asarray(ids.fill_null(-(1 << 63)))
            order = np.lexsort((cols["ids_crc32"], cols["piece"], keys, -cols["length"]))
            length = cols["length"][order]
            into = best_fit(length, limits)
            where = np.argsort(into, kind="stable")  # sequence by sequence
            order, length, into = order[where], length[where], into[where]
            total = np.cumsum(length) - length
            head = np.concatenate([[True], into[1:] != into[:-1]])
            begin = total[head][np.cumsum(head) - 1]
            filled = np.bincount(into, weights=length).astype(np.int64)[into]
            rows = table.take(pa.array(order)).select(NAMES)
            for name, x in (("sequence_id", first + into), ("offset", total - begin), ("filled", filled)):
                rows = rows.append_column(name, pa.array(x.astype(np.int64)))
            first += int(into[-1]) + 1
            return rows.combine_chunks().to_batches()

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == chunk:
                    yield from done()
                    held, rows = [], 0
        if rows:
            yield from done()

    return run


def pieces_of(docs: DataFrame, path: str, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece; `path` is a file of the tokenizers library, read by the driver."""
    from tokenizers import Tokenizer

    tokens = Tokens(Tokenizer.from_file(path).to_str())
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(_cut(tokens, limits.piece, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, limits: Limits = Limits(), chunk: int = CHUNK) -> DataFrame:
    """`pieces` (a written table) with sequence_id and offset, the place in its sequence.

    Null ids and repeated rows are pieces like any other; an empty table packs into nothing.
    """
    rows = pieces.select(*NAMES)
    free = limits.tokens - F.col("filled")
    done = None
    for turn in (0, 1):
        parts = max(1, -(-rows.count() // chunk))
        # dealt out alike whatever the ids are, so that no chunk depends on one source
        placed = materialize(rows.repartition(parts).mapInArrow(_pack(limits, chunk, turn), PLACED))
        if turn or parts == 1:
            done = placed if done is None else done.unionByName(placed)
            break
        done = placed.where(free <= LOOSE * limits.tokens)
        rows = placed.where(free > LOOSE * limits.tokens).select(*NAMES)
    return done.drop("filled")


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), chunk: int = CHUNK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts count as empty: one end id."""
    spark = docs.sparkSession
    at = work_path(spark, "pieces")
    pieces_of(docs, path, limits).write.parquet(at)
    return pack(spark.read.parquet(at), limits, chunk)


def sequences(docs: DataFrame, path: str, limits: Limits = Limits(), chunk: int = CHUNK) -> DataFrame:
    """sequence_id and the ids of each packed sequence, in order, with the lengths of its pieces."""
    spark = docs.sparkSession
    at = work_path(spark, "pieces")
    pieces_of(docs, path, limits, with_ids=True).write.parquet(at)
    pieces = spark.read.parquet(at)
    # equal pieces of equal ids are numbered, so that each finds a place of its own
    key = ["doc_id", "piece", "ids_crc32"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("start"))
    placed = pack(pieces, limits, chunk).withColumn("nth", nth)
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    for c in ("piece", "ids_crc32", "nth"):
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    both = placed.alias("l").join(pieces.withColumn("nth", nth).alias("r"), same).select("l.sequence_id", "l.offset", "r.ids")
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts.ids", F.size).alias("lengths")
    )
