"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text gets a space in front, spaces become the mark U+2581, and the best sequence of pieces is the one
with the greatest sum of log probabilities. Vocabularies that hold merge ranks instead of log
probabilities get Zipf's law over the ranks. A character that is no piece, and the mark itself where a text holds it, become
byte pieces, so that decoding gives every text back exactly.

The search keeps the last positions only, as many as the longest piece has characters. When the paths
to all of them pass through one boundary, the ids before it are final and leave. Boundaries that no
piece of the vocabulary crosses (before a run of spaces, around a line end) are such points for
certain, so what lies between them is encoded once and remembered, in a table of bounded size.
"""

import math
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
REMEMBERED_BYTES = 72 << 20
ENTRY_BYTES = 200  # of an entry besides its characters and ids
LONGEST_REMEMBERED = 64
BYTE_PENALTY = 10.0


class Vocabulary:
    """Pieces with log probabilities, read from a model file on the driver and shipped with the task."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], table: list[bytes]):
        self.pieces, self.byte_ids, self.table = pieces, byte_ids, table
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min((s for _, s in pieces.values()), default=0.0) - BYTE_PENALTY
        # pieces cross neither the gap before a space nor a line end, unless the vocabulary says so
        crossing = any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.chunks = None if crossing else re.compile(r" +[^ \n]*|[^ \n]+|\n")
        self.memory: dict[str, array] = {}
        self.older: dict[str, array] = {}
        self.room = REMEMBERED_BYTES // 2
        # every beginning of a piece, with the piece if it is one
        self.starts: dict[str, tuple[int, float] | None] = dict(pieces)
        for p in pieces:
            for i in range(1, len(p)):
                self.starts.setdefault(p[:i], None)

    def __getstate__(self):
        return (self.pieces, self.byte_ids, self.table)

    def __setstate__(self, state):
        self.__init__(*state)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain}
        ranks = all(s == int(s) for s in scores.values())
        pieces = {model.id_to_piece(i): (i, -math.log(2.0 - s) if ranks else s) for i, s in scores.items()}
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        table = [b""] * n
        for b, i in enumerate(byte_ids):
            table[i] = bytes([b])
        for piece, (i, _) in pieces.items():
            table[i] = piece.replace(MARK, " ").encode()
        return cls(pieces, byte_ids, table)

    def search(self, text: str):
        """Ids of the best path through `text` (spaces as such), as they become final."""
        pieces, longest = self.pieces, self.longest
        base, best, back = 0, {0: 0.0}, {}
        for end in range(1, len(text) + 1):
            top, way = -math.inf, None
            for start in range(max(base, end - longest), end):
                part = text[start:end]
                found = None if MARK in part else pieces.get(part.replace(" ", MARK))
                if found is not None:
                    value = best[start] + found[1]
                    if value > top:
                        top, way = value, (start, (found[0],))
            if way is None or way[0] < end - 1:
                last = text[end - 1]
                if last == MARK or (last.replace(" ", MARK) not in pieces):
                    raw = last.encode("utf-8", "surrogatepass")
                    value = best[end - 1] + self.byte_score * len(raw)
                    if value > top:
                        top, way = value, (end - 1, tuple(self.byte_ids[b] for b in raw))
            best[end], back[end] = top, way
            if end - base >= 2 * longest:
                # walk all living paths back to where they meet
                alive = set(range(end - longest + 1, end + 1))
                while len(alive) > 1:
                    latest = max(alive)
                    alive.discard(latest)
                    alive.add(back[latest][0] if latest > base else base)
                meet = alive.pop()
                if meet > base:
                    yield from self._path(back, base, meet)
                    for i in range(base, meet):
                        best.pop(i, None)
                        back.pop(i + 1, None)
                    base = meet
        yield from self._path(back, base, len(text))

    @staticmethod
    def _path(back, base, end):
        steps = []
        while end > base:
            end, ids = back[end]
            steps.append(ids)
        return chain.from_iterable(reversed(steps))

    def _short(self, text: str) -> list[int]:
        """What `search` finds, for a text within one window and without the mark: forward from each place while a piece may begin there."""
        n, marked, known = len(text), text.replace(" ", MARK), self.starts.get
        best, back, last = [-math.inf] * (n + 1), [0] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            have, end = best[start], start + 1
            hit = known(marked[start:end], False)
            if not hit:
                raw = text[start].encode("utf-8", "surrogatepass")
                value = have + self.byte_score * len(raw)
                if value > best[end]:
                    best[end], back[end], last[end] = value, start, raw
            while hit is not False:
                if hit is not None:
                    value = have + hit[1]
                    if value > best[end]:
                        best[end], back[end], last[end] = value, start, hit[0]
                end += 1
                if end > n:
                    break
                hit = known(marked[start:end], False)
        out, end = [], n
        while end:
            piece = last[end]
            if piece.__class__ is int:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in reversed(piece))
            end = back[end]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> array:
        ids = self.older.get(chunk)
        if ids is None:
            ids = array("i", self._short(chunk) if len(chunk) <= self.longest and MARK not in chunk else self.search(chunk))
        if len(chunk) <= LONGEST_REMEMBERED:
            if self.room < 0:
                # the older half goes; what is met again comes back from it
                self.older, self.memory, self.room = self.memory, {}, REMEMBERED_BYTES // 2
            self.memory[chunk] = ids
            self.room -= ENTRY_BYTES + len(chunk) + 4 * len(ids)
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        text = " " + text
        if self.chunks is None:
            out.extend(self.search(text))
            return out
        new = self._chunk
        for chunk in self.chunks.findall(text):
            ids = self.memory.get(chunk)
            out += new(chunk) if ids is None else ids
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass") if raw[:1] == b" " else raw.decode("utf-8", "surrogatepass")


def _parts(batch: pa.RecordBatch, column: str, size: int = 1 << 19):
    """Slices of a batch of about `size` bytes of one column."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_list(col.type):
        length = np.diff(np.asarray(col.offsets)) * 4
    else:
        length = np.asarray(pc.fill_null(pc.binary_length(col), 0))
    total = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _ints(lists: list[array], present: list[bool]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = np.concatenate([np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([not p for p in present]))


def _shared(docs: DataFrame, vocabulary: Vocabulary):
    """The vocabulary for tasks: sent once per executor as plain data, and built once per worker process."""
    sent = docs.sparkSession.sparkContext.broadcast({"state": vocabulary.__getstate__()})

    def get() -> Vocabulary:
        held = sent.value
        if "built" not in held:
            held["built"] = Vocabulary(*held.pop("state"))
        return held["built"]

    return get


def encode(docs: DataFrame, vocabulary: Vocabulary, out: str = "ids") -> DataFrame:
    """`docs` with the ids of each text; an empty text has none, a null text null."""
    kept = [f for f in docs.schema.fields if f.name != out]
    get = _shared(docs, vocabulary)

    def run(batches):
        vocabulary = get()
        for batch in batches:
            for part in _parts(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                ids = [vocabulary.encode(t or "") for t in texts]
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, _ints(ids, [t is not None for t in texts])], names=[*[f.name for f in kept], out])

    return docs.select(*[f.name for f in kept]).mapInArrow(run, StructType([*kept, StructField(out, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the text of each list of ids; null for null."""
    kept = [f for f in encoded.schema.fields if f.name != out]
    get = _shared(encoded, vocabulary)

    def run(batches):
        vocabulary = get()
        for batch in batches:
            for part in _parts(batch, ids):
                texts = []
                for x in part.column(part.schema.get_field_index(ids)):
                    texts.append(vocabulary.decode(x.values.to_numpy().tolist()) if x.is_valid else None)
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*[f.name for f in kept], out])

    return encoded.select(*[f.name for f in kept]).mapInArrow(run, StructType([*kept, StructField(out, StringType())]))
