"""Token ids of a corpus by a byte-level merge tokenizer run as a deterministic automaton."""

from __future__ import annotations

import array
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the public pattern that splits a text before merges apply.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over texts of ASCII alone.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

#: Entries of a worker's tables of finished pieces before they start anew.
REMEMBERED = 400_000
#: Cells of the transition table that a worker keeps before it starts anew.
CELLS = 2_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton over token arcs that accepts exactly the sequences the merges produce.

    Start with one state that has an arc to itself for every byte. Merge number t of tokens u, v into w applies a
    gadget: the state after u loses its arc v; every state that still has an arc u gets an arc w; the state after w
    starts with the arcs of the state after v from before the loss. So every arc labelled a leads to one state, and
    whether state a has arc b follows from the time at which either was born: ``arc`` unrolls the gadgets backwards for
    the pairs that texts ask for and keeps the answers as transition table, since the whole table has 2.5 billion cells.
    A word has exactly one accepted sequence, and so has each of its prefixes: reading left to right, the arc
    that ends at a position is the one whose start position's own last arc allows it.
    """

    def __init__(self, spec: dict):
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        self.labels = {i: b for b, i in self.ids.items()}
        size = max(self.ids.values()) + 1
        self.born, self.parts, self.merged = [0] * size, [(-1, -1)] * size, {}
        for t, pair in enumerate(spec["model"]["merges"], 1):
            u, v = (raw(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            w = self.ids[u + v]
            self.born[w], self.parts[w], self.merged[self.ids[u], self.ids[v]] = t, (self.ids[u], self.ids[v]), t
        self.longest = max(map(len, self.ids))
        self.table: dict[int, bool] = {}

    def arc(self, a: int, b: int) -> bool:
        """Whether the state after a has an arc b once all gadgets are applied."""
        key = a << 20 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= CELLS:
                self.table.clear()
            known = self.table[key] = self._unroll(a, b)
        return known

    def _unroll(self, a: int, b: int) -> bool:
        time = len(self.merged)
        while True:
            if self.merged.get((a, b), time + 1) <= time:
                return False
            x, y = self.born[a], self.born[b]
            if not x and not y:
                return True
            if x < y:
                b, time = self.parts[b][0], y
            elif y < x:
                a, time = self.parts[a][1], x - 1
            else:
                a, b, time = self.parts[a][1], self.parts[b][0], x - 1

    def encode(self, word: bytes) -> list[int]:
        whole = self.ids.get(word)
        if whole is not None and len(word) == 1:
            return [whole]
        n, ids, arc, longest = len(word), self.ids, self.arc, self.longest
        last, back = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = ids.get(word[j:i])
                if t is not None and (not j or arc(last[j], t)):
                    last[i], back[i] = t, j
                    break
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The arcs' labels in order."""
        return b"".join(self.labels[i] for i in ids)


class TextEncoder:
    """Whole texts to 32-bit ids as bytes, with tables of pieces already encoded.

    A text is cut where the split pattern must end a token whatever surrounds it: after a line feed before a
    non-blank, and between a digit and a comma or stop. The white space before such a line feed is one token, as at the end of a text.
    """

    def __init__(self, spec: dict):
        import regex

        self.machine = MergeAutomaton(spec)
        self.words, self.pieces = {}, {}
        self.any_split = regex.compile(PATTERN).findall
        self.ascii_split = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.lines, self.joints = re.compile(r"\n(?=\S)").split, re.compile(r"(?<=[0-9])(?=[,.])").split
        self.feed = self._word("\n")

    def _word(self, w: str) -> bytes:
        return array.array("i", self.machine.encode(w.encode("utf-8", "surrogatepass"))).tobytes()

    def _piece(self, piece: str) -> bytes:
        words, out = self.words, []
        for w in (self.ascii_split if piece.isascii() else self.any_split)(piece):
            ids = words.get(w)
            if ids is None:
                if len(words) > REMEMBERED:
                    words.clear()
                ids = words[w] = self._word(w)
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str) -> bytes:
        pieces, out = self.pieces, []
        for line in self.lines(text):
            ids = pieces.get(line)
            if ids is None:
                if len(line) < 8 or not line[0].isdigit():
                    ids = self._kept(line)
                else:
                    ids = b"".join([pieces.get(p) or self._kept(p) for p in self.joints(line)])
            out.append(ids)
        return self.feed.join(out)

    def _kept(self, piece: str) -> bytes:
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        ids = self._piece(piece)
        if len(piece) < 400:
            self.pieces[piece] = ids
        return ids


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row: the ids of ``text`` without special tokens; null and empty texts have an empty list.

    Strings of special tokens in a text are ordinary text. Rows keep their number, repeated ones too; other columns are
    not read. No shuffle: each batch is encoded where it was read. The vocabulary, a file of fixed size, is read once
    on the driver and sent to the executors.
    """
    sc = documents.sparkSession.sparkContext
    with open(vocabulary, encoding="utf-8") as f:
        spec = sc.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or TextEncoder(json.loads(spec.value))
            parts = [encoder(t) if t else b"" for t in batch.column(1).to_pylist()]
            ends = [0]
            for p in parts:
                ends.append(ends[-1] + len(p) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids) by emitting the arcs' labels; a null list gives null."""
    sc = ids.sparkSession.sparkContext
    with open(vocabulary, encoding="utf-8") as f:
        spec = sc.broadcast(f.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = None
        for batch in batches:
            labels = labels or MergeAutomaton(json.loads(spec.value)).labels
            texts = [None if x is None else b"".join([labels[i] for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_ids, same): whether decoding a document's ids gives its text back."""
    ids = token_ids(documents, vocabulary)
    back = decoded(ids, vocabulary).groupBy("doc_id").agg(F.max(F.xxhash64("text")).alias("back"))
    sizes = ids.groupBy("doc_id").agg(F.max(F.size("ids")).alias("n_ids"))
    own = documents.groupBy("doc_id").agg(F.max(F.xxhash64(F.coalesce("text", F.lit("")))).alias("own"))
    return own.join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "n_ids", (F.col("own") == F.col("back")).alias("same"))
