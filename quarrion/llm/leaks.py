"""Held-out passages in a corpus: CGK embedding, bit-sampling LSH over windows, exact edit verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrion.llm.cues import cues, fold, unescaped
from quarrion.session import durable

#: Sound descriptions, music, speakers' names and dashes are not spoken words.
_UNSPOKEN = re.compile(r"\[[^\]]*\]|\([^)]*\)|♪[^♪]*♪|\*[^*]*\*|[♪#*]|(?:^|(?<=[.?!…] ))-? ?[A-ZÀ-Þ][A-ZÀ-Þ .']+:|(?<=\w)\?(?=\w)")


@dataclass(frozen=True)
class Index:
    """Parameters of the search. A window has ``chars`` letters, the walk ``2 * chars`` steps; the corpus's windows begin every
    ``stride`` letters, the items' at every letter. ``tables`` tables sample ``bits`` steps each.

    An unaltered window is found by every table, and half of the shortest item holds several; an edit spoils a
    table only if a sampled step lies where the two walks are apart. ``log_slots`` is the fixed size of the filter of
    item hashes that goes to the executors, whatever the number of items. A pair is a candidate from one common
    hash on: half of the shortest item holds few windows, and altered words or an interposed line spoil most of
    them. ``share`` is half of an item's words less an altered word at the edge. ``pure`` is the share of the spanned
    words that must be there: two altered words in half of the shortest item pass, a sentence of the same pattern
    about other things (every fifth or sixth word another) does not.
    """

    chars: int = 24
    stride: int = 8
    tables: int = 10
    bits: int = 14
    seed: int = 20
    log_slots: int = 27
    share: float = 0.48
    pure: float = 0.85


def spoken(text: str) -> list[str]:
    """Folded words of a text's cues without what is not spoken."""
    line = " ".join(_UNSPOKEN.sub(" ", c) for c in cues(unescaped(text)))
    return [w for w in fold(line.replace("’", "").replace("'", "").replace("-", " ")).split(" ") if w]


def _walk(index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The random functions: whether the walk advances at (step, letter), the sampled steps and factor of each sample."""
    r = np.random.default_rng(index.seed)
    steps = 2 * index.chars
    advance = r.integers(0, 2, (steps, 32), dtype=np.uint8)
    sampled = np.stack([np.sort(r.choice(steps, index.bits, replace=False)) for _ in range(index.tables)])
    return advance, sampled, r.integers(1, 1 << 62, (index.tables, index.bits), dtype=np.int64) | 1


def window_hashes(letters: np.ndarray, starts: np.ndarray, index: Index) -> np.ndarray:
    """(tables, windows) hashes of the windows at ``starts`` of ``letters`` (0 ends a text and pads windows).

    CGK: the walk writes the letter under its pointer at each step and moves on or not by a random bit of step and
    letter, so windows of small edit distance fall into step again and differ in few places.
    """
    advance, sampled, factors = _walk(index)
    at = starts.astype(np.int32)
    hashes = np.zeros((index.tables, len(starts)), np.int64)
    uses: dict[int, list[tuple[int, int]]] = {}
    for t in range(index.tables):
        for b, step in enumerate(sampled[t]):
            uses.setdefault(int(step), []).append((t, int(factors[t, b])))
    for step in range(max(uses) + 1):
        c = letters[at]
        for t, f in uses.get(step, ()):
            hashes[t] += c * np.int64(f)
        at += advance[step][c]
    with np.errstate(over="ignore"):
        for t in range(index.tables):
            h = hashes[t]
            h ^= h >> 29
            h *= np.int64(-0x40A7B892E31B1A47)
            h ^= (h >> 32) + t
    return hashes


def _letters(texts: list[list[str]], index: Index) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Texts as letters 1-26 in a row, each followed by enough zeros for a walk, and their bounds."""
    pad, parts, bounds, at = b"\0" * (2 * index.chars + 1), [], [], 0
    for words in texts:
        t = "".join(words).encode("ascii")
        bounds.append((at, at + len(t)))
        parts += (t, pad)
        at += len(t) + len(pad)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    return np.where(raw > 0, raw - 96, 0).astype(np.uint8), bounds


def _starts(bounds: list[tuple[int, int]], index: Index, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the whole windows of each text (at least one each), and the text of each."""
    counts = np.array([max(1, (b - a - index.chars) // stride + 1) if b > a else 0 for a, b in bounds], np.int64)
    owner = np.repeat(np.arange(len(bounds)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    begins = np.array([a for a, _ in bounds], np.int64)
    return begins[owner] + (np.arange(len(owner)) - first) * stride, owner


def _slots(h: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << index.log_slots) - 1
    return h & mask, (h >> 33) & mask


def _near(a: str, b: str) -> bool:
    """At most one edit for every four letters."""
    n, m = len(a), len(b)
    most = max(n, m) // 4
    if abs(n - m) > most or not most:
        return a == b
    row = list(range(m + 1))
    for i in range(1, n + 1):
        last, row[0] = row[0], i
        for j in range(1, m + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a[i - 1] != b[j - 1]))
    return row[m] <= most


class Places(dict):
    """A word's places in an item, where the item has it or one that is one edit in four letters apart; what was asked is kept."""

    def __init__(self, item: list[str]):
        self.size, self.exact, self.ends = len(item), {}, {}
        for j, w in enumerate(item):
            self.exact.setdefault(w, []).append(j)
        for v in self.exact:
            if len(v) > 3:
                for end in (v[:2], "-" + v[-2:]):
                    self.ends.setdefault(end, []).append(v)

    def __missing__(self, w: str) -> tuple[int, ...]:
        js = set(self.exact.get(w, ()))
        if len(w) > 3:
            for v in (*self.ends.get(w[:2], ()), *self.ends.get("-" + w[-2:], ())):
                if v != w and abs(len(v) - len(w)) <= 2 and _near(w, v):
                    js.update(self.exact[v])
        self[w] = found = tuple(sorted(js))
        return found


def coverage(doc: list[str], item: list[str] | Places, pure: float = 0.85, item_gap: int = 5, doc_gap: int = 30, least: float = 0.0) -> float:
    """Share of the item's words that the best chain spans.

    A chain takes words that stand in both texts in the same order, equal or one edit in four letters apart. At most
    ``item_gap`` item words in a row may be altered or missing, at most ``doc_gap`` words put between, and at least
    ``pure`` of the spanned words must be there. A pair of words counts if the words next to it or next but one agree too.
    Where too few of the item's words are there for a share of ``least``, the chain is not sought and the share is 0.
    """
    places = item if isinstance(item, Places) else Places(item)
    need = pure * least * places.size - 1e-6
    if len(set().union(*map(places.__getitem__, set(doc)))) < need:
        return 0.0
    pairs = [(d, j) for d, w in enumerate(doc) for j in places[w]]
    there = set(pairs)
    pairs = [(d, j) for d, j in pairs if (d - 1, j - 1) in there or (d + 1, j + 1) in there or (d - 2, j - 2) in there or (d + 2, j + 2) in there]
    if len({j for _, j in pairs}) < need:
        return 0.0
    best: list[tuple[int, int]] = []
    top, low = 0, 0
    for k, (d, j) in enumerate(pairs):
        n, start = 1, j
        while pairs[low][0] < d - doc_gap - 1:
            low += 1
        for p in range(low, k):
            e, i = pairs[p]
            if e < d and 0 < j - i <= item_gap + 1:
                m, s = best[p]
                if m >= n:
                    n, start = m + 1, s
        best.append((n, start))
        if n >= pure * (j - start + 1):
            top = max(top, j - start + 1)
    return top / places.size if places.size else 0.0


def leaked(documents: DataFrame, items: DataFrame, index: Index = Index()) -> DataFrame:
    """(doc_id, item_id) of the documents that hold an item whole or a contiguous half of it.

    Items become rows of the index (table and hash of each window). Documents are read once: windows whose hash is not in
    a filter of fixed size are dropped where they arise, the rest meet the index in a join, and candidate pairs are
    verified exactly on the whole text. Null and empty texts and items match nothing; repeated rows give one.
    """
    import pandas as pd

    spark = documents.sparkSession
    log_slots, tables = index.log_slots, index.tables

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [spoken(t) if t else [] for t in batch.column(1).to_pylist()]
            letters, bounds = _letters(texts, index)
            starts, owner = _starts(bounds, index, 1)
            hashes = window_hashes(letters, starts, index)
            frame = pd.DataFrame({"h": hashes.ravel(), "item_id": np.tile(np.array(ids, np.int64)[owner], tables)}).drop_duplicates()
            words = dict(zip(ids, (" ".join(t) for t in texts)))
            frame["words"] = None
            yield pa.RecordBatch.from_pandas(pd.concat([frame, pd.DataFrame({"h": None, "item_id": list(words), "words": list(words.values())})]).astype({"h": "Int64"}), pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("words", pa.string())]), preserve_index=False)

    rows = durable(items.where("item_id is not null").select("item_id", "text").mapInArrow(item_rows, "h long, item_id long, words string"))

    def filter_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            slots = np.unique(np.concatenate(_slots(h, index)))
            yield pa.RecordBatch.from_arrays([pa.array(slots >> 15, pa.int32()), pa.array(slots & 32767, pa.int32())], names=["page", "slot"])

    # pages of 32768 slots as bitmaps: 4 KB each, at most 2**(log_slots - 15) of them
    pages = rows.where("h is not null").select("h").mapInArrow(filter_part, "page int, slot int").groupBy("page").agg(F.collect_set("slot").alias("slots"))
    bits = np.zeros(1 << (log_slots - 3), np.uint8)
    for p in pages.toLocalIterator():
        s = np.array(p.slots, np.int64) + (p.page << 15)
        np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
    sent = spark.sparkContext.broadcast(bits)

    def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = lambda s: (sent.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [spoken(t) if t else [] for t in batch.column(1).to_pylist()]
            letters, bounds = _letters(texts, index)
            starts, owner = _starts(bounds, index, index.stride)
            hit_docs, hit_hashes = [], []
            for at in range(0, len(starts), 1 << 16):
                hashes = window_hashes(letters, starts[at : at + (1 << 16)], index)
                a, b = _slots(hashes, index)
                t, w = np.nonzero(there(a))
                keep = there(b[t, w]).astype(bool)
                hit_docs.append(owner[at + w[keep]]), hit_hashes.append(hashes[t[keep], w[keep]])
            found: dict[int, set[int]] = {}
            if hit_docs:
                for d, h in zip(np.concatenate(hit_docs).tolist(), np.concatenate(hit_hashes).tolist()):
                    found.setdefault(d, set()).add(h)
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in found], pa.int64()), pa.array([" ".join(texts[d]) for d in found], pa.string()), pa.array([list(h) for h in found.values()], pa.list_(pa.int64()))], names=["doc_id", "doc", "hashes"])

    hits = durable(documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(doc_rows, "doc_id long, doc string, hashes array<long>").withColumn("row", F.monotonically_increasing_id()))
    pairs = hits.select("row", F.explode("hashes").alias("h")).join(rows.where("h is not null").select("h", "item_id"), "h").select("row", "item_id").distinct()
    both = pairs.join(hits.select("row", "doc_id", "doc"), "row").join(rows.where("h is null").select("item_id", "words"), "item_id").select("doc_id", "item_id", "doc", "words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, Places] = {}
        asked = 0
        for batch in batches:
            share = []
            for d, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                places = items.get(w)
                if places is None:
                    places = items[w] = Places(w.split(" "))
                before = len(places)
                share.append(coverage(d.split(" "), places, pure=index.pure, least=index.share))
                asked += len(places) - before
                if asked > 300_000 or len(items) > 10_000:
                    items.clear()
                    asked = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share, pa.float64())], names=["doc_id", "item_id", "share"])

    return both.mapInArrow(check, "doc_id long, item_id long, share double").where(F.col("share") >= index.share).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
