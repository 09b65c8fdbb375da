"""Passages of evaluation items in documents, by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a passage.
LEAST = 12
#: Characters of item text whose seeds are held by a task at once; more items are taken in blocks of this size, each against all documents.
BLOCK_CHARS = 16_000_000
#: Documents that are hashed together.
GROUP = 256
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """The words of a text: the longest runs of letters and digits after NFKC and lower-casing."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin values, modulo 2**64, of all windows of k ids; those with an id below 0 (a word that no item has) are meaningless."""
    if len(ids) < k:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
    x ^= x >> np.uint64(29)
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + x[j : j + len(out)]
    return out


class Seeds:
    """The windows of all items of a block: their vocabulary, sorted window values and where each is."""

    def __init__(self, items: list[tuple[int, str]], k: int = LEAST):
        self.k, self.vocabulary = k, {}
        texts = [words(t) for _, t in items]
        for w in texts:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary))
        ids = [np.fromiter((self.vocabulary[x] for x in w), np.int64, len(w)) for w in texts]
        self.item_ids = [i for i, _ in items]
        self.sizes = np.array([len(x) for x in ids], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        at = [b + np.arange(max(0, len(x) - k + 1)) for b, x in zip(self.begin, ids, strict=False)]
        self.places = np.concatenate(at) if at else np.zeros(0, np.int64)
        values = np.concatenate([rolling(x, k) for x in ids]) if ids else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.places = values[order], self.places[order]

    def shared(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ids, place in items) of every window of k words that both have; equal values are checked word by word."""
        v = rolling(ids, self.k)
        known = np.concatenate([[0], np.cumsum(ids < 0)])
        p = np.flatnonzero(known[self.k :] == known[: -self.k]) if len(v) else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.values, v[p], "left"), np.searchsorted(self.values, v[p], "right")
        hit = high > low
        p, low, n = p[hit], low[hit], (high - low)[hit]
        doc = np.repeat(p, n)
        item = self.places[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(doc), bool)
        for j in range(self.k):
            same &= ids[doc + j] == self.words[item + j]
        return doc[same], item[same]


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of one document and one item from the places of shared windows: (place in document, in item, words), longest first.

    Windows that follow each other in both are one match. Repeatedly the longest match none of whose words is taken on either side is marked; of a match
    that is taken in part, what remains free with at least k words stays in play.
    """
    order = np.lexsort((doc, doc - item))
    d, i = doc[order], item[order]
    begin = np.flatnonzero(np.append(True, (np.diff(d) != 1) | (np.diff(d - i) != 0)))
    end = np.append(begin[1:], len(d)) - 1
    matches = [(int(d[e] - d[b]) + k, int(d[b]), int(i[b])) for b, e in zip(begin, end, strict=True)]
    if len(matches) == 1:
        return [(matches[0][1], matches[0][2], matches[0][0])]
    taken_d, taken_i = np.zeros(int(d.max() - d.min()) + k, bool), np.zeros(int(i.max() - i.min()) + k, bool)
    d0, i0 = int(d.min()), int(i.min())
    buckets: dict[int, list[tuple[int, int]]] = {}
    for n, a, b in matches:
        buckets.setdefault(n, []).append((a, b))
    tiles = []
    for n in range(max(buckets), k - 1, -1):
        for a, b in sorted(buckets.pop(n, [])):
            free = ~(taken_d[a - d0 : a - d0 + n] | taken_i[b - i0 : b - i0 + n])
            if free.all():
                tiles.append((a, b, n))
                taken_d[a - d0 : a - d0 + n] = taken_i[b - i0 : b - i0 + n] = True
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for s, e in zip(edges[::2], edges[1::2], strict=True):
                if e - s >= k:
                    buckets.setdefault(int(e - s), []).append((a + int(s), b + int(s)))
    return tiles


LEAKS = "doc_id bigint, item_id bigint, tiles int, longest int, covered int, item_words int"


def _leaks_of(seeds: Seeds, ids: list[int], texts: list[str | None]) -> Iterator[tuple]:
    get = seeds.vocabulary.get
    flat: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(flat))
        flat += [get(w, -1) for w in words(t)]
        flat.append(-1)
    doc, item = seeds.shared(np.array(flat, np.int64))
    if not len(doc):
        return
    d = np.searchsorted(starts, doc, "right") - 1
    i = np.searchsorted(seeds.begin, item, "right") - 1
    order = np.lexsort((i, d))
    d, i, doc, item = d[order], i[order], doc[order], item[order]
    begin = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (np.diff(i) != 0)))
    for a, b in zip(begin, np.append(begin[1:], len(d)), strict=True):
        tiles = tile(doc[a:b], item[a:b], seeds.k)
        yield ids[d[a]], seeds.item_ids[i[a]], len(tiles), max(n for _, _, n in tiles), sum(n for _, _, n in tiles), int(seeds.sizes[i[a]])


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, tiles, longest, covered, item_words): every document that shares a passage of at least ``least`` words with an item.

    tiles: passages found, none overlapping another in the document or the item; longest: words of the longest; covered: words of the item in any of
    them, whatever their order, so covered / item_words is the coverage that catches reordered items. Null, empty and shorter texts share none. A document without
    id is left out, as is an item without. Repeated ids count as one document or item each with its best row.

    The documents are read once for each block of items of at most ``block_chars`` characters (or one longer item), and aren't shuffled; what a task holds is bounded by that.
    """
    it = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null and text is not null").distinct()
    total = it.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    d = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    context = documents.sparkSession.sparkContext
    parts = []
    for block in range(blocks):
        held = [(r.item_id, r.text) for r in it.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").toLocalIterator()]
        shared = context.broadcast(held)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(shared.value, least)
            for b in batches:
                for a in range(0, b.num_rows, GROUP):
                    g = b.slice(a, GROUP)
                    found = list(_leaks_of(seeds, g.column("doc_id").to_pylist(), g.column("text").to_pylist()))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if j < 2 else pa.int32()) for j, c in enumerate(zip(*found, strict=True))], [f.split()[0] for f in LEAKS.split(", ")])

        parts.append(d.mapInArrow(search, LEAKS))
    best = F.max(F.struct("longest", "covered", "tiles", "item_words")).alias("b")
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.tiles", "b.longest", "b.covered", "b.item_words")
