"""Benchmark decontamination by greedy string tiling over Karp-Rabin seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, release, split_words

FOUND = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int, tiles array<struct<item_start:int,doc_start:int,length:int>>"
#: Base of the running hash, and words of benchmark items that go to the tasks at once.
BASE = np.uint64(0x9E3779B97F4A7C15)
SLICE_WORDS = 2_000_000
TABLE_BITS = 22
#: Pairs of equal windows that are looked at at once, about.
PAIRS = 1 << 20


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """A hash of each token, equal within a process; tokens decide in the end, so collisions cost time only."""
    return np.fromiter(map(hash, tokens), np.int64, len(tokens)).view(np.uint64)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The running Karp-Rabin hash of every window of ``length`` tokens, modulo 2**64."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, length):
        out *= BASE
        out += hashes[i : i + n]
    return out


def _runs(item: list[bytes], doc: list[bytes], i: np.ndarray, j: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches (item start, doc start, tokens) from starts of equal windows: runs on a diagonal, by real tokens."""
    if not len(i):
        return []
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    ends = np.append(start[1:], len(i))
    return _real(item, doc, zip(i[start].tolist(), j[start].tolist(), (ends - start + length - 1).tolist(), strict=True), length)


def _real(item: list[bytes], doc: list[bytes], runs: Iterable[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Runs of equal hashes, cut where their tokens differ."""
    out = []
    for at_i, at_j, size in runs:
        if item[at_i : at_i + size] == doc[at_j : at_j + size]:
            out.append((at_i, at_j, size))
            continue
        same = [x == y for x, y in zip(item[at_i : at_i + size], doc[at_j : at_j + size], strict=True)]
        out += _stretches(same, at_i, at_j, length)
    return out


def _stretches(free: list[bool], at_i: int, at_j: int, least: int) -> list[tuple[int, int, int]]:
    out, first = [], None
    for n, ok in enumerate([*free, False]):
        if ok and first is None:
            first = n
        elif not ok and first is not None:
            if n - first >= least:
                out.append((at_i + first, at_j + first, n - first))
            first = None
    return out


def tile(item: list[bytes], doc: list[bytes], i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of an item and a document whose windows of ``least`` tokens are equal at the starts ``i`` and ``j``."""
    return tile_runs(len(item), len(doc), _runs(item, doc, i, j, least), least)


def tile_runs(item: int, doc: int, runs: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: again and again the longest match of unmarked tokens becomes a tile and is marked.

    ``runs`` are the maximal matches of texts of ``item`` and ``doc`` tokens. Matches of equal length go by their
    place in the item, then in the document. What marks leave of a match stays in play while it has ``least`` tokens.
    """
    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    marked_item, marked_doc, tiles, left = bytearray(item), bytearray(doc), [], item
    while heap and left >= least:
        n, a, b = heapq.heappop(heap)
        n = -n
        if 0 not in marked_item[a : a + n] or 0 not in marked_doc[b : b + n]:
            continue
        if 1 in marked_item[a : a + n] or 1 in marked_doc[b : b + n]:
            free = [not (x or y) for x, y in zip(marked_item[a : a + n], marked_doc[b : b + n], strict=True)]
            for a2, b2, n2 in _stretches(free, a, b, least):
                heapq.heappush(heap, (-n2, a2, b2))
            continue
        tiles.append((a, b, n))
        marked_item[a : a + n] = marked_doc[b : b + n] = b"\x01" * n
        left -= n
    return sorted(tiles)


class Seeds:
    """The windows of ``length`` tokens of some items, sorted by hash, behind a bit table that most windows of a document miss."""

    def __init__(self, items: list[tuple[int, list[bytes]]], length: int) -> None:
        self.items, self.length = items, length
        seeds = [window_hashes(token_hashes(t), length) for _, t in items]
        self.sizes = np.array([len(s) for s in seeds], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.windows = np.concatenate(seeds)
        order = np.argsort(self.windows, kind="stable")
        self.hashes, self.at = self.windows[order], order
        self.owner = np.repeat(np.arange(len(items)), self.sizes)
        self.shift = np.uint64(64 - TABLE_BITS)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True

    def runs(self, hashes: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Item and the maximal runs of equal windows (item start, doc start, tokens), from the hashes of a document's tokens.

        Of all pairs of equal windows only those are kept at which a run starts or ends, some pairs at a time, as
        repetitive texts have a pair for nearly each two places but few runs.
        """
        windows = window_hashes(hashes, self.length)
        j = np.flatnonzero(self.table[(windows >> self.shift).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, windows[j], side) for side in ("left", "right"))
        j, low, count = j[high > low], low[high > low], (high - low)[high > low]
        if not len(j):
            return
        ends = np.cumsum(count)
        part = (ends - count) // PAIRS
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        starts, stops = [], []
        for a, b in zip(edges, [*edges[1:], len(j)], strict=True):
            n = count[a:b]
            at = self.at[np.repeat(low[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            y, owner = np.repeat(j[a:b], n), self.owner[at]
            x = at - self.first[owner]
            goes_on = lambda ok, by, at=at, y=y: np.where(ok, self.windows[np.where(ok, at + by, 0)] == windows[np.where(ok, y + by, 0)], False)
            start = ~goes_on((x > 0) & (y > 0), -1)
            stop = ~goes_on((x + 1 < self.sizes[owner]) & (y + 1 < len(windows)), 1)
            starts.append(np.stack([owner, y - x, x])[:, start])
            stops.append(np.stack([owner, y - x, x])[:, stop])
        starts, stops = (np.concatenate(part, 1) for part in (starts, stops))
        starts, stops = (part[:, np.lexsort(part[::-1])] for part in (starts, stops))
        size = stops[2] - starts[2] + self.length
        cuts = np.flatnonzero(np.append(True, np.diff(starts[0]) != 0)).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(size)], strict=True):
            x = starts[2, a:b]
            yield int(starts[0, a]), list(zip(x.tolist(), (x + starts[1, a:b]).tolist(), size[a:b].tolist(), strict=True))


class Benchmark:
    """Items by the length of their tiles: ``least`` tokens, or all they have if these are fewer."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        by: dict[int, list[tuple[int, list[bytes]]]] = {}
        for item_id, text in items:
            if tokens := split_words(text):
                by.setdefault(min(least, len(tokens)), []).append((item_id, tokens))
        self.seeds = [Seeds(held, length) for length, held in sorted(by.items())]

    def hits(self, text: str | None) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """The item's id, its number of tokens and the tiles, for items that share a seed with the text."""
        doc = split_words(text)
        hashes = token_hashes(doc)
        for seeds in self.seeds:
            for n, runs in seeds.runs(hashes):
                item_id, item = seeds.items[n]
                if tiles := tile_runs(len(item), len(doc), _real(item, doc, runs, seeds.length), seeds.length):
                    yield item_id, len(item), tiles


def item_slices(benchmark: DataFrame, slice_words: int) -> Iterator[tuple[bool, list[tuple[int, str]]]]:
    """The items in slices of about ``slice_words`` words, by a hash of their text; at least one slice. True comes with the last."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)))).first()[0] or 0
    slices = max(1, -(-words // slice_words))
    for number in range(slices):
        yield number == slices - 1, [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == number).collect()]


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """Pairs of a document and a benchmark item of which tiles cover at least ``threshold``: doc_id, item_id, coverage, n_tiles, longest_tile, tiles.

    Tokens are lower-cased words; tiles are matches of at least ``least`` tokens, so passages whose sentences were
    reordered keep their coverage. An item with fewer tokens is a tile as a whole. Null texts and texts without words
    take no part; repeated rows on either side give a row for each pair, null ids too. Documents are read where they are, without a shuffle. Items go
    to the tasks in slices of about ``slice_words`` words, one pass over the documents each. What a slice finds is written
    before the next one is read, so the driver and a task hold one slice however large the benchmark is.
    """

    def one(part: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Benchmark(part, least)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.struct([(n, pa.int32()) for n in ("item_start", "doc_start", "length")]))]
            for batch in batches:
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for n, size, tiles in known.hits(text.as_py()):
                        covered = sum(t[2] for t in tiles) / size
                        if covered >= threshold:
                            out.append((doc_id, n, covered, len(tiles), max(t[2] for t in tiles), [dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in tiles]))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

        return docs.select("doc_id", "text").mapInArrow(run, FOUND)

    found = (one(part) if last else materialize(one(part), "hits") for last, part in item_slices(benchmark, slice_words))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, least: int = 5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``contaminations`` finds no item in.

    What a slice of the benchmark leaves is written before the next slice is read, and goes when that one's is.
    """
    out, at, before = docs, docs.columns.index("text"), None
    for last, part in item_slices(benchmark, slice_words):

        def run(batches: Iterator[pa.RecordBatch], part=part) -> Iterator[pa.RecordBatch]:
            known = Benchmark(part, least)
            for batch in batches:
                clean = [all(sum(t[2] for t in tiles) < threshold * size for _, size, tiles in known.hits(x.as_py())) for x in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
        if not last:
            out = materialize(out, "clean")
            release(before)
            before = out
    return out
