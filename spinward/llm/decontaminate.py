"""Operator 5, benchmark decontamination: windows of the size of an item are held against the items by SimHash.

Words are those of the Jaccard join; weighted shingles are the five-word shingles of a window (all its words, if it has
fewer) with their counts. A window has as many words as the item, or is the whole text if that is shorter. The SimHash
of a window is looked up in a multi-index: 64 bits are cut into `RADIUS` + 1 blocks, and fingerprints within the radius
agree in one of them at least. Candidates within the radius are verified by the exact similarity of the weighted
shingles, sum of least over sum of greatest counts, 0.8 or more.

A window can't be as similar as that with fewer than 8/9 of its shingles among those of items of its length (for a whole
shorter text, the bound of its own sizes), so windows below this are not fingerprinted at all. The radius is 20 of 64 bits: at similarity
0.8 the expected distance is 10 with a deviation of 3, so one window in thousands of those just at the limit is lost.

Items are read in blocks of at most `block_words` words; each block is one pass over the documents. Null and empty texts
hold nothing, and such items are found nowhere. Repeated rows give repeated results; null ids stay null. Empty tables
give no rows. Other columns are not read (or, where documents are filtered, kept).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spinward.llm.common import bounded_batches, keep, raw
from spinward.llm.shingles import Words, rolled

SIZE, RADIUS = 5, 20
_BITS = np.arange(64, dtype=np.uint64)


def simhash(shingles: np.ndarray) -> int:
    """Sign of the sum, bit by bit; a shingle counts as often as it occurs."""
    ones = ((shingles[:, None] >> _BITS) & np.uint64(1)).sum(0, dtype=np.int64)
    return int(((2 * ones > len(shingles)).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def similarity(a: Counter, b: Counter) -> float:
    least = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return least / (a.total() + b.total() - least) if least else 0.0


def needed(a: int, b: int) -> int:
    """The least intersection of a and b shingles at similarity 0.8."""
    return -(-4 * (a + b) // 9)


class HammingIndex:
    """Finds all fingerprints within RADIUS: they agree with the query in one of RADIUS + 1 blocks of bits."""

    def __init__(self, prints: list[int]) -> None:
        edges = np.linspace(0, 64, RADIUS + 2).astype(int).tolist()
        self.blocks = [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.prints = np.array(prints, np.uint64)
        self.lists: list[dict[int, np.ndarray]] = []
        for lo, mask in self.blocks:
            at = defaultdict(list)
            for i, p in enumerate(prints):
                at[p >> lo & mask].append(i)
            self.lists.append({k: np.array(v) for k, v in at.items()})

    def within(self, p: int) -> list[tuple[int, int]]:
        """(index, distance)."""
        found = [x[v] for (lo, mask), x in zip(self.blocks, self.lists, strict=True) if (v := p >> lo & mask) in x]
        if not found:
            return []
        some = np.unique(np.concatenate(found))
        distance = np.bitwise_count(self.prints[some] ^ np.uint64(p))
        return [(int(i), int(d)) for i, d in zip(some[distance <= RADIUS], distance[distance <= RADIUS], strict=True)]


@dataclass
class Items:
    """Items of one shingle size: five words, or fewer for shorter items."""

    size: int
    ids: list = field(default_factory=list)
    words: list[int] = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)

    def ready(self) -> Items:
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.known = np.unique(np.concatenate(self.shingles))
        self.gate = np.zeros(1 << 22, bool)
        self.gate[self.known >> np.uint64(42)] = True
        self.lengths = sorted(set(self.words))
        self.index = {w: HammingIndex([simhash(s) for s, n in zip(self.shingles, self.words, strict=True) if n == w]) for w in self.lengths}
        self.lengths_of = defaultdict(set)
        for s, n in zip(self.shingles, self.words, strict=True):
            for x in s.tolist():
                self.lengths_of[x].add(n)
        self.of_length = {w: [i for i, n in enumerate(self.words) if n == w] for w in self.lengths}
        return self

    def find(self, words: np.ndarray) -> dict:
        """{item index: (similarity, -start, words of the window, distance)} of the best window of each item."""
        best: dict[int, tuple[float, int, int, int]] = {}
        if len(words) < self.size and self.size < SIZE:
            return best
        shingles = rolled(words, self.size)
        hits = self.gate[shingles >> np.uint64(42)]
        if not hits.any():
            return best
        at = np.flatnonzero(hits)
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        at = at[self.known[place] == shingles[at]]
        if len(at) == 0:
            return best
        hits_of = defaultdict(list)  # places of shingles that items of a length have
        for k, x in zip(at.tolist(), shingles[at].tolist(), strict=True):
            for w in self.lengths_of[x]:
                hits_of[w].append(k)
        prints: dict[tuple[int, int], int] = {}
        for w, places in hits_of.items():
            n = max(1, w - self.size + 1)
            own = min(n, len(shingles))
            if len(places) < needed(n, own):
                continue
            before = np.zeros(len(shingles) + 1, np.int64)
            before[np.array(places) + 1] = 1
            before = np.cumsum(before)
            starts = np.flatnonzero(before[own:] - before[:-own] >= needed(n, own))
            for s in starts.tolist():
                window = shingles[s : s + own]
                if (s, own) not in prints:
                    prints[s, own] = simhash(window)
                counts = None
                for i, distance in self.index[w].within(prints[s, own]):
                    counts = counts or Counter(window.tolist())
                    item = self.of_length[w][i]
                    if (got := similarity(counts, self.counts[item])) >= 0.8 and (got, -s) > best.get(item, (0, 0))[:2]:
                        best[item] = (got, -s, min(w, len(words)), distance)
        return best


def item_blocks(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_words: int = 1_000_000) -> Iterator[list[Items]]:
    """Items by shingle size, in blocks of bounded size; the driver holds one block at a time."""
    words, total, block = Words(), 0, {}
    for row in keep(items, id_col, text_col).toLocalIterator():
        own = words.hashes((row[1] or "").encode())
        if len(own) == 0:
            continue
        if total and total + len(own) > block_words:
            yield [x.ready() for x in block.values()]
            total, block = 0, {}
        total += len(own)
        size = min(SIZE, len(own))
        to = block.setdefault(size, Items(size))
        to.ids.append(row[0])
        to.words.append(len(own))
        to.shingles.append(rolled(own, size))
    if block:
        yield [x.ready() for x in block.values()]


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """(id, item, start, n_words, distance, similarity): the best window of each document for each item that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = keep(docs, id_col, text_col)
    kind = keep(items, item_col, item_text_col).dtypes[0][1]
    schema = f"`{id_col}` {docs.dtypes[0][1]}, `{item_col}` {kind}, start long, n_words long, distance int, similarity double"
    names = [id_col, item_col, "start", "n_words", "distance", "similarity"]
    item_type = pa.int64() if kind in ("bigint", "int") else pa.string()
    out = None
    for block in item_blocks(items, id_col=item_col, text_col=item_text_col, block_words=block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, groups = Words(), shared.value
            for batch in batches:
                rows, of = [], []
                for k, text in enumerate(raw(batch.column(1))):
                    own = words.hashes(text)
                    for group in groups:
                        for i, (got, start, n, distance) in group.find(own).items():
                            rows.append((group.ids[i], -start, n, distance, got))
                            of.append(k)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [item_type, pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=names)

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for block in item_blocks(items, id_col=item_col, text_col=item_text_col, block_words=block_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, groups = Words(), shared.value
            for batch in batches:
                hashes = [words.hashes(t) for t in raw(batch.column(at))]
                yield batch.filter(pa.array([not any(g.find(h) for g in groups) for h in hashes], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
