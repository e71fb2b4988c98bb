"""Operator 9, n-gram Jaccard join: exact links of documents whose shingle sets have a similarity of 0.8 or more.

Equal sets are one node, known by a digest of 128 bits. Nodes are linked in three steps.

1. Candidates. Two sets of that similarity share a member among the first |x| - ceil(0.8 |x|) + 1 of each, in any order
   common to both. The order is by rising frequency: members known to be frequent come last (a bounded table, see
   `frequent_members`; an incomplete table costs time, never links). The lists of these members are walked by partition,
   each split where sizes are too far apart. A list of up to `short` nodes gives its pairs; those that share too few of
   the first members for the similarity (prefixes are `extra` members longer than needed) fall out. A longer list ties
   its nodes to one of them.
2. Families. Nodes tied by candidates, directly or not, form a family, found by passing on least labels. In families too
   large for one task candidates are sought once more, with exact frequencies of all their members (see `_refined`).
3. Links. A family's sets meet in one task; one of more than `block` nodes or `most_members` members is dealt over several
   (see `_link_big`). Sets are told apart by all 128 bits here; candidates go by 64 of them, which can only add ties.
   There `link_sets` joins them exactly: index lists kept by size, in blocks that carry the best position and the
   component of their entries, so that whole blocks are passed over; and answers of a set are derived from those of a
   similar set by the triangle inequality on the size of symmetric differences, before sets are compared at all.

No list of links, labels or digests of all documents reaches the driver.

Documents without words, or null texts, have an empty set, are linked with nothing and keep their own id. With fewer
words than a shingle has, the whole sequence is the one member. Rows of equal text are one node, whatever their ids;
the component id is the least id that is not null (null if there is none). An empty table gives none. Other columns are
not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinward.llm.common import bounded_batches, cut, keep, raw
from spinward.llm.shingles import Words, set_digest, shingle_set

SIZE = 5
MEMBERS_HELD = 3_000_000
#: Similarity of 80 in 100.
OF, LEAST = 100, 80


def linked(common: int, a: int, b: int) -> bool:
    return OF * common >= LEAST * (a + b - common)


def least_common(a: int, b: int) -> int:
    """The least intersection at which sets of these sizes are linked: 180 c >= 80 (a + b)."""
    return -(-LEAST * (a + b) // (OF + LEAST))


def least_of(n: int) -> int:
    """The least intersection of a set of n with any set that it is linked with."""
    return -(-LEAST * n // OF)


def node_of(digest: bytes) -> int:
    """A signed 64-bit name of a set, used while candidates are sought."""
    return int.from_bytes(digest[:8], "little", signed=True)


def text_key(text_col: str) -> Column:
    """Tells rows of equal id apart; null is as empty."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


# --- sets and frequencies


def shingle_sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_shingles, digest, node, member, n): a row per document, and rows of members that a batch holds twice or more.

    Batches are parts of partitions, of about `MEMBERS_HELD` members. Rows of documents have a null member; rows of members
    have a null digest. A member in more documents than there are batches is held twice by one of them at least, so no
    frequent one is missed; its count may be too low.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), text_key(text_col).alias("key"))
    names = ["doc_id", "key", "n_shingles", "digest", "node", "member", "n"]

    def of_documents(ids: pa.Array, keys: pa.Array, sizes: list[int], digests: list) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([ids, keys, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([node_of(d) for d in digests], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=names)

    def of_members(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        members, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
        members, n = members[n > 1].view(np.int64), n[n > 1]
        for at in range(0, len(members), 100_000):
            some = members[at : at + 100_000]
            nulls = [pa.nulls(len(some), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(some), pa.array(n[at : at + 100_000], pa.int32())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, total = Words(), [], 0
        seen: set[bytes] = set()
        for batch in batches:
            sizes, digests = [], []
            for text in raw(batch.column(1)):
                members = shingle_set(words.hashes(text), SIZE)
                sizes.append(len(members))
                digests.append(set_digest(members))
                if digests[-1] not in seen:  # copies count once here
                    seen.add(digests[-1])
                    held.append(members)
                    total += len(members)
            yield of_documents(batch.column(0), batch.column(2), sizes, digests)
            if total > MEMBERS_HELD:
                yield from of_members(held)
                held, total = [], 0
                seen.clear()
        yield from of_members(held)

    return docs.mapInArrow(run, "doc_id long, key long, n_shingles long, digest binary, node long, member long, n int")


def frequent_members(counts: DataFrame, *, least: int = 12, most_kept: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
    """(members, counts), by member: the most frequent ones known, `most_kept` at most. Only the order of members depends on it."""
    summed = counts.groupBy("member").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sizes = summed.groupBy(F.floor(F.log2("n")).alias("size")).count().orderBy(F.desc("size")).collect()  # a few dozen rows
    total, floor = 0, None
    for r in sizes:
        if total + r["count"] > most_kept:
            break
        total, floor = total + r["count"], 2 ** int(r["size"])
    if floor is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = summed.where(F.col("n") >= floor).toArrow()
    members, n = rows.column("member").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(members)
    return members[order], n[order]


def ordered(members: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Members by rising known frequency, then by hash: the same order for all sets."""
    if len(frequent) == 0 or len(members) == 0:
        return members
    at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
    weight = np.where(frequent[at] == members, counts[at], 0)
    return members[np.lexsort((members, weight))]


# --- candidates


def prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], *, extra: int, text_col: str = "text", most_seen: int = 1_000_000) -> DataFrame:
    """(member, node, size): the first members of every set. Copies within a task are left out, so that a group of copies
    sends no more rows than there are tasks (a task that met `most_seen` sets starts anew)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (common, counts) = Words(), shared.value
        seen: set[bytes] = set()
        for batch in batches:
            members, nodes, sizes = [], [], []
            if len(seen) > most_seen:
                seen.clear()
            for text in raw(batch.column(0)):
                own = shingle_set(words.hashes(text), SIZE)
                digest = set_digest(own)
                n = len(own)
                if n and digest not in seen:
                    seen.add(digest)
                    node = node_of(digest)
                    first = ordered(own, common, counts)[: min(n, n - least_of(n) + 1 + extra)]
                    members.append(first.view(np.int64))
                    nodes.append(np.full(len(first), node, np.int64))
                    sizes.append(np.full(len(first), n, np.int32))
            columns = [np.concatenate(x) if x else np.zeros(0, k) for x, k in ((members, np.int64), (nodes, np.int64), (sizes, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["member", "node", "size"])

    return keep(docs, text_col).mapInArrow(run, "member long, node long, size int")


def candidate_ties(lists: DataFrame, *, short: int, extra: int) -> DataFrame:
    """(a, b, n): pairs of short lists, once for each list; ties of long lists with enough weight to stay.

    The rows of a member come together and in order of size. A list is cut where no set of the larger sizes can be
    linked with any before it. The walk holds `short` rows of a list at most, for a longer list only its last one.
    """
    enough = 1 + extra
    dealt = lists.repartition("member").sortWithinPartitions("member", "size", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, held, anchor = None, [], None  # anchor: the node that a long list ties to
        out: dict[tuple[int, int], int] = defaultdict(int)

        def pairs() -> None:
            for i, (x, n) in enumerate(held):
                for y, m in held[i + 1 :]:
                    if LEAST * m > OF * n:
                        break
                    out[(x, y) if x < y else (y, x)] += 1 if least_common(n, m) >= enough else enough

        def flush() -> pa.RecordBatch:
            keys = list(out)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([min(out[k], 1 << 20) for k in keys], pa.int32())], names=["a", "b", "n"])
            out.clear()
            return batch

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            m = columns[0]
            # rows whose member is that of no neighbour make no pair
            same = np.zeros(len(m), bool)
            if len(m):
                same[1:] = m[1:] == m[:-1]
                same[:-1] |= same[1:]
                same[[0, -1]] = True
            for key, node, size in zip(*[c[same].tolist() for c in columns], strict=True):
                if key != member:
                    pairs()
                    member, held, anchor = key, [], None
                if held and held[-1][0] == node:
                    continue
                if held and LEAST * size > OF * held[-1][1]:
                    pairs()
                    held, anchor = [], None
                if anchor is not None:
                    out[(anchor, node)] += enough
                    held = [(node, size)]
                    continue
                held.append((node, size))
                if len(held) > short:
                    anchor = held[0][0]
                    for x, _ in held[1:]:
                        out[(anchor, x)] += enough
                    held = [held[-1]]
            if len(out) > 200_000:
                yield flush()
        if anchor is None:
            pairs()
        yield flush()

    ties = dealt.mapInArrow(run, "a long, b long, n int")
    return ties.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= enough)


def families(ties: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, family) by least labels: every round ties the neighbours of a node to the least of them, until none change.

    Two rounds in turn (to larger neighbours, then to all) keep the number of ties and shorten paths by half, so that a
    path of any length takes a number of rounds in proportion to its logarithm.
    """
    edges = cut(ties.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "ties")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "ties")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("families did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("family")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("family")).distinct())


# --- links within a family


class Components:
    """Sets that are linked, directly or not."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.count = n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.count -= 1


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Block:
    """Successive entries of an index list: the least position of their member, and their component (-1: several)."""

    __slots__ = ("entries", "least", "root")

    def __init__(self) -> None:
        self.entries: list[tuple[int, int]] = []
        self.least, self.root = 1 << 60, -2


class _Lists:
    """All lists of a family, member by member, as one array; counts what a set has in common with every other one."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.members, starts, self.n_in = np.unique(every[order], return_index=True, return_counts=True)
        self.owner, self.starts, self.n = owner, starts, len(sets)

    def frequency(self, own: np.ndarray) -> np.ndarray:
        return self.n_in[np.searchsorted(self.members, own)]

    def common(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.members, own)
        at = at[self.n_in[at] > 1]
        if len(at) == 0:
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.owner[s:e] for s, e in zip(self.starts[at].tolist(), (self.starts[at] + self.n_in[at]).tolist(), strict=True)]), minlength=self.n)


def link_sets(sets: list[np.ndarray], *, block: int = 32, stats: dict | None = None) -> list[int]:
    """For each set the least index of a set that links lead to. Sets are sorted arrays without repeats, none empty.

    Sets come in order of size. A set is compared with pivots first, which are earlier sets that no earlier pivot is very
    similar to. With d the size of a symmetric difference, sets x and y of sizes m and n are linked just if
    9 d(x, y) <= m + n; and |d(p, x) - d(p, y)| <= d(x, y) <= d(p, x) + d(p, y) often tells without looking at x and y.
    """
    n = len(sets)
    parts = Components(n)
    told = stats if stats is not None else {}
    for k in ("compared", "derived", "skipped_blocks", "skipped_entries"):
        told.setdefault(k, 0)
    if n == 2:
        told["compared"] += 1
        if linked(_common(*sets), len(sets[0]), len(sets[1])):
            parts.join(0, 1)
    if n <= 2:
        return [parts.find(i) for i in range(n)]
    lists = _Lists(sets)
    size = [len(s) for s in sets]
    index: dict[int, list[_Block]] = defaultdict(list)
    pivots: list[int] = []
    to_pivot: dict[int, tuple[int, int]] = {}  # set: (pivot, difference)
    for done, x in enumerate(sorted(range(n), key=lambda i: (size[i], i))):
        own, m = sets[x], size[x]
        frequency = lists.frequency(own)
        order = np.lexsort((own, frequency))[: m - least_of(m) + 1]
        prefix = [(i, t) for i, (t, f) in enumerate(zip(own[order].tolist(), frequency[order].tolist(), strict=True)) if f > 1]
        near: dict[int, int] = {}  # pivot: difference
        best = None
        for p in pivots[-16:]:  # answers of the pivots that x is linked with hold for x
            if LEAST * m <= OF * size[p]:
                told["compared"] += 1
                near[p] = m + size[p] - 2 * _common(own, sets[p])
                if 9 * near[p] <= m + size[p]:
                    parts.join(x, p)
                if best is None or near[p] < near[best]:
                    best = p
        open_parts = parts.count - (n - done - 1)  # of x and the sets before it
        todo: list[int] = []
        if open_parts > 1:
            mine, seen = parts.find(x), set()
            for i, t in prefix:
                for b in index.get(t, ()):
                    first, last = b.entries[0][0], b.entries[-1][0]
                    if b.root >= 0 and parts.find(b.root) == mine or size[last] < least_of(m) or min(m - i, size[last] - b.least) < least_common(m, size[first]):
                        told["skipped_blocks"] += 1
                        continue
                    for y, j in b.entries:
                        if y in seen:
                            continue
                        k = size[y]
                        if k < least_of(m) or min(m - i, k - j) < least_common(m, k) or parts.find(y) == mine:
                            told["skipped_entries"] += 1
                            continue
                        seen.add(y)
                        p, dy = to_pivot[y]
                        if p in near and 9 * (near[p] + dy) <= m + k:
                            told["derived"] += 1
                            parts.join(x, y)
                            mine = parts.find(x)
                        elif p in near and 9 * abs(near[p] - dy) > m + k:
                            told["derived"] += 1
                        else:
                            todo.append(y)
        if len(todo) > 24:
            common = lists.common(own)
            for y in todo:
                if linked(int(common[y]), m, size[y]):
                    parts.join(x, y)
        else:
            for y in todo:
                if parts.find(y) != parts.find(x) and linked(_common(own, sets[y]), m, size[y]):
                    parts.join(x, y)
        told["compared"] += len(todo)
        if best is not None and 18 * near[best] <= m + size[best]:
            to_pivot[x] = (best, near[best])
        else:
            pivots.append(x)
            to_pivot[x] = (x, 0)
        root = parts.find(x)
        for i, t in prefix:
            blocks = index[t]
            if not blocks or len(blocks[-1].entries) >= block:
                blocks.append(_Block())
            b = blocks[-1]
            b.entries.append((x, i))
            b.least = min(b.least, i)
            b.root = root if b.root == -2 or b.root >= 0 and parts.find(b.root) == root else -1
    return [parts.find(i) for i in range(n)]


def _link_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of sets that come family by family and task by task."""
    key, nodes, sets = None, [], []
    out: list[tuple[bytes, bytes]] = []

    def close() -> None:
        if len(nodes) > 1:
            out.extend((x, nodes[r]) for x, r in zip(nodes, link_sets(sets), strict=True))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 2
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["node", "root"])
        out.clear()
        return batch

    for batch in batches:
        for family, task, node, members in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key != (family, task):
                close()
                key, nodes, sets = (family, task), [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(np.frombuffer(members, np.uint64))
        yield flush()
    close()
    yield flush()


def _link(sets: DataFrame) -> DataFrame:
    """(node, root) within each (family, task) of (family, task, digest, members); nodes are digests from here on."""
    dealt = sets.select("family", "task", "digest", "members").repartition("family", "task").sortWithinPartitions("family", "task", "digest")
    return cut(dealt.mapInArrow(_link_families, "node binary, root binary"), "links")


def _refined(sets: DataFrame, *, short: int, extra: int) -> DataFrame:
    """(node, family): families of (digest, node, members), from candidates by exact frequencies of all members.

    Members of one set alone come first in order and make no candidates, so only the others go on. Their frequencies come
    back by a join; those of the at most 100,000 members with as large a part of all rows are broadcast.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, nodes = [np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            sizes = np.array([len(m) for m in own], np.int32)
            for at in range(0, len(own), 64):
                n = sizes[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own[at : at + 64])), pa.array(np.repeat(nodes[at : at + 64], n)), pa.array(np.repeat(n, n))], names=["member", "node", "size"])

    rows = cut(sets.select("node", "members").mapInArrow(exploded, "member long, node long, size int"), "members")
    counts = cut(rows.groupBy("member").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    large = (counts.agg(F.sum("n")).first()[0] or 0) / 100_000
    hot = counts.where(F.col("n") >= max(large, 2))
    # hot members leave the shuffle: rows without a hot partner find theirs by the join
    marked = rows.join(F.broadcast(hot.withColumnRenamed("n", "hot_n")), "member", "left")
    cold = marked.where("hot_n IS NULL").drop("hot_n").join(counts.where(F.col("n") < max(large, 2)).hint("merge"), "member")
    known = cold.select("member", "node", "size", "n").unionByName(marked.where("hot_n IS NOT NULL").select("member", "node", "size", F.col("hot_n").alias("n")))
    of_node = Window.partitionBy("node")
    placed = known.select("*", F.row_number().over(of_node.orderBy("n", "member")).alias("at"), F.count("*").over(of_node).alias("shared"))
    alone = F.col("size") - F.col("shared")
    first = placed.where(F.col("at") + alone <= F.col("size") - F.ceil(F.col("size") * LEAST / OF) + 1 + extra)
    return families(candidate_ties(first.select("member", "node", "size"), short=short, extra=extra))


def _link_big(sets: DataFrame, block: int, most_members: int, hubs: int = 1000) -> DataFrame:
    """(node, root) of families too large for one task: (digest, family, of, weight, members).

    First the sets of every block meet about `hubs` sets of their family, the same in all blocks. That ties most of a
    group of copies together. What is not with the family's largest component then meets every block, in chunks. Two sets
    of the largest component need not be compared any more, so no link is lost, and work grows with the number of blocks
    times the chunks that are left.
    """
    sets = sets.withColumn("parts", F.greatest(F.ceil(F.col("of") / block), F.ceil(F.col("weight") / most_members)).cast("int"))
    mine = sets.withColumn("own", F.pmod(F.xxhash64("digest", F.lit(1)), F.col("parts")).cast("int"))
    hub = F.pmod(F.xxhash64("digest", F.lit(2)), F.greatest(F.ceil(F.col("of") / max(1, min(hubs, block))), F.col("parts"))) == 0
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    first = _link(mine.select("family", F.explode(F.when(hub, every).otherwise(F.array("own"))).alias("task"), "digest", "members"))
    ties = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    found = cut(families(ties).withColumnRenamed("family", "root"), "roots")

    of = sets.select(F.col("digest").alias("node"), "family", "parts", "of").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = of.groupBy("family", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    left = of.join(largest, "family").where("root <> largest").select(F.col("node").alias("digest"), "family", "parts", "of")
    chunks = left.groupBy("family").agg(F.ceil(F.count("*") * F.max("parts") / F.max("of")).cast("int").alias("chunks"))
    if chunks.isEmpty():
        return found
    again = mine.join(chunks, "family").join(left.select("digest", F.lit(True).alias("left")), "digest", "left")
    # a task is a chunk and a block; sets that are left also go to all blocks of their chunk
    chunk = F.pmod(F.xxhash64("digest", F.lit(3)), F.col("chunks")).cast("int")
    of_block = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c * F.col("parts") + F.col("own"))
    of_chunk = F.transform(every, lambda b: chunk * F.col("parts") + b)
    tasks = F.when(F.col("left"), F.array_distinct(F.concat(of_block, of_chunk))).otherwise(of_block)
    second = _link(again.select("family", F.explode(tasks).alias("task"), "digest", "members"))
    both = ties.unionByName(second.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return families(both).withColumnRenamed("family", "root")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", short: int = 24, extra: int = 3, block: int = 10_000, most_members: int = 20_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, root) for each row of docs; root names the component (null without words)."""
    bounded_batches(docs.sparkSession)
    made = cut(shingle_sets(docs, id_col=id_col, text_col=text_col), "sets")
    sets = made.where("digest IS NOT NULL").select("doc_id", "key", "n_shingles", "digest", "node")
    frequent = frequent_members(made.where("digest IS NULL").select("member", "n"))
    ties = candidate_ties(prefixes(docs, frequent, extra=extra, text_col=text_col), short=short, extra=extra)
    family = families(ties)
    nodes = sets.where("n_shingles > 0").groupBy("digest", "node", "n_shingles").agg(F.min("doc_id").alias("first"))

    # the sets of a family, made again from one row of each node
    def sized(of: DataFrame) -> DataFrame:
        return of.groupBy("family").agg(F.count("*").alias("of"), F.sum("n_shingles").alias("weight"))

    placed = nodes.join(family, "node")
    wanted = placed.join(sized(placed), "family").select("digest", "first", "family", "of", "weight")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("first"))).select("text", "digest", "family", "of", "weight")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            own = [shingle_set(words.hashes(t), SIZE) for t in raw(batch.column(0))]
            right = pa.array([set_digest(s) == x for s, x in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            made = pa.array([s.tobytes() for s in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made], names=["digest", "family", "of", "weight", "members"]).filter(right)

    shipped = rows.mapInArrow(members, "digest binary, family long, of long, weight long, members binary")
    fits = (F.col("of") <= block) & (F.col("weight") <= most_members)
    roots = _link(shipped.where(fits).withColumn("task", F.lit(0)))
    if not wanted.where(~fits).isEmpty():
        big = cut(shipped.where(~fits).dropDuplicates(["digest"]).select("digest", "members", (F.octet_length("members") / 8).cast("long").alias("n_shingles")).join(nodes.select("digest", "node"), "digest"), "big")
        again = cut(big.join(_refined(big, short=short, extra=extra), "node"), "refined")
        again = again.join(sized(again), "family")
        roots = roots.unionByName(_link(again.where(fits).withColumn("task", F.lit(0))))
        if not again.where(~fits).isEmpty():
            roots = roots.unionByName(_link_big(again.where(~fits), block, most_members))
    known = nodes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    out = sets.join(known.join(least, "root").select("digest", "root", "component_id"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "key", "root")


def keep_one(docs: DataFrame, components: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, that of least id, and all rows without an id; all columns stay as they are.

    Rows without words are linked with nothing: one of each id and text stays. Of rows of equal id and text one stays; rows
    of equal id but other texts stay or go with their own component, the least digest of text leading within one. An
    empty table gives none.
    """
    known = components.where("doc_id IS NOT NULL")
    lead = known.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("lead")).select("lead.*")
    chosen = lead.unionByName(known.where("root IS NULL").select("doc_id", "key").distinct())
    counted = known.join(chosen, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    all_rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("key"))
    rows = all_rows.where("doc_id IS NOT NULL").join(counted, ["doc_id", "key"])
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy(F.lit(0)))
    again = rows.where("copies > 1").withColumn("nth", nth).where("nth = 1").select("row")
    return rows.where("copies = 1").select("row").unionByName(again).unionByName(all_rows.where("doc_id IS NULL").select("row")).select("row.*")
