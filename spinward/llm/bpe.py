"""Operator 10, byte-level BPE: each partition encodes its distinct words by recursive DuckDB queries.

A word is a match of the split pattern. Token-position rows of all words join the merge table; each step contracts the
leftmost pair of least rank of every word, until no pair of a word can merge. The bytes of a word come back from its ids
by an ordered aggregation. Ids and bytes of a document are those of its words in turn, so a word is encoded once,
however often it occurs. A task keeps the words of its partition in two generations of `cache_size` words; words that one
generation has not met are forgotten and encoded anew when they come again.

A word of more than 64 bytes is encoded by stretches, which are joined where the seam between them holds and encoded
anew around it where it doesn't, so the work grows with the length of a word, not its square.

Null and empty texts have no ids. Words may have any length. Repeated rows give repeated results, an empty table gives none, null ids stay null.
Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spinward.llm.common import bounded_batches, keep, pieces

#: A word is a list of tokens; each step lays it out as token-position rows, which join the merge table, and contracts the
#: pair of least rank, the leftmost of several. Finished words drop out. A key of rank and position orders pairs.
ENCODE = """
WITH RECURSIVE bpe AS (
    SELECT w, ts, 0 AS step FROM seed
    UNION ALL
    (WITH pair AS (
        SELECT a.w, min(m.n * 1024 + a.p) AS k
        FROM (SELECT w, p, ts[p] AS t, ts[p + 1] AS r FROM (SELECT w, ts, unnest(range(1, len(ts))) AS p FROM bpe)) a
        JOIN merges m ON a.t = m.l AND a.r = m.r
        GROUP BY a.w)
    SELECT x.w, x.ts[:k % 1024 - 1] || [(k // 1024)::INT] || x.ts[k % 1024 + 2:], x.step + 1
    FROM bpe x JOIN pair ON x.w = pair.w)
)
SELECT w, arg_max(ts, step) AS ts FROM bpe GROUP BY w
"""

#: The same for stretches of a thousand bytes and more: all occurrences of the pair of least rank, from the left, none over
#: another, up to and with the first whose contraction makes a pair of lower rank, which comes next then. That is what one
#: contraction after the other comes to, for any merge table. It stops after some steps.
ENCODE_LONG = """
WITH RECURSIVE bpe AS (
    SELECT w, p, t, 0 AS step FROM seed
    UNION ALL
    (WITH pair AS (
        SELECT a.w, a.p, m.n, a.before, a.after
        FROM (SELECT w, p, t, lead(t) OVER s AS r, lag(t) OVER s AS before, lead(t, 2) OVER s AS after
              FROM bpe WHERE step < {steps} WINDOW s AS (PARTITION BY w ORDER BY p)) a
        JOIN merges m ON a.t = m.l AND a.r = m.r),
    low AS (SELECT w, min(n) AS n FROM pair GROUP BY w),
    run AS (SELECT pair.*, p - row_number() OVER (PARTITION BY pair.w ORDER BY p) AS run FROM pair JOIN low USING (w, n)),
    each AS (SELECT w, p, n, CASE WHEN nth > 0 THEN n ELSE before END AS before, after
             FROM (SELECT *, p - min(p) OVER (PARTITION BY w, run) AS nth FROM run) WHERE nth % 2 = 0),
    stop AS (SELECT e.w, min(e.p) AS p FROM each e
             LEFT JOIN merges x ON x.l = e.before AND x.r = e.n LEFT JOIN merges y ON y.l = e.n AND y.r = e.after
             WHERE x.n < e.n OR y.n < e.n GROUP BY e.w),
    hit AS (SELECT e.w, e.p, e.n FROM each e LEFT JOIN stop s ON s.w = e.w WHERE s.p IS NULL OR e.p <= s.p)
    SELECT x.w, (row_number() OVER (PARTITION BY x.w ORDER BY x.p) - 1)::INT, coalesce(h.n, x.t), x.step + 1
    FROM bpe x JOIN low ON x.w = low.w LEFT JOIN hit h ON h.w = x.w AND h.p = x.p LEFT JOIN hit g ON g.w = x.w AND g.p = x.p - 1
    WHERE g.w IS NULL)
), last AS (SELECT w, max(step) AS step FROM bpe GROUP BY w)
SELECT w, p, t, step FROM bpe JOIN last USING (w, step)
"""
#: Words of more bytes are encoded by stretches of as many.
LONG = 64
#: The bytes of what ENCODE takes at most: positions are below 1,024.
MOST = 1000

DECODE = """
SELECT w, unhex(string_agg(v.hex, '' ORDER BY p)) AS bytes
FROM (SELECT w, unnest(range(len(ts))) AS p, unnest(ts) AS t FROM fixpoint) JOIN vocabulary v ON v.id = t
GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class WordCodec:
    """Encodes and decodes words by the ranks of one file."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.ranks = read_ranks(path)
        self.of_token = {n: t for t, n in self.ranks.items()}
        self.seams: dict[tuple[int, int], bool] = {}
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
        self.db.register("merges_", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "n": pa.array(made, pa.int32())}))
        self.db.register("vocabulary_", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        for name in ("merges", "vocabulary"):
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")

    def seed(self, words: list[bytes]) -> pa.Table:
        """(w, ts): the words' bytes as tokens."""
        ends = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int32)]).astype(np.int32)
        tokens = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "ts": pa.ListArray.from_arrays(ends, tokens)})

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The tokens of each word when no pair of them can merge any more. Words have MOST bytes at most, or all have more."""
        if not words:
            return []
        self.db.register("seed_", self.seed(words))
        if max(map(len, words)) <= MOST:
            self.db.execute("CREATE OR REPLACE TEMP TABLE seed AS SELECT * FROM seed_")
            out = self.db.sql(f"SELECT ts FROM ({ENCODE}) ORDER BY w").fetchnumpy()["ts"]
        else:  # some steps at a time, so that a query holds a few states of the words, not all
            self.db.execute("CREATE OR REPLACE TEMP TABLE seed AS SELECT w, unnest(range(len(ts)))::INT AS p, unnest(ts) AS t FROM seed_")
            steps = max(1, 2_000_000 // sum(map(len, words)))
            while True:
                self.db.execute(f"CREATE OR REPLACE TEMP TABLE reached AS {ENCODE_LONG.format(steps=steps)}")
                if self.db.execute("SELECT coalesce(max(step), 0) FROM reached").fetchall()[0][0] < steps:
                    break
                self.db.execute("CREATE OR REPLACE TEMP TABLE seed AS SELECT w, p, t FROM reached")
            out = self.db.sql("SELECT list(t ORDER BY p) AS ts FROM reached GROUP BY w ORDER BY w").fetchnumpy()["ts"]
        self.db.unregister("seed_")
        return [x.tolist() for x in out]

    # --- long words
    #
    # Two encodings that stand side by side are the encoding of the whole if the tokens at the seam, encoded together, stay
    # as they are: merges within a token follow each other alike whatever is beside it, and a merge over the seam would
    # be met by these two tokens alone. So stretches are encoded apart, and only what is beside a seam that does not hold is
    # encoded anew. The number of steps depends on the length of stretches, not on that of words.

    def bytes_of(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.of_token.__getitem__, tokens))

    def holds(self, seams: list[tuple[int, int]]) -> list[bool]:
        """Whether two tokens that stand side by side stay apart."""
        if len(self.seams) > 400_000:
            self.seams.clear()
        new = list({s for s in seams if s not in self.seams})
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for s, got in zip(some, self.contract([self.bytes_of(list(s)) for s in some]), strict=True):
                self.seams[s] = got == list(s)
        return [self.seams[s] for s in seams]

    def join(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The encoding of the bytes of each two encodings together."""
        out: list[list[int] | None] = [a + b if ok else None for (a, b), ok in zip(pairs, self.holds([(a[-1], b[0]) for a, b in pairs]), strict=True)]
        for k in (2, 8):  # so many tokens on either side of the seam
            todo = [i for i, x in enumerate(out) if x is None]
            middles = self.contract([self.bytes_of(pairs[i][0][-k:] + pairs[i][1][:k]) for i in todo])
            seams = [s for i, m in zip(todo, middles, strict=True) for s in (((pairs[i][0][-k - 1 : -k] or [None])[0], m[0]), (m[-1], (pairs[i][1][k : k + 1] or [None])[0]))]
            ok = iter(self.holds([s for s in seams if None not in s]))
            fine = [None in s or next(ok) for s in seams]
            for n, (i, m) in enumerate(zip(todo, middles, strict=True)):
                if fine[2 * n] and fine[2 * n + 1]:
                    out[i] = pairs[i][0][:-k] + m + pairs[i][1][k:]
        return [self.creep(a, b) if x is None else x for (a, b), x in zip(pairs, out, strict=True)]

    def creep(self, a: list[int], b: list[int], step: int = 4096) -> list[int]:
        """The same for one pair: back into a as far as it takes, then on through b until a seam holds."""
        done, ahead = list(a), 0
        while True:
            head, k = b[ahead : ahead + step], 32
            while True:
                some = self.contract([self.bytes_of(done[-k:] + head)])[0]
                if len(done) <= k or self.holds([(done[-k - 1], some[0])])[0]:
                    break
                k *= 4
            done[-k:] = some
            ahead += step
            if ahead >= len(b):
                return done
            if self.holds([(done[-1], b[ahead])])[0]:
                return done + b[ahead:]

    def encode_long(self, words: list[bytes], stretch: int = LONG) -> list[list[int]]:
        """Tokens of words of any length, by stretches that are joined two by two."""
        cuts = [[w[i : i + stretch] for i in range(0, len(w), stretch)] for w in words]
        kinds = list(set().union(*cuts))
        known: dict[bytes, list[int]] = {}
        for at in range(0, len(kinds), 4000):
            some = kinds[at : at + 4000]
            known.update(zip(some, self.contract(some), strict=True))
        parts = [[known[s] for s in c] for c in cuts]
        while any(len(p) > 1 for p in parts):
            joined = iter(self.join([(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]))
            parts = [[next(joined) if i + 1 < len(p) else p[i] for i in range(0, len(p), 2)] for p in parts]
        return [p[0] for p in parts]

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word its ids, as little-endian 32-bit integers, and what these ids decode to. Words are short or all long.

        A word that is a token itself is that one: the library looks it up first.
        """
        if not words:
            return []
        whole = [self.ranks.get(w) for w in words]
        rest = [w for w, t in zip(words, whole, strict=True) if t is None]
        made = iter(self.contract(rest) if max(map(len, words)) <= LONG else self.encode_long(rest))
        tokens = [next(made) if t is None else [t] for t in whole]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int32)]).astype(np.int32)
        flat = np.fromiter((x for t in tokens for x in t), np.int32, int(ends[-1]))
        self.db.register("fixpoint", pa.table({"w": pa.array(np.arange(len(words), dtype=np.int32)), "ts": pa.ListArray.from_arrays(ends, flat)}))
        decoded = self.db.sql(DECODE).to_arrow_table().column("bytes").to_pylist()
        self.db.unregister("fixpoint")
        packed = flat.astype("<u4").tobytes()
        return [(packed[4 * a : 4 * b], x) for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), decoded, strict=True)]


@functools.lru_cache(2)
def _codec(path: str) -> WordCodec:
    return WordCodec(path)


class WordTable:
    """Ids and bytes of the words met last: a young generation and the one before it."""

    def __init__(self, codec: WordCodec) -> None:
        self.codec = codec
        self.ids: dict[str, bytes] = {}
        self.bytes: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def meet(self, words: set[str], words_per_query: int, cache_size: int) -> None:
        """Afterwards all of these words are in `ids` and `bytes`."""
        if len(self.ids) > cache_size:
            self.old, self.ids, self.bytes = (self.ids, self.bytes), {}, {}
        ids, decoded = self.old
        new = []
        for w in words.difference(self.ids):
            if w in ids:
                self.ids[w], self.bytes[w] = ids[w], decoded[w]
            else:
                new.append(w)
        raw_words = sorted(((w.encode(), w) for w in new), key=lambda x: len(x[0]))  # few steps run over many rows
        long = next((i for i, (b, _) in enumerate(raw_words) if len(b) > LONG), len(raw_words))
        for some in (raw_words[:long], raw_words[long:]):
            for part in pieces(some, [len(b) for b, _ in some], 8 * words_per_query):
                for (_, w), (a, b) in zip(some[part], self.codec.encode([b for b, _ in some[part]]), strict=True):
                    self.ids[w], self.bytes[w] = a, b


@functools.lru_cache(4)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", words_per_query: int = 120_000, cache_size: int = 200_000) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, decoded binary: the bytes of these ids) for each row of docs."""
    bounded_batches(docs.sparkSession, 2048)  # each query of a batch has its fixed costs
    docs = keep(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = WordTable(_codec(ranks_path)), _splitter(pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in pieces(texts, [len(t) for t in texts], 4 << 20):
                words = [split.findall(t) for t in texts[part]]
                known.meet(set().union(*words), words_per_query, cache_size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], pa.array([b"".join(map(known.ids.__getitem__, x)) for x in words], pa.binary()), pa.array([b"".join(map(known.bytes.__getitem__, x)) for x in words], pa.binary())],
                    names=[id_col, "ids", "decoded"],
                )

    return docs.mapInArrow(run, f"`{id_col}` {docs.dtypes[0][1]}, ids binary, decoded binary")
