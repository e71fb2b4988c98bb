"""Operator 3, document fingerprints (I-Match): digests of a document's terms within several random parts of a lexicon.

A term is a lower-cased run of characters other than ASCII white space and punctuation. The lexicon holds the terms
whose inverse document frequency lies within a band: in `least` of the documents or more, and in `most` or fewer, with
document frequencies counted over all documents. It can't have more than (mean distinct terms of a document) / least
terms, however many documents there are, so it fits the driver and the workers. Each of `RATES` draws several random
subsets of the lexicon, from sparse to dense; a subset's digest is that of the document's distinct terms in it, sorted.
The likeness of two fingerprints is the share of subsets with equal digests among those that hold a term of either.

A document without a term in any subset gets a digest of its whole text in their place, so equal texts always have equal
fingerprints and it is unlike every other text. Null texts count as empty. Repeated rows give repeated results, an
empty table gives none. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinward.llm.common import bounded_batches, keep, raw

#: Shares of the lexicon that a subset draws, and so many subsets of each.
RATES, EACH = (1 / 32, 1 / 64, 1 / 128, 1 / 256), 8
K = len(RATES) * EACH
_TERMS = bytes((c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c) for c in range(256))


def terms(text: bytes) -> set[bytes]:
    return set(text.translate(_TERMS).split())


def document_frequencies(docs: DataFrame, *, text_col: str = "text", most_held: int = 400_000) -> DataFrame:
    """(term, n): counts of each partition, then summed."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            names, counts = pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())
            for at in range(0, len(held), 50_000):
                yield pa.RecordBatch.from_arrays([names[at : at + 50_000], counts[at : at + 50_000]], names=["term", "n"])
            held.clear()

        for batch in batches:
            for text in raw(batch.column(0)):
                held.update(terms(text))
                if len(held) > most_held:
                    yield from out()
        yield from out()

    return keep(docs, text_col).mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit_lexicon(docs: DataFrame, *, text_col: str = "text", least: float = 0.003, most: float = 0.5, floor: int = 2) -> list[bytes]:
    """The terms within the band, sorted. At least `floor` documents must hold a term."""
    n = docs.count()
    low, high = max(floor, least * n), max(floor, most * n)
    rows = document_frequencies(docs, text_col=text_col).where(F.col("n").between(low, high)).select("term").toArrow()
    return sorted(rows.column(0).to_pylist())


class Fingerprinter:
    """Digests of texts over the subsets of one lexicon."""

    def __init__(self, lexicon: list[bytes], seed: int = 17) -> None:
        limits = [rate * 2.0**32 for rate in RATES for _ in range(EACH)]
        self.of: dict[bytes, tuple[int, int]] = {}
        for t in lexicon:
            own = 0
            for r, limit in enumerate(limits):
                own |= (xxhash.xxh32_intdigest(t, seed + r) < limit) << r
            self.of[t] = (own, xxhash.xxh64_intdigest(t, seed))

    def digests(self, text: bytes) -> np.ndarray:
        """K digests, 0 for subsets without a term; those of the whole text if no subset has one."""
        found = sorted({self.of[t] for t in terms(text) if t in self.of}, key=lambda x: x[1])
        member = np.array([x[0] for x in found], np.uint64)
        names = np.array([x[1] for x in found], np.uint64)
        out = np.zeros(K, np.uint32)
        for r in range(K):
            own = names[(member >> np.uint64(r)) & np.uint64(1) == 1]
            if len(own):
                out[r] = xxhash.xxh32_intdigest(own.tobytes()) | 1
        return out if out.any() else np.frombuffer(hashlib.sha256(b"whole:" + text).digest(), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) != len(b):
        return 0.0
    if len(a) != K:
        return float((a == b).all())
    some = (a != 0) | (b != 0)
    return float((a == b)[some].mean()) if some.any() else 1.0


def text_of(digests: np.ndarray) -> str:
    return digests.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, lexicon: list[bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = keep(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(maker.digests(t)) for t in raw(batch.column(1))], pa.string())], names=[id_col, "fingerprint"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.dtypes[0][1]}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as many first characters of the following text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _longs(values: list) -> Column:
    """A literal array; None is null."""
    return F.transform(F.split(F.lit(",".join("" if v is None else str(int(v)) for v in values)), ","), lambda x: F.when(x != "", x).cast("bigint")) if values else F.array().cast("array<bigint>")


def compare_neighbours(docs: DataFrame, lexicon: list[bytes], *, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 2000, most_buckets: int = 2048) -> DataFrame:
    """Each document against its edited text and against the next document, by descending id; the first follows the last.

    Documents go to buckets of successive ids, whose limits are quantiles of the ids. A bucket also gets the first
    document of the next one, so that no task sees more than its bucket. Rows of equal id follow each other by their
    texts; rows without an id are the last.
    """
    import zstandard

    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    buckets = max(1, min(most_buckets, docs.count() // rows_per_bucket))
    marks = sorted(set(docs.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.1 / buckets))) if buckets > 1 else []
    bucket = F.when(F.col("doc_id").isNull(), len(marks) + 1).otherwise(F.size(F.filter(_longs(marks), lambda m: F.col("doc_id") <= m))).alias("bucket")
    first = {r.bucket: r.first for r in docs.select(bucket, "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("first")).collect()}  # a row for each bucket
    order = sorted(first)
    lend_to = _longs([order[order.index(b) - 1] if b in first else None for b in range(len(marks) + 2)])
    first_of = _longs([first.get(b) for b in range(len(marks) + 2)])
    dealt = docs.select(bucket, "doc_id", "text")
    own = F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("borrowed"))
    lent = F.struct(F.get(lend_to, F.col("bucket")).cast("int").alias("bucket"), F.lit(1).alias("borrowed"))
    dealt = dealt.withColumn("to", F.when(F.col("doc_id").eqNullSafe(F.get(first_of, F.col("bucket"))), F.array(own, lent)).otherwise(F.array(own)))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t) for t in raw(batch.column(1))], pa.binary()), batch.column(2)], names=["doc_id", "packed", "to"])

    packed = dealt.select("doc_id", "text", "to").mapInArrow(squeeze, "doc_id long, packed binary, to array<struct<bucket:int,borrowed:int>>")
    rows = packed.select("doc_id", "packed", F.explode("to").alias("to")).select("to.bucket", "to.borrowed", "doc_id", "packed")
    placed = rows.repartition(buckets + 1, "bucket").sortWithinPartitions("bucket", "borrowed", F.col("doc_id").desc_nulls_last(), "packed")
    shared = spark.sparkContext.broadcast(lexicon)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, unpack = Fingerprinter(shared.value), zstandard.ZstdDecompressor()
        waiting: tuple | None = None  # the row whose next one is not seen yet
        out: list[tuple] = []

        def close(row: tuple, text: str, digests: np.ndarray) -> None:
            _, doc_id, own, own_digests = row
            new = edited(own, text)
            new_digests = maker.digests(new.encode())
            out.append((doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), text_of(own_digests), text_of(new_digests), likeness(own_digests, new_digests), likeness(own_digests, digests)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out.clear()
            return batch

        for batch in batches:
            for bucket, borrowed, doc_id, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if borrowed and waiting is None:
                    continue  # a second row of the same id
                text = unpack.decompress(blob).decode()
                digests = maker.digests(text.encode())
                if waiting is not None:
                    close(waiting, text, digests)
                waiting = None if borrowed else (bucket, doc_id, text, digests)
            yield flush()
        yield flush()

    return placed.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
