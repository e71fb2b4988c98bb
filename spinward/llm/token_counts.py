"""Operator 1, token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

A pre-token here is a maximal run of bytes other than ASCII white space. The tokenizer's own pattern never crosses white
space and drops it, and NFC never composes across it, so the count of a text is the sum of the counts of its pre-tokens.
The table of counts is kept per partition: one global table would need a shuffle of all (document, pre-token) pairs,
which is larger than the texts themselves (README). It is bounded by `cache_size` entries and starts anew beyond them.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results. An empty table gives none. A null id
stays null. Other columns of the input are not read.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spinward.llm.common import bounded_batches, keep, pieces, raw


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_counts(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token; only their number leaves the library."""
    return [len(e) for e in _tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, cache_size: int = 400_000) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_distinct) for each row of docs."""
    bounded_batches(docs.sparkSession)
    docs = keep(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = raw(batch.column(1))
            sizes = [len(t) for t in texts]
            tokens: list[int] = []
            kinds: list[int] = []
            for part in pieces(texts, sizes, 4 << 20):
                frequency = [Counter(t.split()) for t in texts[part]]
                if len(known) > cache_size:
                    known.clear()
                new = [w for w in set().union(*frequency) if w not in known]
                for pos in range(0, len(new), 20_000):
                    some = new[pos : pos + 20_000]
                    known.update(zip(some, piece_counts([w.decode() for w in some], tokenizer_path), strict=True))
                tokens += [sum(n * known[w] for w, n in f.items()) for f in frequency]
                kinds += [len(f) for f in frequency]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(kinds, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_distinct"],
            )

    return docs.mapInArrow(run, f"`{id_col}` {docs.dtypes[0][1]}, n_bytes long, n_tokens long, over_limit boolean, n_distinct long")
