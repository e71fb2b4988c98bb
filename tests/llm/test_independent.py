"""Scores, splits and fingerprints against versions of their own, without the operators' code."""

import itertools
import math
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spinward.llm import imatch, quality, urls
from spinward.llm.queries import QUERIES


def log_density(x, own, scale, shrink=0.1, ridge=1e-3):
    cov = np.cov(own.T)
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.diag(scale**2)
    gap = x - own.mean(0)
    return -0.5 * (np.einsum("ij,ji->i", gap, np.linalg.solve(cov, gap.T)) + np.linalg.slogdet(cov)[1])


def brute_scores(x, seen, y, labelled):
    scale = seen.std(0) + 1e-6
    z = math.log((labelled[1] + 1) / (labelled[0] + 1)) + log_density(x, seen[y == 1], scale) - log_density(x, seen[y == 0], scale)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def test_scores_are_the_ratio_of_two_normal_densities():
    rng = np.random.default_rng(8)
    seen, y = rng.normal(size=(300, 12)) * rng.uniform(0.1, 3, 12), rng.integers(0, 2, 300)
    seen[y == 1] += 0.5
    x = rng.normal(size=(50, 12))
    model = quality.Discriminant.fit(seen, y, (40, 90))
    assert np.allclose(model.score(x), brute_scores(x, seen, y, (40, 90)), atol=1e-9)


@settings(max_examples=80, deadline=None)
@given(st.text("abcde", min_size=1, max_size=9), st.dictionaries(st.text("abcde", min_size=1, max_size=4), st.floats(1e-4, 0.3), max_size=12))
def test_viterbi_is_the_best_of_all_splits(label, shares):
    words = {w: math.log(p) for w, p in shares.items()}

    def cost(parts):
        return sum(words.get(w, math.log(1e-5) - 2.3 * len(w)) for w in parts)

    splits = []
    for cuts in itertools.product((False, True), repeat=len(label) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
        splits.append([label[a:b] for a, b in zip(at, at[1:])])
    got = urls.segment(label, words)
    assert "".join(got) == label and math.isclose(cost(got), max(map(cost, splits)), abs_tol=1e-9)


def brute_terms(text):
    return set(re.findall(r"(?:[^\x00-\x7f]|[a-z0-9])+", text.translate({i: i + 32 for i in range(65, 91)})))


def brute_fingerprint(text, lexicon):
    """A digest of each of 32 subsets: distinct terms in it, in order of their 64-bit hashes."""
    own, out = brute_terms(text) & lexicon, []
    for r, rate in enumerate(x for x in (1 / 32, 1 / 64, 1 / 128, 1 / 256) for _ in range(8)):
        drawn = [t.encode() for t in own if xxhash.xxh32_intdigest(t.encode(), 17 + r) < rate * 2**32]
        names = sorted(xxhash.xxh64_intdigest(t, 17) for t in drawn)
        out.append(xxhash.xxh32_intdigest(b"".join(n.to_bytes(8, "little") for n in names)) | 1 if names else 0)
    return out


def brute_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in some) / len(some)


def test_fingerprints_and_likeness(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    count = {}
    for t in texts.values():
        for w in brute_terms(t):
            count[w] = count.get(w, 0) + 1
    n = len(texts)
    lexicon = {w for w, c in count.items() if max(2, 0.003 * n) <= c <= max(2, 0.5 * n)}
    assert {t.decode() for t in imatch.fit_lexicon(spark.read.parquet(f"{sf_dir}/documents.parquet"))} == lexicon
    order, seen = sorted(texts, reverse=True), 0
    got = {r.doc_id: r for r in QUERIES["op3_fingerprints"](spark, sf_dir).collect()}
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % n]]
        half = len(text) // 2
        a, b, c = (brute_fingerprint(t, lexicon) for t in (text, text[: len(text) - half] + after[:half], after))
        if any(a) and any(b) and any(c):  # others have a digest of the whole text
            seen += 1
            assert got[d].fingerprint == "".join(f"{x:08x}" for x in a) and got[d].edited_fingerprint == "".join(f"{x:08x}" for x in b)
            assert math.isclose(got[d].near_edited, brute_likeness(a, b)) and math.isclose(got[d].near_next, brute_likeness(a, c))
    assert seen > n / 2
