"""I-Match fingerprints: recomputed in plain Python, edits, unrelated texts."""

import random
from collections import Counter

import pytest
import xxhash

from tuneweave.llm import imatch

SCHEMA = "doc_id long, text string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def term_hash(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def list_hash(hashes, k):
    state = 42
    for h in hashes:
        state = xxhash.xxh64(h.to_bytes(8, "little", signed=True), seed=state).intdigest()
    return signed(xxhash.xxh64(k.to_bytes(4, "little"), seed=state).intdigest())


def fingerprints(texts):
    terms = [{term_hash(w) for w in t.lower().split()} for t in texts]
    df = Counter(h for s in terms for h in s)
    n = len(texts)
    band = {h for h, c in df.items() if n * imatch.LOW <= c <= max(n * imatch.HIGH, 1)}
    out = []
    for s in terms:
        kept = sorted(s & band or s)
        fp = []
        for k, (bits, value) in enumerate(imatch.SUBSETS):
            at = 12 + sum(range(2, bits))
            mine = [h for h in kept if bits == 0 or (h >> at) & ((1 << bits) - 1) == value]
            fp.append(list_hash(mine, k) if bits == 0 or len(mine) >= imatch.LEAST else None)
        out.append(fp)
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(3)
    vocabulary = [f"t{i}" for i in range(3_000)]
    weights = [1 / (i + 5) for i in range(3_000)]
    return [" ".join(rnd.choices(vocabulary, weights, k=rnd.choice([60, 150, 400]))) for _ in range(600)]


def test_fingerprints_equal_plain_python(spark, corpus):
    texts = corpus[:200] + ["", "the", "y", "One one ONE two"]
    got = {r.doc_id: list(r.fp) for r in imatch.imatch(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [got[i] for i in range(len(texts))] == fingerprints(texts)


def test_light_edits_keep_a_hash_and_unrelated_texts_share_none(spark, corpus):
    rnd = random.Random(4)
    edited = []
    for t in corpus[:300]:
        w = t.split()
        for i in rnd.sample(range(len(w)), len(w) // 20):
            w[i] = f"new{rnd.randrange(10 ** 6)}"
        edited.append(" ".join(w))
    rows = list(enumerate(corpus + edited))
    got = {r.doc_id: r.fp for r in imatch.imatch(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(corpus)
    kept = [any(x is not None and x == y for x, y in zip(got[i], got[n + i])) for i in range(300)]
    assert sum(kept) >= 0.9 * len(kept)
    owners = {}
    for i in range(n):
        for k, h in enumerate(got[i]):
            if h is not None:
                assert owners.setdefault((k, h), i) == i  # no two of the unrelated texts


def test_empty_subsets_are_no_agreement(spark):
    rows = [(3, "the"), (2, "y"), (1, ""), (0, "")]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3].near_next == 0.0 and got[2].near_next == 0.0 and got[1].near_next == 1.0
