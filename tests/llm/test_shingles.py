"""The near-dedup stage links by the similarity of five-word shingles, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from skygrain.llm import components, shingles


def _texts():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 9999, 200)]
        texts.append(" ".join(words))
        for edits in (2, 4, 6, 12):  # about 0.9, 0.82, 0.74 and 0.53 alike
            own = list(words)
            for at in rng.choice(200, edits, replace=False):
                own[at] = f"x{rng.integers(0, 9999)}"
            texts.append(" ".join(own))
    return [*texts, texts[0], "", None, "One two", "one  TWO"]


def _sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept(texts):
    s = [_sets(t) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] == s[j] or s[i] & s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8]
    a, b = zip(*links)
    root = components.contract(len(s), np.array(a), np.array(b))
    return {i for i in range(len(s)) if root[i] == i}


def test_stage_keeps_one_of_each_group_at_least_08_alike(spark):
    texts = _texts()
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    got = stage["simhash_near_dedup"](spark, docs, "")
    assert {r.doc_id for r in got.collect()} == _kept(texts)
    assert got.columns == docs.columns
    assert stage["simhash_near_dedup"](spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("block", [2, 256])
def test_large_clusters_are_dealt_out_whole(spark, block):
    texts = [t for t in _texts()[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = shingles.shingle_components(docs, block=block).collect()
    assert {r.component_id for r in got} == _kept(texts)


def test_similarities_are_exact():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert shingles.similarities([a, a[:0]], [b, b[1:]]).tolist() == [[0.8, 0.7], [0.0, 0.0]]


@pytest.mark.parametrize("documents", [1000, 14_000_000, 1_000_000_000])
def test_blocks_find_pairs_at_the_limit(documents):
    """Random pairs of sets at exactly 0.8, of equal size and one within the other."""
    cutting, rng = shingles.Blocks(documents, 0.8), np.random.default_rng(8)
    found = []
    for k in range(300):
        both = rng.integers(0, 1 << 63, 320, dtype=np.uint64)
        own = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
        a, b = (np.r_[both, own[:40]], np.r_[both, own[40:]]) if k % 2 else (both, np.r_[both, own])
        (ca, xa), (cb, xb) = cutting.of(np.sort(a)), cutting.of(np.sort(b))
        near = min((x ^ y).bit_count() for x, y in zip(xa, xb)) <= shingles.RADIUS
        found.append(near and ((ca ^ cb) & ((1 << 64) - 1)).bit_count() <= cutting.within)
    assert np.mean(found) >= 0.97


def test_large_runs_link_whole():
    """A run of more variants than are compared links as a whole; a shorter one by its checks alone."""
    from skygrain.llm import simhash

    block = np.full(6000, 5, np.uint64)
    check = np.random.default_rng(1).integers(0, 1 << 63, 6000, dtype=np.uint64)
    assert (simhash.bucket_links(block, 0, 6, 1, bits=24, check=check, within=18) == 0).all()
    assert len(set(simhash.bucket_links(block[:50], 0, 6, 1, bits=24, check=check[:50], within=5))) == 50
