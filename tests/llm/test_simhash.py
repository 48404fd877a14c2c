import random
import re

import numpy as np
import pytest
import xxhash

from tillflow.llm import simhash
from tillflow.llm.components import components


def plain_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    pieces = [" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(fps, distance):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(fps))]


def test_fingerprints(odd_pairs, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    for _, text in odd_pairs[:-4]:
        assert simhash.fingerprint(text, 4)[0] == plain_fingerprint(text, 4)


def test_like_brute_force(documents, odd_pairs, prose):
    rng = random.Random(3)
    pairs = [(i, t) for i, t in odd_pairs if i is not None and len(t or "") < 5000]
    for k in range(12):
        words = prose(k, 120).split()
        for v in range(6):
            copy = list(words)
            for _ in range(v):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(999)}"
            pairs.append((100 + k * 10 + v, " ".join(copy)))
    rows = simhash.near_components(documents(pairs), shingle=4, distance=9, total=None, parts=5).collect()
    fps = [plain_fingerprint(t, 4) for _, t in pairs]
    ids = [i for i, _ in pairs]
    root = plain_components(fps, 9)
    want = {(ids[i], min(ids[j] for j in range(len(ids)) if root[j] == root[i])) for i in range(len(ids))}
    assert {(r.doc_id, r.component_id) for r in rows} == want
    assert len(rows) == len(pairs)
    assert sum(r.kept for r in rows) == len(set(root))


def test_null_ids_repeats_and_empty(documents, odd_pairs):
    docs = documents([(i, t) for i, t in odd_pairs if len(t or "") < 5000])
    rows = simhash.near_components(docs, shingle=4, distance=4, total=None, parts=4).collect()
    assert len(rows) == docs.count()
    same = {r.component_id for r in rows if r.fp == plain_fingerprint("one two three", 4)}
    assert same == {4}
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in simhash.near_components(docs).collect()) == 6
    assert simhash.near_components(documents([])).count() == 0


@pytest.mark.parametrize("bucket_rows", [3, 1 << 14])
def test_no_link_is_lost(spark, bucket_rows):
    """Random fingerprints around a few centres; large buckets are dealt to many tasks."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, 0, 0) for x in fps], "fp long, other long, n long")
    groups = simhash.group_bits(simhash.together(table), 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    thresholds = simhash.allocate([simhash.candidates(c, 4) for c in simhash.value_counts(table.select("fp"), groups)], 4)
    assert sum(thresholds) == 4 - 4 + 1
    links = simhash.links(simhash.dealt(simhash.probes(table, groups, thresholds), bucket_rows), 4, None)
    root = {r.node: r.root for r in components(links).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = plain_components(fps, 4)
    for i in range(len(fps)):
        for j in range(i):
            assert (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])) == (want[i] == want[j])


def test_candidate_counts_are_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 32, 50)
    counts = np.bincount(values, minlength=32).astype(float)
    got = simhash.candidates(counts, 3)
    for t in range(4):
        pairs = sum((int(a) ^ int(b)).bit_count() <= t for a in values for b in values)
        ball = sum(1 for m in range(32) if m.bit_count() <= t)
        rows = sum(50 * sum(1 for m in range(32) if m.bit_count() <= u) for u in range(0))
        assert got[t + 1] >= pairs + rows and got[t + 1] <= pairs + 50 * ball * (t + 1)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 101), (101, 100)], "u long, v long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert root == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0
