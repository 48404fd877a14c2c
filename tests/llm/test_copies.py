import random

import numpy as np
import pytest

import corpus_pipeline
from tillflow.llm import copies, simhash
from tillflow.llm.queries import read
from tillflow.llm.tables import land

SMALL = "/root/testdata/sf0.001"


def plain_sets(pairs):
    """The five-word shingles of each document, as texts."""
    out = {}
    for i, text in pairs:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        out[i] = {tuple(words[a:a + k]) for a in range(len(words) - k + 1)} if words else set()
    return out


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_components(sets):
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and similar(sets[i], sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def test_pipeline_stage_like_plain_jaccard(spark):
    """The near stage keeps and drops what the similarity of the sets says, not what a sketch says."""
    docs = read(spark, SMALL, "documents").dropDuplicates(["text"])
    want = plain_components({r.doc_id: s for r in docs.collect() for s in plain_sets([(r.doc_id, r.text)]).values()})
    got = {r.doc_id for r in corpus_pipeline.near(spark, docs, SMALL).collect()}
    assert got == {i for i in want if want[i] == i} and len(got) < len(want)


def altered(prose, seed, words, changes):
    rng = random.Random(seed)
    out = prose(seed, words).split()
    for at in rng.sample(range(words), changes):
        out[at] = f"new{seed}x{at}"
    return " ".join(out)


def test_pairs_just_above_the_bound_are_all_found(documents, prose):
    """Copies of similarity 0.8 to 0.85 link, those a little below do not."""
    pairs = []
    for k in range(80):
        pairs += [(2 * k, prose(k, 200)), (2 * k + 1, altered(prose, k, 200, 4 + k % 2))]
    sets = plain_sets(pairs)
    share = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 160, 2)]
    assert sum(0.8 <= s < 0.85 for s in share) > 30 and sum(0.7 < s < 0.8 for s in share) > 20
    want = plain_components(sets)
    assert {(r.doc_id, r.component_id) for r in copies.near_copies(documents(pairs)).collect()} == {*want.items()}


@pytest.mark.parametrize("run", ["- ", "again "])
def test_a_run_that_outweighs_the_words_links_nothing(documents, prose, run):
    """One shingle with most of the occurrences gives equal fingerprints to unrelated texts."""
    pairs = [(1, prose(1, 150) + " " + run * 400), (2, prose(2, 180) + " " + run * 400), (3, run * 400), (4, None), (5, "")]
    assert simhash.fingerprint(pairs[0][1], 5)[0] == simhash.fingerprint(pairs[1][1], 5)[0]
    got = {r.doc_id: r.component_id for r in copies.near_copies(documents(pairs)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def family(prose, first, n, words, seed):
    """Texts that share most words with one text, at similarities on both sides of the bound."""
    base = prose(seed, words).split()
    out = []
    for k in range(n):
        rng = random.Random(seed * 1000 + k)
        text = list(base)
        for at in rng.sample(range(words), rng.choice((1, 1, 2, 3))):
            text[at] = f"z{rng.randrange(50)}"
        out.append((first + k, " ".join(text)))
    return out


@pytest.mark.parametrize(("chunk", "small", "rounds"), [(2048, 128, 256), (16, 8, 256), (16, 2, 0)])
def test_large_groups_in_chunks_like_plain_jaccard(documents, prose, monkeypatch, chunk, small, rounds):
    """One large family, a smaller one, and texts with a common passage, whatever the chunks and rounds."""
    monkeypatch.setattr(copies, "CHUNK", chunk)
    monkeypatch.setattr(copies, "SMALL", small)
    monkeypatch.setattr(copies, "OPEN", rounds)
    passage = prose(99, 60)
    pairs = family(prose, 0, 120, 120, 5) + family(prose, 500, 30, 60, 6) + [(700 + k, f"{prose(k, 12)} {passage} {prose(k + 50, 12)}") for k in range(60)]
    want = plain_components(plain_sets(pairs))
    assert 3 < len({*want.values()}) < len(pairs) - 50
    assert {(r.doc_id, r.component_id) for r in copies.near_copies(documents(pairs).repartition(3)).collect()} == {*want.items()}


def test_simhash_proposes_pairs(documents, prose):
    """Pairs of near fingerprints come from the SimHash operator, from fingerprints of the sets."""
    pairs = [(k, prose(k, 200)) for k in range(20)] + [(100 + k, altered(prose, k, 200, 1 + k % 4)) for k in range(20)]
    rows = land(copies.marks(copies.located(documents(pairs).coalesce(1)), "doc_id", "text", 5).coalesce(1), "marks")
    fps = {r.doc_id: r.fp & ((1 << 64) - 1) for r in rows.collect()}
    sets = {i: copies.shingle_set(t, 5) for i, t in pairs}
    assert fps == {i: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s.tolist()) > len(s)) for i, s in sets.items()}
    node = {bytes(r.node): r.doc_id for r in rows.collect()}
    got = {tuple(sorted((node[bytes(r.u)], node[bytes(r.v)]))) for r in copies.proposed(rows).collect()}
    assert got == {(k, 100 + k) for k in range(20) if (fps[k] ^ fps[100 + k]).bit_count() <= copies.NEAR} and got


def test_the_sketch_keeps_pairs_of_the_bound():
    rng = np.random.default_rng(3)
    kept, far = 0, 0
    for _ in range(400):
        both = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        one, two = (copies.sketch(copies.lowest(both[part])) for part in (slice(0, 400), slice(50, 450)))
        three = copies.sketch(copies.lowest(np.concatenate([both[:200], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])))
        differ = [int(np.bitwise_count((one ^ x)[:3] | (one ^ x)[3:]).sum()) for x in (two, three)]
        kept += differ[0] <= copies.LOST
        far += differ[1] <= copies.LOST
    assert kept == 400 and far < 4


def test_odd_rows(documents, odd_pairs, rows):
    docs = documents(odd_pairs)
    got = copies.near_copies(docs)
    assert got.count() == len(odd_pairs)
    first = {r.doc_id: r.component_id for r in got.filter("doc_id not in (4, 9) and doc_id is not null").collect()}
    assert first[1] == first[2] == first[3] == 1 and first[5] == 4 and first[6] == first[7] == 6 and first[10] == first[11] == 10 and first[8] == 8
    kept = copies.one_of_each(docs)
    assert kept.columns == docs.columns and rows(kept, "doc_id") == sorted([(1,), (4,), (6,), (8,), (9,), (9,), (10,)], key=str)
    assert copies.near_copies(documents([])).count() == 0 and copies.one_of_each(documents([])).count() == 0


def test_only_the_dropped_rows_stay_on_disk(spark, documents, prose, monkeypatch, tmp_path):
    from tillflow.llm import tables

    monkeypatch.setattr(tables, "scratch_dir", lambda spark, label: str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}"))
    docs = documents([(1, prose(1, 50)), (2, prose(1, 50)), (3, prose(3, 50))])
    assert copies.one_of_each(docs).count() == 2
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"rows", "dropped"}
