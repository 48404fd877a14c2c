import base64
import random

import pyarrow as pa
import pytest
import tiktoken
from public_tokenizers import PATTERN, path

from tillflow.llm import merges

FILE = path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", " \n\t", "Hello WORLD it's 1234 I'VE don't 'll", "<|endoftext|> a<|endoftext|>b", "ΣΑΣ ΟΔΟΣ İstanbul ﬁ é é", "  two  spaces   end   ",
    "中文字 😀👍🏽 ²½ ǅ ẞ Å", "a\x1c\x1db\x85c\xa0d​e f", "a" * 5000, "a b" * 400, "\x00\x01\x7f", "https://a.b/c?d=e&f=%20 {}[]!!!???---", "x\n\n\n  y\r\n\tz ",
    "été Été ÀÉÎ 東京都 ひらがな кириллица", "0123456789 ٣٤٥ 1a2b", "loremipsumdolorsitametconsectetur" * 30,
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library(documents, odd_pairs, library):
    pairs = [*odd_pairs, *((100 + i, t) for i, t in enumerate(ODD))]
    rows = merges.decode(merges.encode(documents(pairs), FILE, PATTERN), FILE).collect()
    want = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in pairs]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in rows), key=str) == sorted(want, key=str)
    files = merges.encode(documents(pairs), FILE, PATTERN, files=True).collect()
    packed = [(i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), text) for i, ids, text in want]
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.packed), bytes(r.decoded)) for r in files), key=str) == sorted(packed, key=str)


@pytest.mark.parametrize("top", [0, 50])
def test_a_small_dictionary_changes_nothing(spark, library, monkeypatch, top):
    monkeypatch.setattr(merges, "LETTERS", 3000)
    monkeypatch.setattr(merges, "KEPT", 5)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in merges.encode(docs, FILE, PATTERN, top=top).collect()}
    assert got == {r.doc_id: library.encode_ordinary(r.text or "") for r in docs.collect()}


def test_replay_like_one_word_at_a_time(prose):
    known = merges.Ranks(FILE)
    words = [w.encode() for w in {w for seed in range(5) for w in prose(seed, 300).split()}] + [bytes(range(256)), b"a" * 99, "東京都".encode() * 9]
    assert known.replay(words) == [known.lowest_first(w) for w in words]
    assert known.replay([]) == []


def test_a_merge_that_makes_a_lower_rank(tmp_path):
    """The rank of the bytes abc is lower than that of its part ab: rank order alone would differ."""
    tokens = [bytes([b]) for b in range(256)] + [b"xabc", b"abc", b"ab", b"xa"]
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    known = merges.Ranks(str(tmp_path / "ranks"))
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=known.rank, special_tokens={})
    words = [b"abcabab", b"xabcab", b"aabc", b"xabxabc"]
    assert known.replay(words) == [known.lowest_first(w) for w in words]
    assert [known.lowest_first(w + b"q") for w in words] == [own.encode_ordinary(w.decode() + "q") for w in words]


def test_runs_and_random_ranks_like_lowest_first(tmp_path):
    """Pairs that overlap in a run, and ranks of which parts come after what they make."""
    for seed in range(40):
        rng = random.Random(seed)
        made = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6))) for _ in range(40)})
        rng.shuffle(made)
        (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([*(bytes([b]) for b in range(256)), *made])))
        known = merges.Ranks(str(tmp_path / "ranks"))
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(60)] + [b"a" * k for k in range(1, 20)]
        assert known.replay(words) == [known.lowest_first(w) for w in words]


def test_new_words_of_many_slices_are_replayed_together(prose, library, monkeypatch):
    texts = [prose(k, 40) for k in range(30)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [t]}) for k, t in enumerate(texts)]
    for waiting, calls in ((merges.WAITING, 1), (41, 30)):
        monkeypatch.setattr(merges, "WAITING", waiting)
        task, replayed = merges.Task(FILE, PATTERN), []
        replay = task.ranks.replay
        with monkeypatch.context() as patch:
            patch.setattr(task.ranks, "replay", lambda words, replay=replay, replayed=replayed: replayed.append(len(words)) or replay(words))
            got = [(i.to_pylist(), ids.tolist()) for i, ids, _ in task.encode(iter(batches))]
        assert got == [([k], library.encode_ordinary(t)) for k, t in enumerate(texts)] and len(replayed) == calls


def test_unknown_ids_and_empty_table(spark, documents):
    rows = spark.createDataFrame([(1, [10 ** 9, -1, 0]), (2, []), (None, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in merges.decode(rows, FILE).collect()}
    assert len(got[1]) == 1 and got[2] == b"" and got[None] == b""
    assert merges.decode(merges.encode(documents([]), FILE, PATTERN), FILE).count() == 0


def test_a_file_without_all_bytes_is_refused(tmp_path):
    (tmp_path / "ranks").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        merges.Ranks(str(tmp_path / "ranks"))
