import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tillflow.llm import bpe

FILE = path("word_bpe_49k.json")
ODD = [
    "", " \n\t", "Hello WORLD it's 1234 I'VE don't 'll", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ ΟΔΟΣ İstanbul ﬁ é é",
    "中文字 😀👍🏽 ²½ ǅ ẞ Å", "a\x1c\x1db\x85c\xa0d​e", "aaaaaaaaaaaaaaaaaaaaaaaaaaa aaaa", "\x00\x01\x7f", "https://a.b/c?d=e&f=%20 {}[]!!!???---", "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_like_the_library(documents, odd_pairs, library):
    pairs = [*odd_pairs, *((100 + i, t) for i, t in enumerate(ODD))]
    rows = bpe.decode(bpe.encode(documents(pairs), FILE, rows=3), FILE).collect()
    want = []
    for i, t in pairs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.ids, r.text) for r in rows), key=str) == sorted(want, key=str)
    spelled = bpe.encode(documents(pairs), FILE, rows=3, spelled=True).collect()
    assert sorted(((r.doc_id, r.ids, r.text) for r in spelled), key=str) == sorted(want, key=str)


def test_whole_table_like_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(docs, FILE).collect()}
    assert got == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 5)
    known = bpe.Vocabulary(FILE)
    for _ in range(2):
        for text in ODD:
            assert known.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_unknown_ids_and_empty_table(spark, documents):
    rows = spark.createDataFrame([(1, [320, 10 ** 9, -1, 49407]), (2, []), (None, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows, FILE).collect()}
    assert got[1].split(" ")[-1] == "<|endoftext|>" and len(got[1].split(" ")) == 2 and got[2] == "" and got[None] == ""
    assert bpe.decode(bpe.encode(documents([]), FILE), FILE).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(path("byte_bpe_50k.json"))
