import re

import pytest

from tillflow.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(len(v), window)
        for a in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[a:a + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit)


ITEMS = [
    (1, "The Quick brown fox jumps over the lazy dog and runs away again"), (2, "two words"), (3, "single"), (4, None), (5, ""), (6, "..., !"),
    (7, "a b c a b c a b c a b c a b c"), (8, "The Quick brown fox jumps over the lazy dog and runs away again"), (9, "Été à la plage ß"), (10, "x2 y3 z4"),
]


def texts(prose):
    fox = ITEMS[0][1]
    return [
        None, "", "nothing here", f"before {fox.upper()} after", fox[:30], " ".join(fox.split()[1:11]), "two  WORDS, two words", "SINGLE-single single",
        "a b c " * 30, "été À la plage ß été à la plage ß", "X2, y3; z4", prose(4, 3000) + " " + fox + " " + prose(5, 3000) + " two words",
        "the quick brown fox jumps over the lazy dog and walks away", fox + " " + fox, "single",
    ]


@pytest.mark.parametrize("window, shingle", [(10, 3), (4, 2), (3, 3), (5, 1)])
def test_like_brute_force(spark, documents, prose, window, shingle):
    pairs = list(enumerate(texts(prose))) + [(None, "single"), (None, "two words"), (3, "single"), (3, "single")]
    bench = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, window string, k int")
    rows = decontamination.contamination(documents(pairs), bench, window=window, shingle=shingle).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows), key=str)
    assert got == sorted(((i, *plain(t, ITEMS, window)) for i, t in pairs), key=str)


def test_exchange_join_like_broadcast(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    pairs = list(enumerate(texts(prose)))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.contamination(documents(pairs), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows) == sorted((i, *plain(t, ITEMS, 10)) for i, t in pairs)


def test_clean_keeps_the_rest(spark, documents, prose):
    pairs = list(enumerate(texts(prose))) + [(None, "single"), (None, "fine"), (77, "fine"), (77, "fine")]
    docs = documents(pairs)
    bench = spark.createDataFrame([*ITEMS, (None, "fine")], "item_id long, text string")
    out = decontamination.clean(docs, bench)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((p for p in pairs if not plain(p[1], ITEMS, 10)[3]), key=str)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(documents([]), bench).count() == 0
    row = decontamination.contamination(documents([(1, "a b")]), bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"], row.contaminated) == (2, 0, [], False)


def test_word_arrays_end_at_the_explode(spark, documents):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    vocabulary = decontamination.shingles(decontamination.windows(bench, "item_id", "text", 10), 3).select("k", "s").distinct()
    plan = decontamination.found(documents([(1, "a")]), vocabulary, 3, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate posexplode" in line)
    above = next(i for i in range(at, -1, -1) if " AS w2" in lines[i])
    assert "Project" in lines[above] and not any("words#" in line for line in lines[:above])
