import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SMALL = "/root/testdata/sf0.001"


def test_stages_like_plain_versions(spark):
    """Every stage over all it is given, held against a plain version of its rule."""
    import corpus_pipeline
    from public_tokenizers import path
    from test_copies import plain_components, plain_sets
    from test_decontamination import plain as contaminated
    from tokenizers import Tokenizer

    from tillflow.llm import langid
    from tillflow.llm.queries import read, shown_document
    from tillflow.llm.tables import land

    docs = read(spark, SMALL, "documents")
    columns, given, steps = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r.doc_id: r.text for r in docs.collect()}
        docs = land(stage(spark, docs, SMALL), name)
        steps[name] = {r.doc_id for r in docs.collect()}
        assert name == "tokens" or docs.columns == columns

    judged = langid.identify(read(spark, SMALL, "documents"), langid.page_evidence(read(spark, SMALL, "pages"), shown_document())).collect()
    assert steps["language"] == {r.doc_id for r in judged if r.accepted} and len(steps["language"]) > 195
    keep = {}
    for i, t in given["exact"].items():
        keep[t] = max(keep.get(t, i), i)
    assert steps["exact"] == set(keep.values())

    groups = plain_components(plain_sets(given["near"].items()))
    assert steps["near"] == {i for i in groups if groups[i] == i} and len(steps["near"]) < len(groups)

    items = [(r.item_id, r.text) for r in read(spark, SMALL, "benchmark").collect()]
    grams = {}
    for item, text in items:
        from test_decontamination import words
        w = words(text)
        for k in range(len(w) - min(len(w), 10) + 1):
            grams[" ".join(w[k:k + 10])] = item
    def hit(text):
        w = words(text)
        return any(" ".join(w[k:k + 10]) in grams for k in range(len(w)))
    assert all(len(words(t)) >= 10 for _, t in items) and contaminated("x", items, 10)[3] is False
    assert steps["benchmark"] == {i for i, t in given["benchmark"].items() if not hit(t)}

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    assert {r.doc_id: r.ids for r in docs.collect()} == {i: library.encode(t, add_special_tokens=False).ids for i, t in given["tokens"].items()}
    run = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert run == steps["tokens"]


def test_stages_on_empty_tables_and_odd_rows(spark, documents, odd_pairs):
    import corpus_pipeline

    plain = documents(odd_pairs).select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (documents([]), documents(odd_pairs), plain):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == (["doc_id", "ids", "text"] if name == "tokens" else names)
        assert docs.count() <= len(odd_pairs)
    assert {r.doc_id for r in docs.collect()} <= {i for i, _ in odd_pairs}


def test_entry_registers_all():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_the_rest_lives_without_these(tmp_path):
    """Without the folders and the pipeline, the entry still imports and has the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2:3].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_these():
    for path in [*REPO.glob("tillflow/**/*.py"), *REPO.glob("tools/*.py"), *REPO.glob("tests/*.py"), REPO / "bench.py"]:
        if "llm" not in path.relative_to(REPO).parts:
            assert "tillflow.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


@pytest.mark.parametrize("name", ["op1_warc", "op2_decontaminate", "op6_exact_dedup"])
def test_against_sql(spark, name):
    import duckdb

    from tillflow.llm.oracle import ORACLE
    from tillflow.llm.queries import queries

    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = db.sql(ORACLE[name])
    got = queries()[name](spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
