import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tillflow.llm import dedup


def plain(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs), key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, bytes(r.digest).hex()) for r in df.collect()), key=str)


def test_like_brute_force(documents, odd_pairs):
    rows = dedup.members(documents(odd_pairs))
    assert found(rows) == plain(odd_pairs)
    # One row of each text stays, also where rows are repeated whole.
    assert rows.filter("kept").count() == len({t or "" for _, t in odd_pairs})


def test_colliding_digests_are_told_apart(documents, odd_pairs):
    weak = lambda t: F.lit(b"same")
    rows = dedup.members(documents(odd_pairs), digest=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in rows), key=str) == sorted((x[:3] for x in plain(odd_pairs)), key=str)
    assert sum(r.kept for r in rows) == len({t or "" for _, t in odd_pairs})


def test_several_batches_like_one(documents, odd_pairs):
    docs = documents(odd_pairs * 3).repartition(5)
    assert found(dedup.members(docs, files_per_batch=1)) == plain(odd_pairs * 3)


def test_state_goes_on(spark, documents, tmp_path):
    folder, incoming = str(tmp_path / "state"), str(tmp_path / "incoming")
    schema = None
    for ids in ((1, 2), (7, 3)):
        rows = dedup.located(documents([(i, "same") for i in ids]))
        new = dedup.arrivals(rows, "doc_id", "text", dedup.sha256)
        schema = schema or new.schema
        new.write.mode("append").parquet(incoming)
        groups = dedup.advance(spark, incoming, schema, folder)
    row = groups.collect()
    assert [(r.keeper.doc_id, r.group_size) for r in row] == [(7, 4)]


def test_unique_keeps_all_columns(documents, odd_pairs):
    docs = documents(odd_pairs)
    out = dedup.unique(docs)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t in odd_pairs})


def test_empty(documents):
    assert dedup.members(documents([])).count() == 0
    assert dedup.unique(documents([])).count() == 0


def test_no_python_on_executors(documents, odd_pairs):
    plan = dedup.members(documents(odd_pairs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
