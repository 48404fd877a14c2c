import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tillflow.llm import langid
from tillflow.llm.queries import read, shown_document

EN, DE = "the cat and the hat are in the house ", "der hund und die katze sind in dem haus "


def plain(docs, evidence, languages=("en", "de"), w=20.0):
    """The posterior by the definition, with dictionaries."""
    classes = (*languages, "und")
    counts = {c: Counter() for c in languages}
    cells = lambda t: langid.cells((t or "").encode().lower()).tolist()
    for _, t, lang, _ in docs:
        if lang in counts:
            counts[lang].update(cells(t))
    size = langid.BUCKETS
    like = lambda c, x: math.log(1 / size) if c == "und" else math.log((counts[c][x] + 0.5) / (sum(counts[c].values()) + 0.5 * size))
    rows = []
    for i, t, _, source in docs:
        text = {c: sum(like(c, x) for x in cells(t)) / 3 for c in classes}
        said = evidence.get(i) or [(None, None, None)]
        for declared, suffix, host in said:
            host = host or source or ""
            blank = not any(map(str.isalnum, t or ""))
            domain = ".".join(host.split(".")[-2:]) if "." in host else ""
            rows.append((i, text, max(classes, key=lambda c: text[c]), declared, suffix, host, domain, 1 / len(said), blank))
    known = [r for r in rows if not r[-1]]
    total = Counter()
    for r in known:
        total[r[2]] += r[7]
    tables = []
    for k in (3, 4):
        seen = defaultdict(Counter)
        for r in known:
            if r[k] is not None:
                seen[r[k]][r[2]] += r[7]
        n = max(sum(total.values()), 1)
        tables.append({v: {c: math.log((x[c] + w * (sum(x.values()) + 1) / (n + 2)) / (total[c] + w)) for c in classes} for v, x in seen.items()})
    everywhere = {c: (total[c] + 1) / (sum(total.values()) + len(classes)) for c in classes}
    domains, hosts = defaultdict(Counter), defaultdict(Counter)
    for r in known:
        domains[r[6]][r[2]] += r[7]
        hosts[r[5]][r[2]] += r[7]
    scores, blanks = {}, {}
    for i, text, _, declared, suffix, host, domain, weight, blank in rows:
        score = scores.setdefault(i, dict(text))
        blanks[i] = blank
        for c in classes:
            own = tables[0].get(declared, {}).get(c, 0) + tables[1].get(suffix, {}).get(c, 0)
            if host in hosts:
                share = (domains[domain][c] + w * everywhere[c]) / (sum(domains[domain].values()) + w)
                own += math.log((hosts[host][c] + w * share) / (sum(hosts[host].values()) + w))
            else:
                own -= math.log(len(classes))
            score[c] += weight * own
    out = {}
    for i, score in scores.items():
        best = max(classes, key=lambda c: score[c])
        out[i] = ("und", 0.0) if blanks[i] else (best, 1 / sum(math.exp(s - score[best]) for s in score.values()))
    return out


DOCS = [
    *((i, EN * 3 + str(i), "en", "a.example.org") for i in range(6)), *((10 + i, DE * 3 + str(i), "de", "b.example.org") for i in range(6)),
    (20, "in", None, "b.example.org"), (21, "in", None, None), (22, None, "en", "a.example.org"), (23, "", None, "x"), (24, "?!", "de", "y"),
    (25, "in", "xx", "c.example.org"), (26, "in d", None, "zz"), (27, EN * 2000, "en", "a.example.org"),
]
EVIDENCE = {
    1: [("en", "org", "a.example.org")], 11: [("de", "de", "q.de")], 12: [("de", "de", "q.de"), ("de", "com", "m.q.com"), (None, None, None)],
    26: [("de", "de", "q.de"), ("en", "com", "later.com")], 21: [("fr", None, None)], 999: [("en", "org", "nobody.org")]}


def frames(spark):
    docs = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, lang string, source string, host int, guess string")
    rows = [(i, k, *e) for i, said in EVIDENCE.items() for k, e in enumerate(said + said[:1])]
    return docs, spark.createDataFrame(rows, "doc_id long, page_id long, declared string, suffix string, host string")


def test_like_the_definition(spark):
    docs, evidence = frames(spark)
    got = {r.doc_id: (r.lang, r.posterior) for r in langid.identify(docs, evidence, languages=("en", "de")).collect()}
    want = plain(DOCS, EVIDENCE)
    assert got.keys() == want.keys()
    for i, (lang, posterior) in want.items():
        assert got[i][0] == lang and abs(got[i][1] - posterior) < 1e-3, i
    # All pages of a document count, and each different evidence once.
    first = plain(DOCS, {i: said[:1] for i, said in EVIDENCE.items()})
    assert abs(first[12][1] - want[12][1]) + abs(first[26][1] - want[26][1]) > 1e-3 and got[20][1] < got[10][1]


def test_repeated_rows_and_clashing_columns(spark):
    docs, evidence = frames(spark)
    twice = docs.unionByName(docs.filter("doc_id in (12, 26)")).withColumn("weight", F.lit("w")).withColumn("pages", F.lit(3))
    rows = langid.identify(twice, evidence, languages=("en", "de")).collect()
    assert len(rows) == len(DOCS) + 2 and len({(r.doc_id, r.lang, r.posterior) for r in rows}) == len(DOCS)
    assert langid.accepted(twice, evidence, languages=("en", "de")).columns == twice.columns


def test_accepted_keeps_columns_and_drops_blank_texts(spark):
    docs, evidence = frames(spark)
    out = langid.accepted(docs, evidence, languages=("en", "de"))
    assert out.columns == docs.columns
    assert not {22, 23, 24} & {r.doc_id for r in out.collect()}
    assert {d[0] for d in DOCS if d[0] < 20} <= {r.doc_id for r in out.collect()}


def test_held_out_accuracy(spark):
    """Labels of every other document are hidden; the operator finds them again."""
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.col("lang")))
    evidence = langid.page_evidence(read(spark, "/root/testdata/sf0.01", "pages"), shown_document())
    rows = langid.identify(hidden, evidence).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    rows = rows.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1).collect()
    assert np.mean([r.lang == r.true for r in rows]) > 0.97 and np.mean([r.accepted for r in rows]) > 0.99


def test_page_evidence(spark):
    pages = spark.createDataFrame([
        (1, "https://www.a.example.de/fr/12?x=1", '<!doctype html><HTML class=a LANG="FR-ca">'), (2, "http://u@h.org:80/en/7", "<html><p lang='de'>"),
        (3, None, None), (4, "nonsense", ""), (5, "http://x.y/en/", "<html lang=en>")], "page_id long, url string, html string")
    rows = {r.page_id: tuple(r) for r in langid.page_evidence(pages, shown_document()).collect()}
    assert rows == {1: (12, 1, "fr", "de", "www.a.example.de"), 2: (7, 2, None, "org", "h.org")}


def test_empty(spark):
    docs, evidence = frames(spark)
    assert langid.identify(docs.limit(0), evidence.limit(0)).count() == 0
    assert langid.identify(docs, None, languages=("en", "de")).count() == len(DOCS)
