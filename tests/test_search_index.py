"""The segmented index against a scan of the documents."""

import random

from registra.functions import scalars as S
from registra.operators import search_index as X

KINDS = "id bigint, title string, summary string, municipality string, category string, source_host string"


def ranked(docs, query):
    words, last = X.query_words(query)
    out = []
    for d in docs.values():
        places = {}
        for k, text in enumerate(d[1:]):
            for t in S.normalized(text or "").split():
                for w, word in enumerate(words):
                    if t == word:
                        places.setdefault(w, k)
                if last is not None and t.startswith(last):
                    places.setdefault(len(words), k)
        if places:
            out.append((-len(places), min(places.values()), sum(places.values()), d[0]))
    return [(i, -n, a, p) for n, a, p, i in sorted(out)]


def test_segments(spark, tmp_path):
    """After each segment, and after all are merged, a search gives what a scan gives."""
    some = random.Random(2)
    words = ["Vendim", "vendime", "ndërtim", "nr", "12", "rrugë", "Tiranë", None, ""]
    row = lambda i: (i, *(" ".join(x for x in some.choices(words, k=3) if x) or None for _ in range(5)))
    docs, path = {}, str(tmp_path / "a")
    for segment in range(3):
        new = {i: row(i) for i in some.sample(range(60), 25)}
        gone = set(some.sample(sorted(docs), min(8, len(docs)))) if docs else set()
        docs = {i: d for i, d in docs.items() if i not in gone} | new
        deleted = spark.createDataFrame([(i,) for i in gone], "id bigint")
        X.add_segment(spark.createDataFrame(list(new.values()), KINDS), path, segment, deleted, ranges=4)
        for query in ("vend", "Ndertim 12 tir", "nr ", "vendim vend", "none"):
            assert [tuple(r) for r in X.search(spark, path, query, 100).collect()] == ranked(docs, query), (segment, query)
    X.merged_segments(spark, path, str(tmp_path / "b"), 4)
    assert [tuple(r) for r in X.search(spark, str(tmp_path / "b"), "rruge ven", 100).collect()] == ranked(docs, "rruge ven")
    assert X.search(spark, path, " ").collect() == []
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "b/documents")).collect()) == sorted(docs)


def test_a_search_reads_its_range(spark, tmp_path):
    X.add_segment(spark.createDataFrame([(i, f"w{i:04d}", None, None, None, None) for i in range(2000)], KINDS), str(tmp_path), 0, ranges=16)
    found = X.search(spark, str(tmp_path), "w1999")
    assert [r.id for r in found.collect()] == [1999]
    plan = found._jdf.queryExecution().toString()
    assert "StringStartsWith(term,w1999)" in plan


def test_query_words():
    assert X.query_words("Një nr nr Ven") == (["nje", "nr"], "ven") and X.query_words("a b ") == (["a", "b"], None) and X.query_words("") == ([], None)


def test_postings_need_no_shuffle(spark):
    """A word of several attributes is one posting, of the first attribute; words of one document don't meet by a shuffle."""
    docs = spark.createDataFrame([(1, "Urgent road", "urgent Urgent", "m", "c", "h")], "id long, title string, summary string, municipality string, category string, source_host string")
    found = X.postings(docs)
    assert sorted(map(tuple, found.collect())) == [("c", 1, 3), ("h", 1, 4), ("m", 1, 2), ("road", 1, 0), ("urgent", 1, 0)]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
