"""Shared lines, the prefix trie and periodic runs against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from registra.llm import lines, periodic, trie


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines


def dropped(rows, least_chars=40, least_docs=5):
    """(id, text, n_lines, n_dropped) of (id, text) rows."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(small)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= least_chars:
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not (len(held[key(x)]) >= least_docs and (i is None or i < max(held[key(x)])))]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return out


LONG = "This line is long enough to be a key of its own, ÉTÉ"


def by_all(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_shared_lines(spark):
    rows = [(i, f"own {i}\n  {LONG}\r\n{LONG.replace('T', 't')}\nx" if i % 2 else LONG) for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (8, LONG), (3, rows[3][1]), (None, LONG + "\nstays"), (None, None), (-5, "\n".join([LONG, "y" * 50] * 300)), (30, "z" * 100_000 + "\n" + "y" * 50)]
    rows += [(k, "y" * 50 + "\nsomething of its own") for k in range(40, 43)] + [(k, "only four hold this line, which is long enough") for k in range(50, 54)]
    docs = spark.createDataFrame([(i, t, 1, "h", 2) for i, t in rows], "doc_id bigint, text string, pos int, hash string, last int")
    assert by_all(lines.deduplicated(docs).collect()) == by_all(dropped(rows))
    assert by_all(lines.digests(docs).collect()) == by_all([(i, n, k, sha(t)) for i, t, n, k in dropped(rows)])


def test_shared_lines_thresholds_and_no_rows(spark):
    rows = [(i, "a\nB\n\nc" * (i % 3)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_all(lines.deduplicated(docs, least_chars=1, least_docs=2).collect()) == by_all(dropped(rows, 1, 2))
    assert lines.digests(docs.limit(0)).collect() == []


def test_lines_run_without_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = lines.digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# The trie


def nodes(rows):
    """Rows of build() from (conv_id, turn, role, text) rows."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()), r, x))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    new = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(members[k]) - 1) * n + sum(saved[x] for x in kids[k])
    ends = {k: ",".join(map(str, sorted(c for c in m if len(new[c]) == len(k)))) for k, m in members.items()}
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(ends[k])) for k, m in members.items()]


def turns(spark, rows):
    return spark.createDataFrame([(*r, 0, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, k1 string")


def test_trie(spark, monkeypatch):
    """Shared beginnings, ties, repeated rows, nulls, a long chain over several blocks, clashing names."""
    monkeypatch.setattr(trie, "BLOCK", 16)
    some = np.random.default_rng(3)
    rows = [(c, t if some.random() < 0.9 else None, ["user", None, "a"][some.integers(3)], ["x y", "", None, "z é"][some.integers(4)]) for c in [*range(45), 100, None] for t in range(some.integers(1, 6))]
    rows += [(7, t, "user", f"q {t}") for t in range(70)] + [(9, t, "user", f"q {t}") for t in range(60)] + [(11, 1, "u", "same")] * 30
    assert by_all(trie.build(turns(spark, rows)).collect()) == by_all(nodes(rows))


def test_trie_without_turns(spark):
    """Conversations that keep no turn are members of the root alone; no conversation, no root."""
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(lone, 0, "user", "a")]
    assert [tuple(r) for r in trie.build(turns(spark, rows)).collect()] == [(lone, 0, None, 1, 0, 1, 0, sha(str(lone)))]
    assert trie.build(turns(spark, [(None, 0, "user", "a")])).collect() == []
    assert trie.build(turns(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("shape", ["chain", "star", "comb", "binary", "random"])
def test_subtree_totals(spark, shape):
    n, some = 40, np.random.default_rng(7)
    up = {"chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: max(0, i - 2 + i % 2), "binary": lambda i: (i - 1) // 2, "random": lambda i: int(some.integers(i))}[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    value = some.integers(-5, 9, n).tolist()
    want = list(value)
    for i in range(n - 1, 0, -1):
        want[parent[i]] += want[i]
    rows = [(i, 0, p, None if p is None else 0, parent.count(i), v) for i, (p, v) in enumerate(zip(parent, value, strict=True))]
    tree = spark.createDataFrame(rows, "c bigint, d bigint, pc bigint, pd bigint, kids bigint, v bigint")
    assert sorted(map(tuple, trie.subtree_totals(tree, ["v"]).collect())) == [(i, 0, v) for i, v in enumerate(want)]


# Periodic runs


def stretches(words):
    """Every run (start, end, period), straight from the definition."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if i > begin and end - begin >= max(6, 4 * q) and not any(all(words[x] == words[x + r] for x in range(begin, end - r)) for r in range(1, q)):
                out.append((begin, end, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 5)), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=4))
def test_runs(texts):
    texts = [[x for root, times, more in t for x in (root * times) + root[:more]] for t in texts]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    found = periodic.runs(np.array([x for t in texts for x in t], np.int64), first)
    want = [(a + first[k], b + first[k], q) for k, t in enumerate(texts) for a, b, q in stretches(t)]
    assert list(zip(*(x.tolist() for x in found), strict=True)) == want


def described(i, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(i).encode())
    if planted and i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[x if x < a else a + (x - a) % p] for x in range(n)]
    found = stretches(words)
    best = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    gone = {x for a, b, q in found for x in range(a + q, b)}
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (i, len(found), *top, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), sha(" ".join(w for x, w in enumerate(words) if x not in gone)))


@pytest.mark.parametrize("planted", [False, True])
def test_periodic(spark, planted):
    """Nulls, blanks, unusual white space, repeated rows, a text of many slices, clashing names."""
    texts = [None, "", " \t\n", "a " * 9, "  é b\x0bé b\xa0 é b é b é b  ", "a\x1cb a", "x y z " * 20 + "tail", "one two three"]
    rows = [(i, texts[i % len(texts)] if i % 3 else f"w{i} " * 4 + "go on and on " * (i % 30)) for i in range(120)]
    rows += [(None, "a b " * 8), (7, "q " * 50), (7, "q " * 50)]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, start int, period string")
    assert by_all(periodic.find(docs, planted=planted).collect()) == by_all([described(i, t, planted) for i, t in rows])
    assert periodic.find(docs.limit(0), planted=planted).collect() == []


def test_long_periodic_text(spark):
    words = [f"w{i}" for i in range(1000)]
    text = " ".join(words[i % 997] for i in range(40_000))
    row = periodic.find(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 0, 40_000, 997, 40_120)
    assert row.collapsed_sha256 == sha(" ".join(words[:997]))


def test_planted_query_on_a_small_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 4000]
    some = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_all(periodic.find(some, planted=True).collect()) == by_all([described(i, t, True) for i, t in rows])
