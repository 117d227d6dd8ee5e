"""Byte-level BPE encoding and decoding by rank, with segment trees.

Each match of the split pattern is encoded by itself. Its bytes are the leaves of a segment tree whose nodes
hold the smallest pair rank below them, the leftmost one on ties: key = rank * width + position. A merge takes
the root's pair, joins it with its right neighbour and updates the leaves whose pair changed (the merged one,
the previous live one and the one that died), a logarithmic number of nodes each. Trees of all new pieces of
one batch and one width are updated side by side in numpy arrays; pieces seen before come from a bounded memo.

Texts are first cut at single spaces, where every match of the pattern ends: see Units.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from registra.llm.common import in_slices

#: Pieces, and units of texts, that a task keeps encoded; beyond it the memo is emptied. A bound on memory only: results don't depend on it.
MEMO, UNITS = 100_000, 200_000
#: Longer pieces and units aren't kept.
LONGEST = 64
#: Cells of the arrays of trees that are updated together.
CELLS = 500_000

_BIG = np.int64(1) << 62
#: Of the multiplicative hash of pairs.
_SPREAD = 0x9E3779B97F4A7C15
#: Fewer trees than so many of one width are updated one by one.
_FEW = 24


# Fixed value: the public pattern whose matches all end before a space that isn't next to other white space.
AT_SPACES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACED = re.compile(r" \s")


class Ranks:
    """A rank file: the ids of single bytes, the bytes of each id, and the ids that pairs of ids merge to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {
            (ranks[token[:k]] << 32) | ranks[token[k:]]: i
            for token, i in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.pairs = pairs
        self.of_bytes = np.full((256, 256), _BIG, dtype=np.int64)
        for a in range(256):
            for b in range(256):
                self.of_bytes[a, b] = ranks.get(bytes([a, b]), _BIG)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.merged = np.full((1 << self.bits) + 64, _BIG, dtype=np.int64)
        for key, i in pairs.items():
            at = (key * _SPREAD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.merged[at] = key, i

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; _BIG where a pair doesn't merge (also where right is -1). A hash table with linear probing."""
        key = (left << 32) | right
        at = ((key.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found, out = self.keys[at], self.merged[at]
        out[found != key] = _BIG
        todo = np.flatnonzero((found != key) & (found >= 0) & (right >= 0))
        while len(todo):
            at[todo] += 1
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.merged[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


@lru_cache(maxsize=4)
def ranks_at(path: str) -> Ranks:
    return Ranks(path)


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    start = 0
    while start < len(order):
        width = 1 << int(lengths[order[start]] - 1).bit_length()
        stop = int(np.searchsorted(lengths[order], width, side="right"))
        step = max(1, CELLS // width)
        for k in range(start, stop, step):
            at = order[k : min(stop, k + step)]
            if len(at) < _FEW:
                for i in at.tolist():
                    out[i] = _encode_tree(pieces[i], ranks)
                continue
            _encode_trees([pieces[i] for i in at], lengths[at], width, ranks, at, out)
        start = stop
    return out


def _encode_trees(pieces, lengths, width, ranks, at, out) -> None:
    n, depth = len(pieces), width.bit_length() - 1
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    alive = np.arange(width) < lengths[:, None]
    ids = np.where(alive, ranks.byte_ids[raw], -1)
    after = np.where(np.arange(1, width + 1) < lengths[:, None], np.arange(1, width + 1), -1)
    before = np.where(alive, np.arange(-1, width - 1), -1)
    tree = np.full((n, 2 * width), _BIG, dtype=np.int64)
    if width > 1:
        rank = np.where(alive[:, 1:], ranks.of_bytes[raw[:, :-1], raw[:, 1:]], _BIG)
        tree[:, width : 2 * width - 1] = np.where(rank < _BIG, rank * width + np.arange(width - 1), _BIG)
        for level in range(depth - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
    rows = np.flatnonzero(tree[:, 1] < _BIG)
    while len(rows):
        key = tree[rows, 1]
        left, new = key % width, key // width
        dead = after[rows, left]
        ids[rows, left] = new
        ids[rows, dead] = -1
        follow = after[rows, dead]
        after[rows, left] = follow
        has = follow >= 0
        before[rows[has], follow[has]] = left[has]
        prior = before[rows, left]
        _update(tree, rows, dead, np.full(len(rows), _BIG), width)
        rank = ranks.of_pairs(new, np.where(has, ids[rows, np.maximum(follow, 0)], -1))
        _update(tree, rows, left, np.where(rank < _BIG, rank * width + left, _BIG), width)
        has = prior >= 0
        some, prior = rows[has], prior[has]
        rank = ranks.of_pairs(ids[some, prior], new[has])
        _update(tree, some, prior, np.where(rank < _BIG, rank * width + prior, _BIG), width)
        rows = rows[tree[rows, 1] < _BIG]
    kept = ids >= 0
    flat, ends = ids[kept].astype("<u4").tobytes(), np.cumsum(kept.sum(axis=1)) * 4
    for i, a, b in zip(at.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        out[i] = flat[a:b]


def _update(tree, rows, leaf, value, width) -> None:
    node = leaf + width
    tree[rows, node] = value
    node = node >> 1
    while len(node) and node[0]:
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        node = node >> 1


def _encode_tree(piece: bytes, ranks: Ranks) -> bytes:
    """One tree, for long pieces and for few of them: plain lists instead of arrays."""
    n, big = len(piece), int(_BIG)
    width = 1 << max(0, n - 1).bit_length()
    ids: list[int] = ranks.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    tree = [big] * (2 * width)
    pairs = ranks.pairs.get
    for i in range(n - 1):
        rank = pairs((ids[i] << 32) | ids[i + 1])
        if rank is not None:
            tree[width + i] = rank * width + i
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while tree[1] < big:
        new, left = divmod(tree[1], width)
        dead = after[left]
        follow, prior = after[dead], before[left]
        ids[left], ids[dead], after[left] = new, -1, follow
        changed = [(dead, big)]
        rank = None
        if follow >= 0:
            before[follow] = left
            rank = pairs((new << 32) | ids[follow])
        changed.append((left, big if rank is None else rank * width + left))
        if prior >= 0:
            rank = pairs((ids[prior] << 32) | new)
            changed.append((prior, big if rank is None else rank * width + prior))
        for leaf, value in changed:
            node = leaf + width
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1
    return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()


def units(text: str) -> list[str]:
    """The text cut before its spaces, the space left out. A space between white space (or between white space and the
    text's end) is no cut: there it stays in the unit."""
    found = text.split(" ")
    out = found[:1]
    for k in range(1, len(found)):
        before, after = out[-1], found[k]
        inner = k > 1 and not before or before[-1:].isspace()
        if inner and (not after or after[0].isspace()):
            out[-1] = f"{before} {after}"
        else:
            out.append(after)
    return out


class Units:
    """Encodes texts unit by unit, a batch of texts at a time. Arrow cuts the texts and finds the batch's distinct
    units; each of them is encoded once, or comes from the memo of up to `most` units and those of one batch; the ids
    are gathered with numpy.

    encode: gives the ids of each of many strings as little-endian unsigned 32-bit integers. A unit that isn't the
    first of its text is encoded with the space before it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = UNITS):
        self.encode, self.most, self.memo = encode, most, {}

    def _packed(self, keys: list[str]) -> list[bytes]:
        found = list(map(self.memo.get, keys))
        if None in found:
            at = [k for k, x in enumerate(found) if x is None]
            new = [keys[k] for k in at]
            made = self.encode(new)
            for k, x in zip(at, made):
                found[k] = x
            self.memo.update(zip(new, made))
            for u in new:
                if len(u) > LONGEST:
                    del self.memo[u]
        return found

    def _gathered(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        first = lists.offsets.to_numpy()[:-1].astype(np.int64)
        words = lists.flatten()
        rest = np.ones(len(words), dtype=bool)
        rest[first] = False
        leading, others = words.take(pa.array(first)).dictionary_encode(), words.filter(pa.array(rest)).dictionary_encode()
        spaced = pc.binary_join_element_wise("", others.dictionary, " ")
        # to_numpy makes the strings at once, to_pylist one by one
        table = self._packed([w for x in (spaced, leading.dictionary) for w in x.to_numpy(zero_copy_only=False).tolist()])
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), dtype="<u4")
        row = np.empty(len(words), dtype=np.int64)
        row[rest], row[first] = others.indices.to_numpy(), leading.indices.to_numpy() + len(others.dictionary)
        n = sizes[row]
        place = np.repeat(starts[row] - np.cumsum(n) + n, n)
        place += np.arange(len(place))
        return ids[place], np.add.reduceat(n, first) if len(first) else n

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > self.most:
            self.memo.clear()
        odd = [bool(_SPACED.search(t)) or t[-1:] == " " and t[-2:-1].isspace() for t in texts]
        even = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " ")
        parts = []
        for lists in (even, pa.array([units(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))):
            ids, counts = self._gathered(lists)
            ends = np.cumsum(counts)
            parts.append(iter([ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]))
        return [next(parts[o]) for o in odd]


def piecewise(encode: Callable[[list[str]], list[bytes]], pattern: str, most: int = MEMO) -> Callable[[list[str]], list[bytes]]:
    """The ids of strings by those of their pieces, the pattern's matches; each new piece is encoded once."""
    memo: dict[str, bytes] = {}
    find = regex.compile(pattern).findall

    def run(texts: list[str]) -> list[bytes]:
        parts = list(map(find, texts))
        if len(memo) > most:
            memo.clear()
        new = list(set().union(*parts).difference(memo))
        memo.update(zip(new, encode(new)))
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        for piece in new:
            if len(piece) > LONGEST:
                del memo[piece]
        return out

    return run


def encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes lists of texts. Its memos go with it: a worker that waits for its next task holds only the ranks."""
    ranks = ranks_at(path)
    run = piecewise(lambda new: encode_pieces([p.encode("utf-8", "replace") for p in new], ranks), pattern)
    return Units(run) if pattern == AT_SPACES else run


def decode(ids: np.ndarray, ranks: Ranks) -> bytes:
    return b"".join(map(ranks.bytes_of.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again: id, n_tokens, ids_sha256, decoded_sha256, and `ids` if asked for.

    One row for each input row, repeated rows included, in one pass without a shuffle. A null or empty text has no
    ids, and the digests are those of no bytes. Other columns of docs, whatever their names, are not read.
    ranks_path is read on the executors: a file that is on each of them, like an installed package's."""
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out_types = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches):
        encode, ranks = encoder(ranks_path, pattern), ranks_at(ranks_path)
        for batch in in_slices(batches, "text"):
            counts, a, b, all_ids = [], [], [], []
            for packed in encode([t or "" for t in batch.column("text").to_pylist()]):
                ids = np.frombuffer(packed, dtype="<u4")
                counts.append(len(ids))
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(decode(ids, ranks)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column("id"), *(pa.array(x, t) for x, (_, t) in zip((counts, a, b), out_types))]
            names = [id_col, *(n for n, _ in out_types)]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
