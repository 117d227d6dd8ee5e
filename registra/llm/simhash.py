"""SimHash near-duplicate groups with bit-sliced comparison.

Fingerprints are 64-bit SimHashes of word shingles. Equal fingerprints collapse into one node first. Nodes that
differ in at most `radius` bits agree in `spare` of `radius + spare` runs of bits, so each choice of `spare` runs
makes a table, and any two linked nodes share a bucket (table, bits of those runs): the search is exact. Buckets of
one node are dropped. Of a large bucket every node is first compared with one of its nodes, the pivot, chunk by chunk;
nodes linked to the pivot need no more comparison with each other, and those that are nearer to the pivot than any
other node allows need none at all. Only the rest becomes tiles, pairs of chunks, so no task gets more than two chunks
of a bucket, and a group that hangs together around its pivot is read twice and not once for each chunk. In a task the
bit planes of all its nodes are stored vertically; the distances of all pairs
(i, i + d) of one bucket are counted side by side, plane after plane, in carry-save counters of machine words, and
words whose pairs all exceed the radius, or are linked already, are abandoned. Tasks return forests, not all pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.llm.common import in_slices, written
from registra.llm.components import connected_components

#: Nodes of a bucket beyond which it is dealt out as tiles of pairs of chunks of half as many.
TILE = 2048
#: Nodes whose buckets are compared at once in a task.
BATCH = 1 << 16
#: The same, of nodes that carry parities.
MARKED = 1 << 13


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the shingles in text order, repeats included; of the whole sequence if it is shorter than a shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, dtype="<u8")
    if len(found) < words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        starts = [0, *ends[: len(found) - words].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    return np.array(hashes, dtype="<u8")


def bits_of(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = 4) -> int:
    """SimHash of the text's shingles, repeats included; 0 for a text without words."""
    return bits_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) for each row; fp holds the 64 bits as a long. ASCII letters are lower-cased, words split at ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            fp = np.array([simhash(t, words) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fp long")


def masks(radius: int, spare: int) -> list[int]:
    """The tables: the bits of each choice of `spare` of `radius + spare` runs that the 64 bits are cut into."""
    n = radius + spare
    cuts = [64 * k // n for k in range(n + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(runs, spare)]


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) of uint64: bit i of plane k is bit k of fps[i]. One word of zeros is added, for shifts."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((64, ((n + 63) // 64 + 1) * 8), dtype=np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view("<u8")


def _word_bits(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, dtype=np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[: len(packed)] = packed
    return out.view("<u8")


def _within(planes: np.ndarray, at: np.ndarray, lanes: np.ndarray, d: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words `at` with lanes (i, i + d): those that keep lanes within the radius, and these lanes."""
    hop, shift = at + d // 64, np.uint64(d % 64)
    back = np.uint64(64 - d % 64) if d % 64 else None
    levels = (radius + 1).bit_length()
    counts = [np.zeros(len(at), dtype=np.uint64) for _ in range(levels)]
    over = np.zeros(len(at), dtype=np.uint64)
    for k in range(64):
        plane = planes[k]
        carry = plane[hop] if back is None else (plane[hop] >> shift) | (plane[hop + 1] << back)
        carry ^= plane[at]
        for c in counts:
            c ^= carry
            carry &= ~c
        over |= carry
        if k % 8 == 7:
            more, same = over.copy(), ~over
            for j in range(levels - 1, -1, -1):
                if radius >> j & 1:
                    same &= counts[j]
                else:
                    more |= same & counts[j]
                    same &= ~counts[j]
            left = lanes & ~more
            live = left != 0
            if not live.all():
                at, hop, lanes, over = at[live], hop[live], lanes[live], over[live]
                counts = [c[live] for c in counts]
            if not len(at):
                break
            last = left[live]
    return (at, last) if len(at) else (at, lanes)


def forest(bucket: np.ndarray, fps: np.ndarray, radius: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of row numbers that connect all rows of equal bucket (rows come sorted by it) that are linked by
    distances of at most radius. known rows of a bucket are linked to each other already."""
    n, pairs = len(fps), []
    if n < 2:
        return pairs
    words = (n + 63) // 64
    planes = bit_planes(fps)
    label = np.arange(n) if known is None else linked_before(bucket, known)
    parent = label.tolist()

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    rows = np.arange(n - 1)
    d = 1
    while True:
        rows = rows[rows + d < n]
        rows = rows[bucket[rows] == bucket[rows + d]]
        if not len(rows):
            return pairs
        todo = rows[label[rows] != label[rows + d]]
        if len(todo):
            flags = np.zeros(n, dtype=bool)
            flags[todo] = True
            lanes = _word_bits(flags, words)
            at = np.flatnonzero(lanes)
            at, kept = _within(planes, at, lanes[at], d, radius)
            if len(at):
                where = np.unpackbits(kept.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(where)
                for i in (at[r] * 64 + c).tolist():
                    a, b = find(i), find(i + d)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        pairs.append((i, i + d))
                label = np.array(parent)
                while (up := label[label]).tobytes() != label.tobytes():
                    label = up
        d += 1


def linked_before(bucket: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A label for each row: of known rows the first known one of their bucket, of others themselves."""
    label, at = np.arange(len(bucket)), np.flatnonzero(known)
    _, first, own = np.unique(bucket[at], return_index=True, return_inverse=True)
    label[at] = at[first][own]
    return label


def spare_runs(n: int, radius: int, most: int = 128) -> int:
    """Runs that a table's key is made of, so that a bucket holds `most` of n evenly spread nodes at most. Any number
    gives all links: more runs mean smaller buckets in more tables."""
    spare = 2
    while spare < 4 and n >> (64 * spare // (radius + spare)) > most:
        spare += 1
    return spare


def _met(keyed: DataFrame, tile: int, distances, limit: float, reach: float | None) -> tuple[DataFrame, DataFrame]:
    """keyed: (node, key, ...), longs. Gives the rows that are to be compared, with `bucket` instead of key and
    `known`, and edges (a, b) that are found already.

    Keys with two nodes to `tile` are buckets. Of larger ones each node's distance to the key's smallest node, the
    pivot, comes first: distances(rows) maps Arrow batches of (chunk, is_pivot, node, key, pivot, ...), sorted by chunk
    and the pivot first, to (node, key, pivot, ..., d). Nodes at `limit` or less are linked to the pivot: these are known.
    Tiles pair chunks of the others with each other and with the known ones; of a metric, known nodes that are farther
    than `reach` below the nearest other's distance are left out."""
    half = tile // 2
    names = [c for c in keyed.columns if c != "key"]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"))
    small = keyed.join(sizes.where(F.col("n").between(2, tile)).select("key"), "key").select(*names, F.col("key").alias("bucket"), F.lit(False).alias("known"))
    hot_keys = written(sizes.where(F.col("n") > tile), "hot")
    if hot_keys.isEmpty():
        return small, keyed.sparkSession.createDataFrame([], "a long, b long")
    hot = keyed.join(hot_keys, "key")
    chunks = F.ceil(F.col("n") / half).cast("int")
    own = hot.withColumn("is_pivot", F.col("node") == F.col("pivot")).withColumn("chunk_no", F.when(F.col("is_pivot"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), chunks).cast("int"))))
    dealt = own.withColumn("chunk", F.explode("chunk_no")).withColumn("chunk", F.xxhash64("key", "chunk")).drop("n", "chunk_no")
    ordered = dealt.repartition("chunk").sortWithinPartitions("chunk", F.desc("is_pivot"))
    payload = [f"`{c}` {t}" for c, t in keyed.dtypes if c not in ("node", "key")]
    pivoted = written(ordered.mapInArrow(distances, ", ".join(["node long, key long, pivot long", *payload, "d double"])).where("node <> pivot"), "pivoted")
    near = F.col("d") <= limit
    found = pivoted.where(near).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    rest = pivoted.groupBy("key").agg(F.count_if(~near).alias("n_other"), F.min(F.when(~near, F.col("d"))).alias("nearest"), F.count_if(near).alias("n_known")).where("n_other > 0")
    left = pivoted.join(written(rest, "rest"), "key")  # one row for each hot key
    if reach is not None:
        left = left.where(~near | (F.col("d") >= F.col("nearest") - reach))
    others, knowns = F.ceil(F.col("n_other") / half).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("n_known") / half).cast("int"))
    spread = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    struct = lambda i, j, with_known: F.struct(i.alias("i"), j.alias("j"), F.lit(with_known).alias("w"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    mine = spread(others)
    to_others = each(others, lambda j: struct(F.least(mine, j), F.greatest(mine, j), False))
    tiles = F.when(near, each(others, lambda i: struct(i, spread(knowns), True))).otherwise(F.concat(to_others, each(knowns, lambda j: struct(mine, j, True))))
    tiled = left.withColumn("known", near).withColumn("t", F.explode(tiles)).withColumn("bucket", F.xxhash64("key", "t.i", "t.j", "t.w"))
    return small.unionByName(tiled.select(*names, "bucket", "known")), found


def _with_distances(batch: pa.RecordBatch, d: list[float] | np.ndarray) -> pa.RecordBatch:
    """The batch's nodes and what they carry, with their distances to the pivot."""
    names = ["node", "key", "pivot", *(c for c in batch.schema.names if c not in ("node", "key", "pivot", "is_pivot", "chunk"))]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(d, pa.float64())], names=[*names, "d"])


def _bucket_links(keyed: DataFrame, radius: int, tile: int) -> DataFrame:
    """Edges (a, b) that connect the nodes (node, fp, key) of each key whose fp differ in at most `radius` bits."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            first = batch.column("is_pivot").to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(first, np.arange(len(fps)), -1))
            other = np.where(at >= 0, fps[np.maximum(at, 0)], pivot or 0)
            if len(fps):
                pivot = other[-1]
            d = np.bitwise_count(fps ^ other.astype(np.uint64)).astype(np.float64)
            yield _with_distances(batch, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.int64, bool)]

        def compared(bucket, fps, nodes, known):
            pairs = np.array(forest(bucket, fps, radius, known if known.any() else None), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            new = [batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("node").to_numpy(), batch.column("known").to_numpy(zero_copy_only=False)]
            held = [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= BATCH:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                if cut:
                    yield compared(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        yield compared(*held)

    rows, found = _met(keyed, tile, distances, radius, radius)
    return rows.select("node", "fp", "bucket", "known").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(run, "a long, b long").unionByName(found)


def links(nodes: DataFrame, radius: int = 4, spare: int = 2, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints nodes.fp that connect all that differ in at most `radius` bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius, spare)]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    return _bucket_links(nodes.select(F.col("fp").alias("node"), "fp", F.explode(keys).alias("key")), radius, tile)


def groups(found: DataFrame, radius: int = 4) -> DataFrame:
    """found: (id, fp). Adds component, the smallest id that can be reached over links; found is read twice.

    Null ids count as larger than any other; a component of null ids alone has a null component."""
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), radius, spare_runs(nodes.count(), radius)))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = linked.join(smallest, "root").select("fp", "component")
    return found.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """(id, fingerprint, component_id) for each row of docs.

    A null text counts as empty; texts without words have fingerprint zero and are linked like any other. Rows
    with the same id stay apart if their texts differ. An empty table gives an empty result; other columns aren't read."""
    found = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return groups(found, radius).select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


# Near-duplicates by similarity of shingle sets, for the pipeline: shared bands propose, the sets decide

#: Words of a shingle, and least similarity (Jaccard) of the shingle sets of linked texts.
WORDS, SIMILARITY = 5, 0.8
#: Bands of two minima each: two texts of similarity 0.8 share a band with a probability of 1 - (1 - 0.64) ** 14 > 0.999999.
BANDS = 14
#: Texts of a candidate component beyond which it is dealt out as tiles.
SET_TILE = 512
#: Bits of the SimHashes of two sets' distinct hashes up to which the sets are proposed without another look.
NEAR = 8

_FACTORS = np.random.default_rng(42).integers(1 << 62, 1 << 63, 2 * BANDS, dtype=np.uint64) | np.uint64(1)


def bands(distinct: np.ndarray) -> np.ndarray:
    """A key for each band: two minima of the distinct hashes under multiplications modulo 2**64."""
    least = np.array([(distinct * f).min() for f in _FACTORS], dtype=np.uint64).reshape(BANDS, 2)
    return (least[:, 0] ^ (least[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def parities(distinct: np.ndarray) -> bytes:
    """A bit for each of 64 * 2 ** k cells, about one for every two hashes: whether an odd number of hashes falls there.

    A hash that only one of two sets has turns one bit, so the bits that differ are never more than the hashes that
    differ. The halves of longer parities, laid over each other, are the shorter ones of the same set."""
    cells = max(64, 1 << max(1, (len(distinct) - 1).bit_length()) - 1)
    odd = np.bincount((distinct & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(differ: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets whose sizes sum up to sizes and that differ in `differ` hashes or more can be that similar: sets of
    a and b hashes that differ in d have similarity (a + b - d) / (a + b + d)."""
    return differ * (1 + similarity) <= sizes * (1 - similarity) + 1e-9


def folded(bits: bytes, width: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bits, dtype="<u8").reshape(-1, width // 8), axis=0)


def possible_pairs(sizes: np.ndarray, bits: list[bytes], similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers that connect all sets that are linked by pairs whose sizes and parities allow that similarity.
    Leaves out no similar pair. Sets of equal label are linked already."""
    order = np.argsort(sizes, kind="stable")
    label, pairs = np.arange(len(sizes)) if label is None else label.copy(), []
    ordered, widths = sizes[order], np.array([len(bits[i]) for i in order])
    for width in np.unique(widths).tolist():
        # by size, those of this width, and longer ones, folded, up to the largest size that can be similar
        start, own = np.searchsorted(widths, [width, width + 1]).tolist()
        last = np.searchsorted(ordered, ordered[start:own] / similarity * (1 + 1e-9), "right")
        rows, size = order[start : last[-1]], ordered[start : last[-1]]
        cells = np.empty((len(rows), width // 8), dtype="<u8")
        for i, row in enumerate(rows):
            cells[i] = folded(bits[row], width)
        last = (last - start).tolist()
        for k, stop in enumerate(last):
            if stop <= k + 1:
                continue
            differ = np.bitwise_count(cells[k] ^ cells[k + 1 : stop]).sum(axis=1, dtype=np.int64)
            may = possible(differ, size[k] + size[k + 1 : stop], similarity)
            for j in rows[k + 1 : stop][may & (label[rows[k + 1 : stop]] != label[rows[k]])].tolist():
                if label[j] != label[rows[k]]:
                    pairs.append((int(rows[k]), j))
                    label[label == label[j]] = label[rows[k]]
    return pairs


def _marks(rows: DataFrame) -> DataFrame:
    """(id, node, size, bits, fp, keys) of rows (id, text): node is the digest of the text's shingle set, fp the SimHash
    of its distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            nodes, sizes, bits, fps, keys = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(text, WORDS))
                nodes.append(xxhash.xxh64_intdigest(distinct.tobytes()))
                sizes.append(len(distinct))
                bits.append(parities(distinct))
                fps.append(bits_of(distinct))
                keys.append(bands(distinct) if len(distinct) else [])
            longs = [np.array(x, dtype=np.uint64).view(np.int64) for x in (nodes, fps)]
            columns = [pa.array(longs[0]), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(longs[1]), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "node", "size", "bits", "fp", "keys"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, node long, size long, bits binary, fp long, keys array<long>")


def _candidates(keyed: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Edges (a, b) that connect the nodes (node, size, bits, fp, key) of each key whose sizes and parities allow that
    similarity. SimHashes within NEAR bits, compared bit-sliced, are taken first, so that only the pairs between what
    they connect are left to the parities."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in in_slices(batches, "bits"):
            out = []
            for first, size, bits in zip(*(batch.column(c).to_pylist() for c in ("is_pivot", "size", "bits"))):
                if first:
                    pivot = (size, bits)
                width = min(len(bits), len(pivot[1]))
                differ = int(np.bitwise_count(folded(bits, width) ^ folded(pivot[1], width)).sum())
                out.append(0.0 if possible(differ, size + pivot[0], similarity) else 1.0)
            yield _with_distances(batch, out)

    def compared(bucket, node, size, bits, fp, known):
        bucket, node, size, known = np.array(bucket), np.array(node), np.array(size, dtype=np.int64), np.array(known, dtype=bool)
        pairs = forest(bucket, np.array(fp, dtype=np.int64).view(np.uint64), NEAR, known if known.any() else None)
        label = linked_before(bucket, known)
        if pairs:
            parent = label.tolist()

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for a, b in pairs:
                parent[find(a)] = find(b)
            label = np.array([find(i) for i in range(len(parent))])
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for a, b in zip(starts, [*starts[1:], len(bucket)]):
            own = label[a:b]
            if b - a > 1 and (own != own[0]).any():
                pairs += [(a + i, a + j) for i, j in possible_pairs(size[a:b], bits[a:b], similarity, own)]
        pairs = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(6)]
        for batch in in_slices(batches, "bits"):
            for x, c in zip(held, ("bucket", "node", "size", "bits", "fp", "known")):
                x += batch.column(c).to_pylist()
            if len(held[0]) >= MARKED and held[0][0] != held[0][-1]:
                cut = bisect_left(held[0], held[0][-1])
                yield compared(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held[0]:
            yield compared(*held)

    rows, found = _met(keyed, tile, distances, 0.5, None)
    return rows.select("node", "size", "bits", "fp", "bucket", "known").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").unionByName(found)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def similar_sets(sets: list[np.ndarray], similarity: float, known: list[bool] | None = None) -> list[tuple[int, int]]:
    """Pairs of numbers that connect all sets (sorted, distinct) that are linked by similarities of at least
    `similarity`. known ones are linked to each other already."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    parent, pairs = list(range(len(sets))), []
    if known and any(known):
        parent = [known.index(True) if k else i for i, k in enumerate(known)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            small, large = len(sets[i]), len(sets[j])
            if small < similarity * large:
                break
            if find(i) == find(j):
                continue
            if similarity_of(sets[i], sets[j]) >= similarity - 1e-9:
                parent[find(i)] = find(j)
                pairs.append((i, j))
    return pairs


def _verified(rows: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Edges (a, b) between nodes of one candidate component whose shingle sets are similar enough. The sets are made
    anew from the texts of the components' nodes; only these are read."""
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    wanted = nodes.join(every, "node").select(F.col("least").alias("id"), "node", F.col("root").alias("key"))
    members = written(rows.join(wanted, "id").dropDuplicates(["node"]).select("node", "key", "text"), "members")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = None
        for batch in in_slices(batches, "text"):
            out = []
            for first, text in zip(*(batch.column(c).to_pylist() for c in ("is_pivot", "text"))):
                own = np.unique(shingle_hashes(text, WORDS))
                pivot = own if first else pivot
                out.append(1.0 - similarity_of(own, pivot))
            yield _with_distances(batch, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets, knowns, out = None, [], [], [], []

        def done():
            out.extend((nodes[i], nodes[j]) for i, j in similar_sets(sets, similarity, knowns))
            for x in (nodes, sets, knowns):
                x.clear()

        for batch in in_slices(batches, "text"):
            for bucket, node, text, known in zip(*(batch.column(c).to_pylist() for c in ("bucket", "node", "text", "known"))):
                if bucket != at:
                    done()
                    at = bucket
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text, WORDS)))
                knowns.append(known)
        done()
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    limit = 1 - similarity + 1e-9
    near, found = _met(members, tile, distances, limit, limit + 1e-9)
    return near.select("node", "text", "bucket", "known").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").unionByName(found)


def similar(rows: DataFrame, similarity: float = SIMILARITY, tile: int = TILE, set_tile: int = SET_TILE) -> DataFrame:
    """(id, component) for rows (id, text): components over links between texts whose sets of 5-word shingles have at
    least that similarity; component is the smallest id. Texts of equal sets are one node, so are texts without words.

    Texts meet if they share a band of minima; those with near SimHashes, and those whose sizes and parities don't rule
    out the similarity, give candidate components, within which the sets decide."""
    marked = written(_marks(rows), "marks")
    nodes = written(marked.groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("size", "bits", "fp", "keys")]), "nodes")
    loose = _candidates(nodes.select("node", "size", "bits", "fp", F.explode("keys").alias("key")), similarity, tile)
    roots = connected_components(loose)
    linked = connected_components(_verified(rows, nodes.select("node", "least"), roots, similarity, set_tile))
    grouped = nodes.select("node", "least").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component"))
    return marked.select("id", "node").join(grouped.join(smallest, "root").select("node", "component"), "node").select("id", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row for each group of near-duplicates (see similar): the one with the smallest id, the first of
    repeated rows; null ids count as the largest. All columns stay, whatever they are called."""
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("distinct")).first()
    if ids["n"] == ids["distinct"]:  # the ids are keys: no copy of the table is needed
        found = similar(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), similarity)
        kept = found.select(F.col("component").alias(id_col)).distinct()
        return docs.join(kept.hint("merge"), id_col, "left_semi").select(*docs.columns)
    row, names = "__row", docs.columns
    while row in names:
        row = "_" + row
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ranked = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("own"), F.col(row).alias("row")).alias("id"), F.col(text_col).alias("text"))
    kept = similar(ranked, similarity).select("component.row").distinct().withColumnRenamed("row", row)
    return rows.join(kept, row, "left_semi").select(*names)
