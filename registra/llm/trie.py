"""The prefix trie of conversations and its subtree totals, by parallel tree contraction.

Turns are numbered within their conversation by a range partitioning and counts of its parts, so that a conversation of
any length is many tasks' work. A prefix is known by its depth and 128 bits: the exclusive or of hashes of its turns,
each with its number, summed in blocks of turns and then over the blocks. Nodes are groups of equal prefixes and are
called by their smallest member and depth.

Contraction takes turns: *rake* adds every leaf's totals to its parent; *compress* replaces every chain of nodes with
one child by an edge that carries the chain's sum, all chains at once by doubling pointers. What is left has two
children a node, so the number of phases is logarithmic in the number of nodes and that of joins in a phase in the
longest chain. Then the phases are undone in reverse: a compressed node's total is that of its chain's end and what the
pointer has gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of one conversation that are summed in one group.
BLOCK = 1024
_ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def numbered_turns(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, digest, words) with pos, from 0 in each conversation, by turn (null first), then digest."""
    light = written(turns, "turns")
    ordered = light.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "digest").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest")
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", _ROW_BITS))
    parts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(parts, ["conv", "part"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, heads: int = 4, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of the rebuilt conversations (conv, pos, n, digest, words), and (conv, n) for each of them, n being
    the number of its turns. conv takes its first h turns from conv - conv % group (all that it has), h being crc32 of
    conv in decimal modulo `heads`, and leaves out as many of its own."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n_own"))
    ids = own.select("conv", "n_own", (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    ids = ids.join(own.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base")), "base", "left")
    ids = ids.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    ids = written(ids.withColumn("n", F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))), "ids")
    kept = turns.join(ids.select("conv", "n", "h", "taken"), "conv").where("pos >= h")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "n", "digest", "words")
    lent = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv", "base").join(ids.select("conv", "base", "n", "h"), "base").where("pos < h")
    return kept.unionByName(lent.select("conv", "pos", "n", "digest", "words")), ids.select("conv", "n")


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, words, last): every prefix of every conversation, with its parent's key."""
    own = turns.withColumns({f"g{i}": F.xxhash64(F.lit(i), "pos", "digest") for i in (1, 2)}).withColumn("block", F.floor(F.col("pos") / BLOCK))
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = own.where(F.col("n") > BLOCK).groupBy("conv", "block").agg(*[F.bit_xor(f"g{i}").alias(f"b{i}") for i in (1, 2)])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.bit_xor(f"b{i}").over(earlier).alias(f"b{i}") for i in (1, 2)])
    summed = own.withColumns({f"s{i}": F.bit_xor(f"g{i}").over(inside) for i in (1, 2)}).join(blocks, ["conv", "block"], "left")
    key = lambda i: F.col(f"s{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0)))
    steps = summed.select("conv", (F.col("pos") + 1).alias("depth"), *[key(i).alias(f"k{i}") for i in (1, 2)], *[key(i).bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)], "words", (F.col("pos") + 1 == F.col("n")).alias("last"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("depth", "k1", "k2", "p1", "p2")]
    return steps.unionByName(ids.select("conv", *zero, F.lit(0).cast("bigint").alias("words"), (F.col("n") == 0).alias("last")))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], ["depth", "k1", "k2", "ends_sha256"])


def end_digests(steps: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end: their ids in ascending order, joined by
    commas. A digest is one sequence; the ids stream through it in sorted order and are never held together."""

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for part in parts:
            keys = np.stack([part.column(c).to_numpy() for c in ("depth", "k1", "k2")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), part.num_rows]
            ids, out = part.column("conv").to_pylist(), []
            for begin, end in pairwise(cuts):
                if end == begin:
                    continue
                own, joined = tuple(keys[begin].tolist()), ",".join(map(str, ids[begin:end]))
                if own == key:
                    state.update(b"," + joined.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256(joined.encode())
            yield batch(out)
        if key is not None:
            yield batch([(*key, state.hexdigest())])

    key = ["depth", "k1", "k2"]
    ends = steps.where("last").select(*key, "conv").repartition(*key).sortWithinPartitions(*key, "conv")
    return ends.mapInArrow(hashed, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(c, d, *values) for every node (c, d) of a tree: the values summed over its subtree. tree: (c, d, pc, pd, kids,
    *values) with the parent (pc, pd), null for the root, and the number of children."""
    add = [f"add_{v}" for v in values]
    alive, raked, phases = tree.withColumns({a: F.lit(0).cast("bigint") for a in add}), [], []
    inner = lambda kids: (F.col("kids") == kids) & F.col("pc").isNotNull()
    while True:
        leaves = alive.where("kids = 0")
        given = leaves.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d"))
        given = given.agg(F.count("*").alias("gone"), *[F.sum(F.col(v) + F.col(a)).alias(f"got_{v}") for v, a in zip(values, add, strict=True)])
        after = alive.join(given, ["c", "d"], "left").withColumn("leaf", F.col("kids") == 0)
        got = {v: F.col(v) + F.coalesce(f"got_{v}", F.lit(0)) for v in values}
        after = after.withColumns(got | {"kids": F.col("kids") - F.coalesce("gone", F.lit(0))}).select(*alive.columns, "leaf")
        after = written(after, "raked")
        raked.append(after.where("leaf").select("c", "d", *values))
        stay = after.where("not leaf").drop("leaf")
        left, unary = stay.agg(F.count("*"), F.count_if(inner(1))).first()
        if not left:
            break
        alive = stay
        if unary:
            chains = _chains(stay, values, add, inner(1))
            phases.append(chains)
            tops = stay.where(inner(1)).join(chains.select(F.col("nc").alias("c"), F.col("nd").alias("d")), ["c", "d"], "left_anti")
            # the end of a chain hangs from the parent of its top, by an edge that carries the chain's sum
            first = tops.select("c", "d", F.col("pc").alias("tc"), F.col("pd").alias("td"), *[F.col(a).alias(f"top_{a}") for a in add])
            ends = first.join(chains.where("whole"), ["c", "d"]).drop("c", "d")
            ends = ends.select(F.col("ec").alias("c"), F.col("ed").alias("d"), "tc", "td", *[(F.col(f"sum_{v}") + F.col(f"top_{a}")).alias(f"new_{a}") for v, a in zip(values, add, strict=True)])
            held = stay.where(~F.coalesce(inner(1), F.lit(False))).join(ends, ["c", "d"], "left")
            hung = {"pc": F.coalesce("tc", "pc"), "pd": F.coalesce("td", "pd")} | {a: F.coalesce(f"new_{a}", a) for a in add}
            alive = held.withColumns(hung).select(*stay.columns)
    total = raked[0]
    for r in raked[1:]:
        total = total.unionByName(r)
    for chains in reversed(phases):
        met = chains.select("c", "d", F.col("ec").alias("nc"), F.col("ed").alias("nd"), *[f"sum_{v}" for v in values])
        ends = total.select(F.col("c").alias("nc"), F.col("d").alias("nd"), *values)
        found = met.join(ends, ["nc", "nd"]).select("c", "d", *[(F.col(v) + F.col(f"sum_{v}")).alias(v) for v in values])
        total = total.unionByName(written(found, "expanded"))
    return total


def _chains(stay: DataFrame, values: list[str], add: list[str], unary: Column) -> DataFrame:
    """(c, d, nc, nd, ec, ed, sum_*) for each node with one child, the root apart: its child (nc, nd), the end of its
    chain (ec, ed), the first node below that isn't such, and what its total has above that of the end. Pointers jump
    until none points to a node that has one itself."""
    own = stay.where(unary).select("c", "d", *[F.col(v).alias(f"sum_{v}") for v in values])
    child = stay.select(F.col("pc").alias("c"), F.col("pd").alias("d"), F.col("c").alias("nc"), F.col("d").alias("nd"), *add)
    met = own.join(child, ["c", "d"])
    jump = met.select("c", "d", "nc", "nd", F.col("nc").alias("ec"), F.col("nd").alias("ed"), *[(F.col(f"sum_{v}") + F.col(a)).alias(f"sum_{v}") for v, a in zip(values, add, strict=True)])
    jump = written(jump.withColumn("whole", F.lit(False)), "chains")
    while True:
        on = jump.select(F.col("c").alias("ec"), F.col("d").alias("ed"), F.col("ec").alias("fc"), F.col("ed").alias("fd"), F.col("whole").alias("over"), *[F.col(f"sum_{v}").alias(f"more_{v}") for v in values])
        both = jump.join(on, ["ec", "ed"], "left")
        sums = {f"sum_{v}": F.col(f"sum_{v}") + F.coalesce(f"more_{v}", F.lit(0)) for v in values}
        both = both.withColumns(sums | {"whole": F.col("fc").isNull() | F.col("over"), "ec": F.coalesce("fc", "ec"), "ed": F.coalesce("fd", "ed")})
        jump = written(both.select(*jump.columns), "chains")
        if jump.where("not whole").isEmpty():
            return jump


def build(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the smallest conversation that begins with the node's turns, parent_conv_id that of its parent (null for
    the root), n_convs their number; saved_tokens is the sum, over the subtree, of (n_convs - 1) times the words of a
    node's last text; ends_sha256 of the ids of conversations that end at the node.

    Null roles and texts are empty. Turns of one number are ordered by a digest of role and text; repeated rows are turns
    of their own. Rows without a conversation's id belong to none; without any conversation there is no root and no row.
    `%` is SQL's (its sign is the id's). Columns of other names aren't read."""
    text, role = F.coalesce(conversations[text_col], F.lit("")), F.coalesce(conversations[role_col], F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)).cast("binary")))
    rows = conversations.select(conversations[conv_col].cast("bigint").alias("conv"), conversations[turn_col].cast("bigint").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    turns = written(numbered_turns(rows.where("conv is not null")), "numbered")
    steps = written(prefixes(*rebuilt(turns)), "prefixes")
    key = ["depth", "k1", "k2"]
    groups = steps.groupBy(*key).agg(F.min("conv").alias("c"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    groups = written(groups, "groups")
    up = groups.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("pc"))
    kids = groups.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("kids"))
    nodes = groups.join(up, ["depth", "p1", "p2"], "left").join(kids, key, "left").join(end_digests(steps), key, "left")
    nodes = nodes.select("c", F.col("depth").alias("d"), "pc", F.when(F.col("pc").isNotNull(), F.col("depth") - 1).alias("pd"), "n_convs", F.coalesce("kids", F.lit(0)).alias("kids"), "words", "ends_sha256")
    nodes = written(nodes, "nodes")
    leaf = F.when(F.col("kids") == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    tree = nodes.select("c", "d", "pc", "pd", "kids", leaf.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    out = nodes.join(subtree_totals(tree, ["leaves", "saved"]), ["c", "d"])
    return out.select(
        F.col("c").alias(conv_col), F.col("d").alias("depth"), F.col("pc").alias(f"parent_{conv_col}"), "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
