"""A Merkle manifest of a table: leaves of rows, trees of eight by group, proofs of every leaf by Merkle traversal.

A leaf is the hash of a row's fields. The leaves of a group, in order, are the lowest level of a tree: every 8 consecutive nodes become their
hash, level by level, until one is left, the group's subroot; subroots in the groups' order make the root's tree in the same way.

Trees are cut into aligned blocks of 8^4 leaves, so no task needs more than a block. A first pass has the root of each block, by
treehash; block roots are the leaves of the next, thinner round, until each group has one. A second pass walks each block leaf by leaf: it keeps the run of
eight nodes that the leaf's ancestor belongs to on every level, and on every level above the first a treehash stack that takes in one leaf of the
following run at a time, so that this run is ready when the walk gets there. What lies above the block is the same for all of its leaves and is appended.

Any column may be null; ties (equal ids) go by leaf, so repeated rows stand side by side with leaves of their own and proofs of their own. A null id comes
first and is never tampered with. An empty table has no leaves and no root. Columns that no leaf is made of are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import ASCII_LOWER, materialise, small_side, tidy, tidy_pair

WIDE = 8
#: Levels in a block.
LEVELS = 4
BLOCK = WIDE**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(texts: list[bytes]) -> bytes:
    """Of concatenated hex digests, as hex."""
    return hashlib.sha256(b"".join(texts)).hexdigest().encode()


def leaf(fields: list[Column]) -> Column:
    """Hash of a row: of each field `-` if it is null, else its UTF-8 bytes' number, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*said), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, "".join(map(chr, ASCII_LOWER)), "".join(map(chr, ASCII_LOWER.values())))


# ---- trees in a block


class Treehash:
    """Takes leaves one by one and gives the nodes of a level above; keeps less than eight nodes of each level between."""

    def __init__(self, level: int):
        self.open: list[list[bytes]] = [[] for _ in range(level)]
        self.done: list[bytes] = []

    def add(self, node: bytes) -> None:
        for nodes in self.open:
            nodes.append(node)
            if len(nodes) < WIDE:
                return
            node = digest(nodes)
            nodes.clear()
        self.done.append(node)

    def finish(self) -> list[bytes]:
        """The nodes; runs that were left short are closed as they are."""
        for level, nodes in enumerate(self.open):
            if nodes:
                node = digest(nodes)
                nodes.clear()
                if level + 1 < len(self.open):
                    self.open[level + 1].append(node)
                else:
                    self.done.append(node)
        out, self.done = self.done, []
        return out


def block_root(leaves: list[bytes], height: int) -> bytes:
    stack = Treehash(height)
    for node in leaves:
        stack.add(node)
    return stack.finish()[0]


def traversal(leaves: list[bytes], height: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """For one leaf after the other its place and run on each level, the lowest first.

    Besides the leaves it keeps a run and a stack for each level.
    """
    runs, ahead = [], [Treehash(level) for level in range(height)]
    for level in range(height):  # the runs of the first leaf
        for node in leaves[: WIDE ** (level + 1)]:
            ahead[level].add(node)
        runs.append(ahead[level].finish())
    for i in range(len(leaves)):
        yield [(i // WIDE**level % WIDE, runs[level]) for level in range(height)]
        for level in range(height):
            span = WIDE ** (level + 1)
            if i + span < len(leaves):  # of the next run of this level
                ahead[level].add(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level] = ahead[level].finish()


# ---- rounds of blocks


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with idx, the place within `by` in the order of `order` (whose first is by), and n, how many rows `by` has.

    Rows are sorted by range; what is added up are the sizes of groups within ranges.
    """
    shuffled = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = rows.repartitionByRange(shuffled, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "merkle-order").withColumn("__part", F.shiftright("__at", 33))
    sizes = ranged.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy(by)
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    starts = sizes.select(by, "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("n"))
    return ranged.join(small_side(starts), [by, "__part"]).withColumn("idx", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def height() -> Column:
    """Levels of a block of a group that has n nodes on this round."""
    return sum(((F.col("n") > WIDE**k).cast("int") for k in range(LEVELS)), F.lit(0))


@tidy
def _root(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("idx")
    node = block_root([x.encode() for x in block["digest"]], int(block["height"].iloc[0]))
    return pd.DataFrame({"grp": [block["grp"].iloc[0]], "idx": [block["idx"].iloc[0] // BLOCK], "n": [-(-block["n"].iloc[0] // BLOCK)], "digest": [node.decode()]})


NODES = "grp string, idx long, n long, digest string"


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes (grp, idx, n, digest) and, round by round, the roots of their blocks, until each group has one."""
    out, most = [nodes], nodes.agg(F.max("n")).head()[0] or 0
    while most > 1:
        block = F.floor(F.col("idx") / BLOCK).alias("__block")
        roots = out[-1].select("grp", "idx", "n", "digest", height().alias("height")).groupBy("grp", block).applyInPandas(_root, NODES)
        out.append(materialise(roots, "merkle-roots"))
        most = -(-most // BLOCK)
    return out


STEPS = "steps array<struct<place: int, others: string>>"


@tidy_pair
def _steps(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("idx")
    rest = list(above["steps"].iloc[0])
    paths = []
    for path in traversal([x.encode() for x in block["digest"]], int(block["height"].iloc[0])):
        own = [{"place": k, "others": b"".join(run[:k] + run[k + 1 :]).decode()} for k, run in path]
        paths.append(own + [{"place": s["place"], "others": s["others"]} for s in rest])
    return pd.DataFrame({"grp": block["grp"], "idx": block["idx"], "digest": block["digest"], "steps": paths, "root": above["root"].iloc[0]})


def paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """grp, idx, digest, steps and root of the nodes of the first round in levels, from those of the last: top (grp, idx, steps, root)."""
    for nodes in reversed(levels[:-1]):
        block = F.floor(F.col("idx") / BLOCK).alias("__block")
        cut = nodes.select("grp", "idx", "digest", height().alias("height")).groupBy("grp", block)
        found = cut.cogroup(top.groupBy("grp", F.col("idx").alias("__block"))).applyInPandas(_steps, f"grp string, idx long, digest string, {STEPS}, root string")
        top = materialise(found, "merkle-paths")
    return top


def fold(node: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def cut_up(others: str) -> list[bytes]:
    return [others[k : k + 64].encode() for k in range(0, len(others), 64)]


@tidy_pair
def _proofs(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("idx")
    shared = [(int(s["place"]), cut_up(s["others"])) for s in above["steps"].iloc[0]]
    tail = b"".join(x for _, others in shared for x in others)
    original, tried = ([x.encode() for x in block[c]] for c in ("digest", "tried"))
    proofs, folded = [], []
    for node, path in zip(tried, traversal(original, int(block["height"].iloc[0])), strict=True):
        own = [(k, run[:k] + run[k + 1 :]) for k, run in path]
        proofs.append(hashlib.sha256(b"".join(x for _, others in own for x in others) + tail).hexdigest())
        folded.append(fold(fold(node, own), shared).decode())
    root = above["root"].iloc[0]
    out = {"key": block["key"], "leaf": block["digest"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded}
    return pd.DataFrame(out).assign(verified=np.array(folded) == root)


def manifest(docs: DataFrame, fields: list[str] | None = None, tampered: Column | None = None, change: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    fields: of a leaf, in order; doc_id and lang are among docs' columns. tampered: where the leaf that is folded has its `change` field in lower case (A-Z).
    """
    fields = fields or FIELDS
    columns = {f: F.col(f) for f in fields}
    forged = leaf([lowered(c) if f == change else c for f, c in columns.items()])
    own = leaf(list(columns.values()))
    # null first, then by bytes
    group = F.coalesce(F.concat(F.lit("."), F.col("lang").cast("string")), F.lit(""))
    tried = own if tampered is None else F.when(tampered, forged).otherwise(own)
    leaves = materialise(docs.select("doc_id", group.alias("grp"), own.alias("digest"), tried.alias("tried")), "merkle-leaves")
    leaves = materialise(numbered(leaves, "grp", ["grp", "doc_id", "digest", "tried"]), "merkle-numbered")
    trees = rounds(leaves)
    subroots = trees[-1].select(F.lit("").alias("all"), "grp", "digest")
    ordered = materialise(numbered(subroots, "all", ["all", "grp"]).select(F.col("all").alias("grp"), "idx", "n", "digest", F.col("grp").alias("of")), "merkle-subroots")
    tops = rounds(ordered)
    nothing = F.array().cast("array<struct<place: int, others: string>>").alias("steps")
    upper = paths(tops, tops[-1].select("grp", "idx", "digest", nothing, F.col("digest").alias("root")))
    # from the place of a subroot to its group
    groups = ordered.select("idx", F.col("of").alias("grp"), F.col("digest").alias("subroot")).join(upper.select("idx", "steps", "root"), "idx")
    whole = paths(trees[1:], groups.select("grp", F.lit(0).cast("long").alias("idx"), F.col("subroot").alias("digest"), "steps", "root")) if len(trees) > 1 else groups.withColumn("idx", F.lit(0).cast("long"))
    above = whole.select("grp", "idx", "steps", "root").join(groups.select("grp", "subroot"), "grp")
    block = F.floor(F.col("idx") / BLOCK).alias("__block")
    # ids go through workers as text, where a null would make floats of numbers
    cut = leaves.select(F.col("doc_id").cast("string").alias("key"), "grp", "idx", "digest", "tried", height().alias("height")).groupBy("grp", block)
    proven = cut.cogroup(above.groupBy("grp", F.col("idx").alias("__block"))).applyInPandas(_proofs, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proven.select(F.col("key").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *proven.columns[1:])
