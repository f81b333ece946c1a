"""The trie of conversations' prefixes: chained digests, nodes by depth and digest, sums over subtrees.

Every prefix of a conversation has a digest that is chained from the one before it and its last turn's, so two prefixes are
one node exactly if depth and digest are equal. Texts are hashed where they are read and never shuffled.

A node belongs to its smallest member. What one conversation owns is a path: if it is the smallest of a node, it is so of all its own
prefixes below. So a subtree's sums are those of the rest of the node's own path, plus whole paths that hang below it. A path is exploded to all nodes
above it, which are prefixes of its own conversation; together never more rows than prefixes, however deep the trie is.

Order and ties: turns ascend, null first; equal turns go by role, the first 32 characters of the text and the digest. Null roles and
texts are empty; repeated rows are turns of their own. Rows without conv_id take no part. No conversations, no nodes (not even a root).
Other columns than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import looked_up, materialise, tidy_batches

ROOT = hashlib.sha256(b"").digest()
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Characters of joined ids in one row, of which a node with many ends has many.
CHUNK = 1 << 16


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (a turn's place from 1), digest of role and text, and n_text, the text's code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.substring(role, 1, 32).alias("__role"), F.substring(text, 1, 32).alias("__text"), own.alias("digest"), F.char_length(text).cast("long").alias("n_text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "__role", "__text", "digest")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("i"), "digest", "n_text")


def rebuilt(turns: DataFrame, lender: Column, borrowed: Column, most: int) -> DataFrame:
    """turns in which each conversation's first ones are those of its lender: as many of both as borrowed (at most `most`) says.

    A row with i = 0 and no digest stands for each conversation itself, so that those left without turns are known.
    """
    known = turns.filter("i = 1").select("conv_id", lender.alias("__lender"), borrowed.alias("__n"))
    lent = turns.filter(F.col("i") <= most).select(F.col("conv_id").alias("__lender"), "i", "digest", "n_text")
    taken = known.join(lent, "__lender").filter("i <= __n").select("conv_id", "i", "digest", "n_text")
    marks = known.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_text"))
    return turns.filter(F.col("i") > borrowed).unionByName(taken).unionByName(marks)


PREFIXES = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("n_text", pa.int64()), ("last", pa.bool_())])


@tidy_batches
def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations, whose turns come in order and after a mark without a digest."""
    held = None  # what may yet be followed by a turn of its conversation
    conv, depth, digest = None, 0, ROOT
    for batch in batches:
        rows = [] if held is None else [held]
        for c, own, n in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("n_text").to_pylist(), strict=True):
            if c != conv:
                conv, depth, digest = c, 0, ROOT
            else:
                depth, digest = depth + 1, hashlib.sha256(digest + own).digest()
            rows.append((c, depth, digest, n))
        if not rows:
            continue
        held = rows[-1]
        last = [a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False)]
        if last:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows[:-1], strict=True)), pa.array(last)], schema=PREFIXES)
    if held is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in held), pa.array([True])], schema=PREFIXES)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest, n_text and last of every prefix, the empty one included. A conversation is walked as a stream of its turns."""
    walked = turns.select("conv_id", "i", "digest", "n_text").repartition("conv_id").sortWithinPartitions("conv_id", "i")
    return walked.mapInArrow(chain, "conv_id long, depth long, digest binary, n_text long, last boolean")


ENDS = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
HASHES = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])


@tidy_batches
def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of nodes, which come in order, joined to chunks."""
    node, ids, size = None, [], 0
    for batch in batches:
        rows = []
        for depth, digest, c in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if (depth, digest) != node or size > CHUNK:
                if ids:
                    rows.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids, size = (depth, digest), [], 0
            ids.append(c)
            size += len(str(c)) + 1
        if rows:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows, strict=True))], schema=ENDS)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, ids[0], ",".join(map(str, ids)))], schema=ENDS)


@tidy_batches
def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash for each node of its chunks, which come in order."""
    node, state = None, None
    for batch in batches:
        rows = []
        for depth, digest, ids in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (depth, digest) == node:
                state.update(b",")
            else:
                if node:
                    rows.append((*node, state.hexdigest()))
                node, state = (depth, digest), hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*rows, strict=True))], schema=HASHES)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], schema=HASHES)


def ends(all_prefixes: DataFrame) -> DataFrame:
    """depth, digest and ends_sha256 of nodes at which conversations end: of their ids, ascending and joined by commas.

    Ranges of (node, id) are joined to chunks first, so the ids of one node are dealt to many tasks; its hash then takes the chunks as a stream.
    """
    key = ["depth", "digest"]
    last = all_prefixes.filter("last").select(*key, "conv_id")
    n = int(last.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    chunks = last.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(joined_ids, "depth long, digest binary, first long, ids string")
    return chunks.repartition(*key).sortWithinPartitions(*key, "first").select(*key, "ids").mapInArrow(hashed, "depth long, digest binary, ends_sha256 string")


def trie(all_prefixes: DataFrame) -> DataFrame:
    """Nodes: conv_id, depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    all_prefixes: of prefixes(), best written as a table, as it is read several times.
    """
    key = ["depth", "digest"]
    found = all_prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.count(F.when(F.col("last"), 1)).alias("__ends"), F.max("n_text").alias("__text"))
    # a childless node's members all end there
    weighed = found.withColumns({"__leaf": (F.col("__ends") == F.col("n_convs")).cast("long"), "__saved": (F.col("n_convs") - 1) * F.col("__text")})
    nodes = materialise(weighed.drop("__ends", "__text"), "trie-nodes")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("__top"), F.sum("__leaf").alias("__leaf"), F.sum("__saved").alias("__saved"))
    above = materialise(all_prefixes.select("conv_id", *key).join(paths, "conv_id").filter("depth < __top"), "trie-above")
    next_up = F.col("depth") + 1 == F.col("__top")
    hung = above.groupBy(*key).agg(F.sum("__leaf").alias("__leaves_hung"), F.sum("__saved").alias("__saved_hung"), F.count(F.when(next_up, 1)).alias("__hung"))
    tops = looked_up(above.filter(next_up).select(*key, F.col("conv_id").alias("__c")), nodes.select(*key, F.col("conv_id").alias("__parent")), key).select(F.col("__c").alias("conv_id"), "__parent")
    out = nodes.join(hung, key, "left").join(ends(all_prefixes), key, "left").join(tops, "conv_id", "left")
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(0).cast("long")
    follows, leads = F.lag("depth").over(up).isNotNull(), F.lead("depth").over(up).isNotNull()
    hanging = lambda c: F.sum(F.coalesce(c, none)).over(so_far)  # noqa: E731  (a hung sum counts for its own node alone)
    out = out.withColumns({"__path_leaves": hanging("__leaf"), "__path_saved": hanging("__saved"), "__more": follows.cast("long"), "__deep": leads})
    return out.select(
        "conv_id",
        *key,
        F.when(F.col("__deep"), F.col("conv_id")).otherwise(F.col("__parent")).alias("parent_conv_id"),
        "n_convs",
        (F.col("__more") + F.coalesce("__hung", none)).alias("n_children"),
        (F.col("__path_leaves") + F.coalesce("__leaves_hung", none)).alias("n_leaves"),
        (F.col("__path_saved") + F.coalesce("__saved_hung", none)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


#: Turns that a conversation takes from its lender, less one, at most.
SHARED = 6
#: Conversations that follow one lender.
BLOCK = 100


def of_blocks(conversations: DataFrame) -> DataFrame:
    """The trie of conversations c that begin like the first of their block, c - c % 100, for crc32(c) % 6 turns."""
    borrowed = F.crc32(F.col("conv_id").cast("string")) % SHARED
    turns = materialise(numbered(conversations), "turns")
    whole = materialise(prefixes(rebuilt(turns, F.col("conv_id") - F.col("conv_id") % BLOCK, borrowed, SHARED - 1)), "prefixes")
    return trie(whole)
