"""The prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns, named by SHA-256 digests chained over the turns (in chunks of `CHUNK` turns, chained
again over the chunks, so that no task sees a whole conversation). Totals come from rounds of joins that rake and compress in
turn: raking takes all leaves away and adds what they hold to their parents; compressing takes every chain of nodes with one
child away at once, found by doubling pointers along the chains, and hangs the chain's bottom on the parent of its top, with
what the chain held on the new edge. Every round at least halves what is left, whatever the depth. Then the chains are expanded
again, the last first: a node's total is what it was contracted with plus its bottom's total.

Turns go by `turn` (null first), ties by role and text; null role or text is empty; repeated rows are turns of their own. Rows
with a null conv_id take no part. Ordinals come from a sort by range with counts of earlier ranges, so a conversation with a third of
all rows is dealt over many tasks. An empty table has no nodes, not even a root. Very long texts are digested where they are
read and don't move after the sort. Extra columns are ignored, whatever their names.

The digest of a node's members is sequential by its definition: its numbers are strung together by many tasks, and one streams the
strings of a node through the hash without holding them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

CHUNK = 64
ROOT = b""
EMPTY = hashlib.sha256(b"").hexdigest()


def chained(a: Column, b: Column) -> Column:
    return F.unhex(F.sha2(F.concat(a, b), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, ordinal (from 0), n (the conversation's turns), digest, bytes of every turn; digest tells role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "at", "role", "text", "tie")]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    place = F.monotonically_increasing_id()
    dealt = rows.where("conv IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = saved(dealt.select("conv", F.shiftright(place, 33).alias("part"), place.alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "turns")
    own = dealt.groupBy("part", "conv").agg(F.min("place").alias("first"), F.count("*").alias("here"))
    whole = Window.partitionBy("conv")
    before = F.sum("here").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = saved(own.select("part", "conv", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")), "starts")
    return dealt.join(starts, ["part", "conv"]).select("conv", (F.col("place") + F.col("shift")).alias("ordinal"), "n", "digest", "bytes")


def spliced(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation's first h turns gave way to those of the first of its family, h being its number's
    checksum modulo `most`: conv, pos, digest, bytes, last; conv, length."""
    turns = saved(turns, "ordered")
    own = turns.groupBy("conv").agg(F.first("n").alias("n"))
    h = F.crc32(F.col("conv").cast("string")) % most
    base = F.col("conv") - F.pmod("conv", F.lit(family))
    lengths = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = own.select("conv", "n", base.alias("base"), h.alias("h")).join(lengths, "base", "left")
    given = F.least("h", F.coalesce("base_n", F.lit(0)))
    length = given + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = saved(convs.select("conv", "base", "h", given.alias("given"), length.alias("length")), "convs")
    kept = turns.where(F.col("ordinal") >= h).join(convs, "conv").select("conv", (F.col("given") + F.col("ordinal") - F.col("h")).alias("pos"), "length", "digest", "bytes")
    heads = turns.where((F.pmod("conv", F.lit(family)) == 0) & (F.col("ordinal") < most)).select(F.col("conv").alias("base"), F.col("ordinal").alias("pos"), "digest", "bytes")
    taken = convs.join(heads, "base").where("pos < h").select("conv", "pos", "length", "digest", "bytes")
    last = (F.col("pos") + 1 == F.col("length")).alias("last")
    return saved(kept.unionByName(taken).select("conv", "pos", last, "digest", "bytes"), "spliced"), convs.select("conv", "length")


def named(turns: DataFrame) -> DataFrame:
    """conv, pos, name and parent of each turn's prefix, from conv, pos (gapless from 0) and digest."""
    step = lambda names, turn: F.concat(names, F.array(chained(F.element_at(names, -1), turn["digest"])))
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    rows = turns.groupBy("conv", chunk).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("turns"))
    rows = saved(rows.select("conv", "chunk", F.aggregate("turns", F.array(F.lit(ROOT)), step).alias("names")), "chunks")
    place = F.col("chunk") * CHUNK + F.col("i")
    each = rows.select("conv", "chunk", "names", F.explode(F.sequence(F.lit(0), F.size("names") - 2)).alias("i"))
    each = each.select("conv", "chunk", place.alias("pos"), F.col("names")[F.col("i") + 1].alias("name"), F.col("names")[F.col("i")].alias("parent"))
    full = rows.where(F.size("names") == CHUNK + 1)
    if full.isEmpty():
        return each.drop("chunk")
    full = saved(full.select("conv", F.col("chunk").alias("pos"), F.element_at("names", -1).alias("digest")), "full")
    above = named(full).join(full, ["conv", "pos"])
    end = F.when(F.col("parent") == F.lit(ROOT), F.col("digest")).otherwise(chained(F.col("parent"), F.col("digest")))
    above = above.select("conv", (F.col("pos") + 1).alias("chunk"), F.col("name").alias("above"), end.alias("end"))
    under = lambda c: F.when(F.col("above").isNull(), F.col(c)).otherwise(chained(F.col("above"), F.col(c)))
    parent = F.when(F.col("parent") == F.lit(ROOT), F.coalesce("end", "parent")).otherwise(under("parent"))
    return each.join(above, ["conv", "chunk"], "left").select("conv", "pos", under("name").alias("name"), parent.alias("parent"))


def digests_of_members(ends: DataFrame) -> DataFrame:
    """name, ends_sha256 from (name, conv): members in numeric order, joined by commas."""

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, convs = batch.column("name").to_pylist(), batch.column("conv").to_pylist()
            runs: list[tuple] = []
            for name, conv in zip(names, convs, strict=True):
                if not runs or runs[-1][0] != name:
                    runs.append((name, conv, []))
                runs[-1][2].append(str(conv))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.int64()), pa.array([",".join(r[2]) for r in runs], pa.string())], ["name", "least", "members"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, hashlib.sha256(), []
        for batch in batches:
            for name, members in zip(batch.column("name").to_pylist(), batch.column("members").to_pylist(), strict=True):
                if name == current:
                    state.update(b",")
                else:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = name, hashlib.sha256()
                state.update(members.encode())
            yield told(done)
            done = []
        if current is not None:
            yield told([(current, state.hexdigest())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["name", "ends_sha256"])

    strings = ends.repartitionByRange("name", "conv").sortWithinPartitions("name", "conv").mapInArrow(strung, "name binary, least long, members string")
    strings = saved(strings, "members")
    return strings.repartition("name").sortWithinPartitions("name", "least").mapInArrow(hashed, "name binary, ends_sha256 string")


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """id and, for each value, its sum over the node's subtree, from (id, parent, values); a top's parent is null. Values are longs.

    `e_` columns: what a node brings its parent beside its own total, from chains that hung between them."""
    held = lambda c: F.col(c) + F.col(f"e_{c}")
    active = saved(nodes.select("id", "parent", *values, *[F.lit(0).cast("long").alias(f"e_{c}") for c in values]), "active")
    finished, chains = [], []
    while not active.isEmpty():
        parents = saved(active.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids")), "parents")
        leaves = saved(active.join(parents, "id", "left_anti"), "leaves")
        finished.append(leaves.select("id", *values))
        brought = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("raked"), *[F.sum(held(c)).alias(f"b_{c}") for c in values])
        left = active.join(parents, "id").join(brought, "id", "left")
        grown = [(F.col(c) + F.coalesce(f"b_{c}", F.lit(0))).alias(c) for c in values]
        left = saved(left.select("id", "parent", *grown, *[f"e_{c}" for c in values], (F.col("kids") - F.coalesce("raked", F.lit(0))).alias("kids")), "raked")
        unary = left.where("kids = 1 AND parent IS NOT NULL")
        if unary.isEmpty():
            active = left.drop("kids")
            continue
        child = left.select(F.col("parent").alias("id"), F.col("id").alias("to"), *[F.col(f"e_{c}").alias(f"c_{c}") for c in values])
        open_ = unary.select(F.col("id").alias("to"), F.lit(True).alias("open"))
        chain = unary.join(child, "id").join(open_, "to", "left").select("id", "to", F.coalesce("open", F.lit(False)).alias("open"), *[(F.col(c) + F.col(f"c_{c}")).alias(c) for c in values])
        chain = saved(chain, "chain")
        while not chain.where("open").isEmpty():
            further = chain.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("open").alias("still"), *[F.col(c).alias(f"f_{c}") for c in values])
            jumped = chain.where("open").join(further, "to").select("id", F.col("further").alias("to"), F.col("still").alias("open"), *[(F.col(c) + F.col(f"f_{c}")).alias(c) for c in values])
            chain = saved(chain.where("NOT open").unionByName(jumped), "chain")
        chains.append(chain.select("id", "to", *values))
        tops = unary.join(open_.select(F.col("to").alias("parent")), "parent", "left_anti")
        hung = tops.select("id", "parent", *[f"e_{c}" for c in values]).join(chain.select("id", "to", *values), "id")
        hung = hung.select(F.col("to").alias("id"), F.col("parent").alias("new_parent"), *[held(c).alias(f"n_{c}") for c in values])
        rest = left.where("NOT (kids = 1 AND parent IS NOT NULL)").join(hung, "id", "left")
        active = saved(rest.select("id", F.coalesce("new_parent", "parent").alias("parent"), *values, *[F.coalesce(f"n_{c}", f"e_{c}").alias(f"e_{c}") for c in values]), "active")
    if not finished:
        return nodes.select("id", *values)
    totals = finished[0]
    for more in finished[1:]:
        totals = totals.unionByName(more)
    for chain in reversed(chains):
        bottoms = totals.select(F.col("id").alias("to"), *[F.col(c).alias(f"t_{c}") for c in values])
        expanded = saved(chain.join(bottoms, "to").select("id", *[(F.col(c) + F.col(f"t_{c}")).alias(c) for c in values]), "expanded")
        totals = totals.unionByName(expanded)
    return totals


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The contract's columns, one row a node, from turns (conv, pos, last, digest, bytes) and all conversations (conv, length)."""
    paths = saved(named(turns).join(turns.select("conv", "pos", "last", "bytes"), ["conv", "pos"]), "paths")
    members = paths.groupBy("name").agg(F.min("conv").alias("conv_id"), (F.first("pos") + 1).alias("depth"), F.first("parent").alias("parent"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = top.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = saved(members.unionByName(top), "nodes")
    children = saved(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children")), "children")
    ends = paths.where("last").select("name", "conv").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("name"), "conv"))
    ends = saved(digests_of_members(saved(ends, "ends")), "digests")
    nodes = saved(nodes.join(children, "name", "left").join(ends, "name", "left").fillna(0, ["n_children"]).fillna(EMPTY, ["ends_sha256"]), "counted")
    own = nodes.select(F.col("name").alias("id"), "parent", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = saved(subtree_totals(own, ["n_leaves", "saved_tokens"]).withColumnRenamed("id", "name"), "totals")
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(totals, "name").join(parents, "parent", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
