"""Substring deduplication with prefix-partitioned suffix trees.

Every word of a document starts a suffix, of which the first `window` words count. Suffixes are dealt into groups by
their prefix, and a group's suffix tree is built in memory, top down: nodes are the classes of suffixes that agree on
1, 2, 4, ... words, and only nodes with two leaves or more are carried deeper. Inner nodes at a depth of `window` words
are the repeats; the words their leaves cover are removed.

Which part of the prefix deals a suffix out varies in length. By default it is the least `gram`-word piece inside the
suffix's first `window` words (by a hash): suffixes that agree on `window` words agree on it, and suffixes that follow
each other mostly share it, so they travel as one run of words instead of `window` words each. Pieces that occur once
in the corpus can't lie in a repeat; they are counted first and their suffixes never travel. Where a piece occurs more
than `group_limit` times, its suffixes are dealt by their whole prefix of `window` words instead. Such a group is one
window, whose tree is a count: they are counted by partial sums and joined back to their places, and no task holds a
window's places. Equal runs of a part are folded into one with a list of places before they are shuffled. Texts are never
shuffled: they are written once, bucketed by the part of the scan they came in, and what is found moves to them.

Words are [^\\x20\\x09-\\x0D]+ of the whole text, unchanged; null text has none. Words are compared as bytes, hashes
only deal suffixes out. Rows that repeat are documents of their own (and so repeat all their windows). Empty and
short texts lose nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, numbered, saved

ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
RUN_LIMIT = 512
CHUNK_WORDS = 1 << 20
BLOCK_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
POWERS: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least n of them."""
    have = POWERS.get((base, 0))
    if have is None or len(have) < n:
        have = np.full(1 << max(12, int(n).bit_length()), base, np.uint64)
        have[0] = 1
        have = POWERS[base, 0] = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[s:e] for each slice, by differences of one running polynomial."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(ODD, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True, append=True))
    return raw, edge[::2], edge[1::2]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    done, least = 1, x
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where rows begin and end) of stretches of a text column of about BLOCK_BYTES, rows never cut."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    cuts = np.flatnonzero(np.diff(offsets[:-1] // BLOCK_BYTES)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)], strict=True):
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def words_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a block begin and end, and the first word of each row; a row's end ends a word."""
    inside = ~SPACE[data]
    begins, stops = np.ones(len(data), bool), np.ones(len(data), bool)
    begins[1:], stops[:-1] = ~inside[:-1], ~inside[1:]
    begins[rows[rows < len(data)]] = True
    stops[rows[rows > 0] - 1] = True
    starts = np.flatnonzero(begins & inside)
    return starts, np.flatnonzero(stops & inside) + 1, np.searchsorted(starts, rows)


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return slices_hash(data.astype(np.uint64) + np.uint64(1), starts, ends)


def suffix_runs(data: np.ndarray, rows: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes that share their least piece: (row, piece, first suffix and end as words of the row, uses of the piece)."""
    starts, ends, first_word = words_of(data, rows)
    count = np.maximum(np.diff(first_word) - window + 1, 0)
    if not count.any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    words = words_hash(data, starts, ends)
    at = np.arange(len(words) - gram + 1)
    pieces = slices_hash(words, at, at + gram)
    row = np.repeat(np.arange(len(count)), count)
    suffix = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first_word[row]
    least = sliding_least(pieces, window - gram + 1)[suffix]
    breaks = np.flatnonzero((least[1:] != least[:-1]) | (row[1:] != row[:-1])) + 1
    begin = np.concatenate(([0], breaks))
    first, end = suffix[begin], suffix[np.concatenate((breaks, [len(row)])) - 1] + 1
    uses = 1 + several_inside(pieces, least[begin], first, end, window - gram + 1)
    base = first_word[row[begin]]
    return row[begin], least[begin], first - base, end - base, uses


def several_inside(pieces: np.ndarray, key: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Whether a run holds its piece at two places or more: its first suffix's leftmost and its last one's rightmost differ."""
    span = np.arange(width)
    left = first + (pieces[first[:, None] + span] == key[:, None]).argmax(1)
    right = end + width - 2 - (pieces[end[:, None] - 1 + span] == key[:, None])[:, ::-1].argmax(1)
    return left != right


def piece_uses(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(part, row, piece, first, stop, uses): a document's runs of suffixes and the pieces that deal them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, rows in blocks(batch.column("text")):
                row, piece, first, stop, uses = suffix_runs(data, rows, window, gram)
                if len(row):
                    own = pa.array(row + at)
                    columns = [batch.column("part").take(own), batch.column("row").take(own), pa.array(piece.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (first, stop, uses))]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "row", "piece", "first", "stop", "uses"])

    return docs.select("part", "row", "text").mapInArrow(run, "part long, row int, piece long, first int, stop int, uses int")


RUNS = "deal long, words binary, suffixes int, places array<struct<part:long,row:int,at:int>>"
PLACE = pa.struct([("part", pa.int64()), ("row", pa.int32()), ("at", pa.int32())])


def common_text(docs: DataFrame) -> bytes:
    """The beginnings of 64 texts, of 128 characters each. Runs are packed with them at hand; they decide on sizes, not on results."""
    rows = docs.where("text IS NOT NULL").select(F.substring("text", 1, 128).alias("text")).limit(64).collect()
    return b" ".join(r.text.encode() for r in rows) or b" "


def pack(words: bytes, common: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, -15, 8, zlib.Z_DEFAULT_STRATEGY, common)
    return made.compress(words) + made.flush()


def unpack(packed: bytes, common: bytes) -> bytes:
    return zlib.decompressobj(-15, common).decompress(packed)


def travelling_runs(docs: DataFrame, chosen: DataFrame, window: int, whole: bool, common: bytes | None = None) -> DataFrame:
    """(deal, words, suffixes, places): the chosen runs of suffixes (part, row, piece, first, stop); equal runs of a part are one row.

    whole: each window is a run of its own, dealt by its whole prefix. With a common text the words are packed, and
    the column's metadata holds it."""

    def run(texts: pa.Table, runs: pa.Table) -> pa.Table:
        places = defaultdict(list)
        runs = runs.sort_by("row").combine_chunks()
        row, piece, first, stop = (runs.column(c).to_numpy() for c in ("row", "piece", "first", "stop"))
        needed = texts.filter(pc.is_in(texts.column("row"), pa.array(np.unique(row)))).sort_by("row").combine_chunks() if len(row) else texts.slice(0, 0)
        begin = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1, [len(row)])).tolist()
        at, part = needed.column("row").to_pylist(), int(needed.column("part")[0].as_py()) if len(needed) else 0
        for base, data, rows in blocks(needed.column("text").combine_chunks()) if len(needed) else []:
            starts, ends, first_word = words_of(data, rows)
            text = data.tobytes()
            if whole:
                begins = np.arange(max(0, len(starts) - window + 1))
                prefix = slices_hash(words_hash(data, starts, ends), begins, begins + window).view(np.int64).tolist()
            starts, ends = starts.tolist(), ends.tolist()
            for i, word in enumerate(first_word[:-1].tolist()):
                own = slice(begin[base + i], begin[base + i + 1])
                for k, a, b in zip(piece[own].tolist(), first[own].tolist(), stop[own].tolist(), strict=True):
                    step = 1 if whole else RUN_LIMIT
                    for j in range(a, b, step):
                        e = min(b, j + step)
                        words = b" ".join(text[starts[word + j] : ends[word + e + window - 2]].split())
                        places[prefix[word + j] if whole else k, words, e - j].append((part, at[base + i], j))
        deal, words, n = zip(*places, strict=True) if places else ((), (), ())
        words = words if common is None else [pack(w, common) for w in words]
        sizes = np.fromiter(map(len, places.values()), np.int32, len(places))
        each = np.array([p for own in places.values() for p in own], np.int64).reshape(-1, 3)
        fields = pa.StructArray.from_arrays([pa.array(each[:, c]).cast(kind.type) for c, kind in enumerate(PLACE)], fields=list(PLACE))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), fields)
        return pa.table([pa.array(deal, pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int32()), lists.cast(pa.list_(PLACE))], ["deal", "words", "suffixes", "places"])

    return docs.select("part", "row", "text").groupBy("part").cogroup(chosen.select("part", "row", "piece", "first", "stop").groupBy("part")).applyInArrow(run, RUNS).withMetadata("words", {} if common is None else {"common": common.hex()})


def deep_leaves(words: pa.Array, suffixes: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """For runs of words, each with a number of suffixes and of places: which suffixes are leaves below an inner node
    `window` words deep.

    The trees of all groups at hand are built at once, level by level; a suffix is named by its node, and -1 once its node
    has a single leaf: only nodes with two leaves or more are carried deeper."""
    parts = pc.split_pattern(words, b" ")
    size = parts.value_lengths().to_numpy()
    node = parts.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    begin = np.cumsum(size) - size
    leaf = np.repeat(begin - (np.cumsum(suffixes) - suffixes), suffixes) + np.arange(suffixes.sum())
    weight, depth = np.repeat(places, size).astype(float), 1
    alive = np.arange(len(node))
    while True:
        leaves = np.bincount(node[alive], weight[alive], int(node.max(initial=0)) + 1)
        several = leaves[node[alive]] >= 2
        node[alive[~several]] = -1
        alive = alive[several]
        if depth == window:
            return node[leaf] >= 0
        step = min(depth, window - depth)
        at = leaf if depth + step == window else alive
        at = at[at + step < len(node)]
        at = at[(node[at] >= 0) & (node[at + step] >= 0)]
        below = pd.factorize(node[at] * (int(node.max(initial=0)) + 1) + node[at + step])[0]
        node = np.full(len(node), -1)
        node[at], alive, depth = below, at, depth + step


def repeated_windows(runs: DataFrame, window: int) -> DataFrame:
    """(part, row, first, stop) of the windows under crowded pieces that occur at two places or more."""
    often = runs.groupBy("deal", "words").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("deal", "words")
    each = runs.select("deal", "words", "places").join(saved(often, "windows"), ["deal", "words"], "left_semi").select(F.explode("places").alias("p"))
    return each.select("p.part", "p.row", F.col("p.at").alias("first"), (F.col("p.at") + window).alias("stop"))


def repeats(runs: DataFrame, window: int) -> DataFrame:
    """(part, row, first, stop): stretches of words of a document whose windows also start elsewhere."""
    common = bytes.fromhex(runs.schema["words"].metadata.get("common", "")) or None

    def grown(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        words, suffixes, places = (rows.column(c).combine_chunks() for c in ("words", "suffixes", "places"))
        suffixes, sizes = suffixes.to_numpy().astype(np.int64), places.value_lengths().to_numpy().astype(np.int64)
        if common is not None:
            words = pa.array([unpack(w, common) for w in words.to_pylist()], pa.binary())
        deep = deep_leaves(words, suffixes, sizes, window)
        run_at = np.cumsum(suffixes) - suffixes
        new_run = np.zeros(len(deep) + 1, bool)
        new_run[run_at] = new_run[-1] = True
        begin = np.flatnonzero(deep & (new_run[:-1] | ~np.concatenate(([False], deep[:-1]))))
        stop = np.flatnonzero(deep & (new_run[1:] | ~np.concatenate((deep[1:], [False])))) + 1
        run = np.searchsorted(run_at, begin, "right") - 1
        n = sizes[run]
        place = np.repeat((np.cumsum(sizes) - sizes)[run] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        each = places.flatten()
        part, row, at = (each.field(c).to_numpy()[place] for c in ("part", "row", "at"))
        first, last = (at + np.repeat(x - run_at[run], n) for x in (begin, stop))
        return pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(c.astype(np.int32)) for c in (row, first, last + window - 1))], ["part", "row", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            deal = batch.column("deal").to_numpy()
            held.append(batch)
            size += int(batch.column("suffixes").to_numpy().sum()) + window * batch.num_rows
            last = int(np.searchsorted(deal, deal[-1])) if (deal[1:] >= deal[:-1]).all() else 0
            if size >= CHUNK_WORDS and last:  # only whole groups make a tree
                yield grown([*held[:-1], batch.slice(0, last)])
                held, size = [batch.slice(last)], int(batch.column("suffixes").to_numpy()[last:].sum()) + window * (batch.num_rows - last)
        if held:
            yield grown(held)

    return runs.repartition("deal").sortWithinPartitions("deal").mapInArrow(run, "part long, row int, first int, stop int")


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text, from the stretches (part, row, first, stop) found."""

    def run(texts: pa.Table, stretches: pa.Table) -> pa.Table:
        stretches = stretches.sort_by("row")
        row, first, stop = (stretches.column(c).to_numpy() for c in ("row", "first", "stop"))
        begin, end = (np.searchsorted(row, texts.column("row").to_numpy(), side).tolist() for side in ("left", "right"))
        total, removed, digests, kept = [], [], [], []
        for text, a, b in zip(as_bytes(texts.column("text")), begin, end, strict=True):
            words = (text or b"").split()
            total.append(len(words))
            if a < b:
                edge = np.bincount(first[a:b], minlength=len(words) + 1) - np.bincount(stop[a:b], minlength=len(words) + 1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            removed.append(total[-1] - len(words))
            kept.append(b" ".join(words))
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        return pa.table([texts.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, window: int = 35, gram: int = 8, group_limit: int = 128, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text if asked for): one row per document."""
    rows = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "texts")
    uses = piece_uses(rows, window, gram)  # read twice: found again sooner than kept
    often = saved(uses.groupBy("piece").agg(F.sum("uses").alias("n")).where("n > 1"), "pieces")
    own = saved(uses.drop("uses").join(often, "piece"), "own")
    windows = saved(travelling_runs(rows, own.where(F.col("n") > group_limit), window, True), "crowded")
    common = common_text(rows)
    trees = repeats(travelling_runs(rows, own.where(F.col("n") <= group_limit), window, False, common), window)
    out = cut(rows, trees.union(repeated_windows(windows, window)))
    return out if texts else out.drop("kept")
