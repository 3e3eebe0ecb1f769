"""Packing of token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised whole (null text: no token but the closing one) and cut into pieces of at most `capacity`
ids. Pieces are dealt into random groups of about `group_pieces`, whose number follows the input, and each group is
packed on its own: pieces by falling length, each into the first sequence that still has room. The tree over
sequences holds the largest free room of every subtree, so a placement takes a walk from root to leaf.

Ids are those of the library with its own settings, its added tokens in a text included. An empty table gives an empty
result; repeated rows are packed as documents of their own (of equal lengths the order among them is free); extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
SPACES = re.compile("[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# A chunk of letters of ASCII and Latin-1 before ASCII marks: either is one part to the tokenizer, whatever its case. Those
# letters stay as they are in every normal form and nobody disputes their small forms; the apostrophe joins what follows.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
REMEMBERED_PARTS = 400_000
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20
TOKENIZERS: dict = {}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def ragged(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values[s : s + n] of all slices, strung together."""
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class PartTokenizer:
    """Ids of whole texts, a slice of a column at a time, remembering the ids of each part.

    The tokenizer splits at white space before anything else, so a text's ids are its chunks' ids in order. It also splits
    between letters and marks, so most chunks are a word and a run of marks, each of which is looked up in small letters.
    Of such parts the last id alone ends a word, so the ids of many parts are told apart without offsets. Texts that hold
    one of the tokenizer's added tokens, which may stand anywhere in a chunk, go to the tokenizer whole; so do those with
    control characters that are white space to the splitting here and not to the tokenizer."""

    def __init__(self, path: str, remember: int = REMEMBERED_PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = (*CONTROLS, *(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        """The places in `ids` of each part; part 0 is the empty one."""
        self.known, self.size = {"": 0}, 0
        self.ids, self.starts, self.lengths = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n = len(self.known), len(self.known) + len(parts)
        while len(self.ids) < self.size + len(ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while len(self.starts) < n:
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        self.ids[self.size : self.size + len(ids)] = ids
        self.starts[at:n], self.lengths[at:n] = self.size + np.cumsum(lengths) - lengths, lengths
        self.size += len(ids)
        self.known.update(zip(parts, range(at, n), strict=True))

    def learn(self, parts: list[str], single: bool) -> None:
        """Learns new parts; single: each is one piece to the tokenizer."""
        if not parts:
            return
        if single:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
        else:
            encoding = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            stops = np.searchsorted(np.array([o[0] for o in encoding.offsets], np.int64), np.cumsum([len(c) + 1 for c in parts]))
        self.add(parts, ids, np.diff(stops, prepend=0))

    def places(self, parts: pa.Array, single: bool) -> np.ndarray:
        """The number of each part, learned where it is new."""
        coded = parts.dictionary_encode()
        own = coded.dictionary.to_pylist()
        self.learn([x for x in own if x not in self.known], single)
        return np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]

    def encode_slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids end); no text is null or special."""
        chunks = pc.utf8_split_whitespace(texts)
        # leading and trailing white space leaves empty chunks, which have no ids
        coded = chunks.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        if len(self.known) > self.remember:
            self.forget()
        words = pc.utf8_rtrim(distinct, characters=MARKS)
        plain = pc.match_substring_regex(words, LETTERS)
        two = np.zeros((len(distinct), 2), np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        whole = distinct.filter(plain)
        words = words.filter(plain)
        cuts = pc.utf8_length(words).to_pylist()
        marks = pa.array([c[n:] for c, n in zip(whole.to_pylist(), cuts, strict=True)], pa.string())
        two[is_plain, 0] = self.places(pc.utf8_lower(words), True)
        two[is_plain, 1] = self.places(marks, True)
        two[~is_plain, 0] = self.places(distinct.filter(pc.invert(plain)), False)
        lengths = self.lengths[two]
        ids = ragged(self.starts[two].ravel(), lengths.ravel(), self.ids)
        lengths = lengths.sum(1)
        starts = np.cumsum(lengths) - lengths
        each = lengths[at]
        ends = np.concatenate(([0], np.cumsum(each)))[chunks.offsets.to_numpy()[1:] - chunks.offsets[0].as_py()]
        return ragged(starts[at], each, ids), ends

    def encode(self, column: pa.StringArray) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of every text, in any order; null texts have no ids."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        sizes = pc.binary_length(column).to_numpy()
        special = np.array([any(t in x for t in self.special) for x in column.cast(pa.large_binary()).to_pylist()], bool)
        for i in np.flatnonzero(special).tolist():
            yield i, np.array(self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4")
        rows = np.flatnonzero(~special)
        for own in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // SLICE_BYTES)) + 1):
            if len(own):
                ids, ends = self.encode_slice(column.take(pa.array(own)).cast(pa.string()))
                for i, a, b in zip(own.tolist(), np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
                    yield i, ids[a:b]


def worker_tokenizer(path: str) -> PartTokenizer:
    """One tokenizer for each Python worker; what it remembers serves the worker's later tasks."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = PartTokenizer(path)
    return TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of every document's ids, each of at most `capacity`; the ids themselves stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = worker_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in (whole.slice(i, SLICE_ROWS) for whole in batches for i in range(0, whole.num_rows, SLICE_ROWS)):
            rows = []
            doc_ids = batch.column("doc_id").to_pylist()
            for i, ids in tokenizer.encode(batch.column("text")):
                ids = ids.tobytes() + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_ids[i], start, len(piece) // 4, zlib.crc32(piece), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in falling order: each one's bin, and the room taken there before it."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            node += room[node] < length
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= length
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(parts: DataFrame, groups: int, capacity: int = 2048, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset. Sequence ids carry the group in their upper bits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["pack_group"].to_numpy() << 32) | bins, offset=offsets).drop(columns="pack_group")

    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.lit(seed)), F.lit(groups)).cast("long"))
    return dealt.groupBy("pack_group").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, group_pieces: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    groups = -(-max(1, docs.count()) // group_pieces)
    return pack(pieces(docs, tokenizer_path, capacity), groups, capacity)
