"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

The merge rule joins, again and again, the adjacent pair whose union is the piece with the highest score, of equal scores the
leftmost. A sequence of pieces is what the rule ends in if and only if each two neighbours are what it makes of their
own text; so no merging of whole texts is needed. Aho-Corasick gives the longest piece at every place; from the start the longest
is taken, then shorter prefixes of it, whichever ends at a place not known to fail and is compatible with its left
neighbour (checked by merging the two again, remembered). Where none fits, the place is marked as failed in a bitfield and the piece
before it is shortened. The pieces that lead to a place are unique, so a failed place stays failed and the walk is linear.

No piece has a blank after another character, nor (checked when a model is read) letters beside anything but blanks before them, so
texts are cut there without changing anything, and the ids of cuts are remembered by each worker: two generations of
`remembered` cuts of at most 64 characters, whatever the corpus. A character that no
piece has becomes its UTF-8 bytes' ids. Texts are encoded whole where they stand and nothing is shuffled.

Null text is empty: no ids. Repeated rows and ids are encoded each, null doc_ids too; very long texts need a byte a character
besides their ids; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import itertools
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"  # fixed value: stands for a space within pieces
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # fixed values: kinds of pieces in a model file
SURFACE = " ⁇ "  # fixed value: what the unknown piece decodes to unless the model says otherwise
SLICE = 1024
LONGEST_CUT = 64
PAIRS = 1 << 18
NEVER = float("-inf")


@dataclass(frozen=True)
class Model:
    """Pieces by id with their scores and kinds; digest names the file's content."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unknown: str
    prefixed: bool
    digest: str

    def prepared(self, text: str | None) -> str:
        """The text as pieces see it: blanks for spaces, and one more in front where the model says so."""
        return (BLANK if self.prefixed and text else "") + (text or "").replace(" ", BLANK)


def wire(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message; nested messages stay bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0], at + n
        yield key >> 3, value


def read_model(path: str) -> Model:
    """A merge-type model that keeps text as it is but for blanks; anything else is refused, as its ids would be wrong."""
    with open(path, "rb") as f:
        content = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for number, value in wire(content):
        if number == 1:
            piece = dict(wire(value))
            pieces.append((piece[1].decode(), piece.get(2, 0.0), piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(wire(value))
        elif number == 3:
            normalizer = dict(wire(value))
    plain = not normalizer.get(2) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24)
    if trainer.get(3) != 2 or not trainer.get(35) or not plain or {k for *_, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only merge-type models with byte pieces, without changes of the text and without pieces of the user's own")
    if any(BLANK in p.lstrip(BLANK) for p, _, kind in pieces if kind == NORMAL) or max(len(p) for p, *_ in pieces) > 255:
        raise ValueError("a piece has a blank after another character, or over 255 characters")
    names, scores, kinds = zip(*pieces, strict=True)
    return Model(names, scores, kinds, trainer[44].decode() if 44 in trainer else SURFACE, bool(normalizer.get(3, 1)), hashlib.sha256(content).hexdigest())


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """What the merge rule makes of a short list of symbols."""
    pairs = [score.get(a + b, NEVER) for a, b in itertools.pairwise(symbols)]
    while pairs and (best := max(pairs)) > NEVER:
        at = pairs.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = score.get(symbols[at] + symbols[at + 1], NEVER)
        if at:
            pairs[at - 1] = score.get(symbols[at - 1] + symbols[at], NEVER)
    return symbols


class Encoder:
    """Backtracking encoder of one model."""

    def __init__(self, model: Model) -> None:
        self.score = {p: s for p, s, kind in zip(model.pieces, model.scores, model.kinds, strict=True) if kind == NORMAL}
        of_byte = {int(p[3:5], 16): i for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == BYTE}
        self.spelt = lambda char: [of_byte[b] for b in char.encode()]
        ids = {p: [i] for i, (p, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind == NORMAL}
        for char in {c for p in self.score for c in p} - self.score.keys():
            ids[char] = self.spelt(char)  # merges like others, but has no id when it stays alone
        self.ids = {p: own for p, own in ids.items() if merged(list(p), self.score) == [p]}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.checked: dict[tuple[str, str], bool] = {}

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.checked.get(key)
        if found is None:
            if len(self.checked) >= PAIRS:
                self.checked.clear()
            found = self.checked[key] = merged([*left, *right], self.score) == [left, right]
        return found

    def known_run(self, text: str, longest: bytearray, start: int, end: int) -> list[str]:
        """The pieces of text[start:end], all of whose characters are known."""
        if start + longest[start] == end:
            return [text[start:end]]
        failed = bytearray((end - start >> 3) + 1)
        ids, compatible, found, last = self.ids, self.compatible, [], None
        at, length = start, longest[start]
        while True:
            while length:
                to = at + length - start
                if not failed[to >> 3] >> (to & 7) & 1:
                    piece = text[at : at + length]
                    if piece in ids and (last is None or compatible(last, piece)):
                        break
                length -= 1
            if not length:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                length = len(found.pop())
                last = found[-1] if found else None
                at -= length
                continue
            found.append(piece)
            last = piece
            at += length
            if at == end:
                return found
            length = longest[at]

    def __call__(self, text: str) -> list[int]:
        """The ids of a text in which blanks stand for spaces."""
        longest = bytearray(len(text))
        for end, length in self.automaton.iter(text):
            longest[end - length + 1] = length  # at each start the last to end is the longest
        ids, at, n = [], 0, len(text)
        while at < n:
            if not longest[at]:
                ids += self.spelt(text[at])
                at += 1
                continue
            stop = longest.find(0, at)
            stop = n if stop < 0 else stop
            for piece in self.known_run(text, longest, at, stop):
                ids += self.ids[piece]
            at = stop
        return ids


class Remembered(dict):
    """Cuts and their ids as little-endian 32-bit integers; of the last generation what is asked for again is kept."""

    def __init__(self, encoder: Callable[[str], list[int]], cuts: Callable[[str], list[str]], limit: int) -> None:
        self.encoder, self.cuts, self.limit, self.before = encoder, cuts, limit, {}

    def __missing__(self, cut: str) -> bytes:
        found = self.before.get(cut)
        if found is None:
            found = np.array(self.encoder(cut), "<i4").tobytes()
        if len(cut) <= LONGEST_CUT:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[cut] = found
        return found


COARSE = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def cuts_of(pieces: Iterable[str]) -> re.Pattern:
    """Where a text may be cut: before and after letters too, where no piece joins letters with anything but blanks before them."""
    others = "".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()}))
    letter = rf"[^\W\d_{re.escape(others)}]"
    fine = re.compile(f"{BLANK}*{letter}+|{BLANK}*(?:(?!{letter})[^{BLANK}])+|{BLANK}+")
    return fine if all(map(fine.fullmatch, pieces)) else COARSE


WORKERS: dict[tuple, Remembered] = {}


def remembered_of(model: Model, limit: int) -> Remembered:
    """One for each worker and model."""
    key = (model.digest, limit)
    if key not in WORKERS:
        WORKERS.clear()
        encoder = Encoder(model)
        WORKERS[key] = Remembered(encoder, cuts_of(encoder.score).findall, limit)
    return WORKERS[key]


def encode(docs: DataFrame, model: Model, remembered: int = 1 << 18) -> DataFrame:
    """doc_id, token_ids: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered_of(model, remembered)
        ids_of, cuts = known.__getitem__, known.cuts
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                found = [b"".join(map(ids_of, cuts(model.prepared(t)))) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "token_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, token_ids array<int>")


codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))


def surfaces(model: Model) -> list[bytes]:
    """What each id decodes to; bytes of byte pieces may form characters with their neighbours."""
    told = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), CONTROL: lambda p: b"", UNKNOWN: lambda p: model.unknown.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
    return [told[kind](p) for p, kind in zip(model.pieces, model.kinds, strict=True)]


def text_of(ids: list[int], model: Model, surface: list[bytes]) -> str:
    """The text of ids; a blank that the encoder put in front goes."""
    first = next((i for i in ids if model.kinds[i] != CONTROL), None)
    added = model.prefixed and first is not None and model.pieces[first].startswith(BLANK)
    runs = [b"".join(map(surface.__getitem__, run)) for _, run in itertools.groupby(ids, lambda i: model.kinds[i] == CONTROL)] if any(not surface[i] for i in set(ids)) else [b"".join(map(surface.__getitem__, ids))]
    return "".join(run.decode("utf-8", "one_by_one") for run in runs)[added:]


def decode(coded: DataFrame, model: Model) -> DataFrame:
    """doc_id, token_ids, decoded, from doc_id and token_ids: bytes that form no character become U+FFFD each. Null ids are left
    out, null lists decode to an empty text; an id that the model doesn't have ends the job with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = surfaces(model)
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                ids = part.column("token_ids")
                texts = [text_of(x.tolist(), model, surface) for x in lists(ids)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "token_ids", "decoded"])

    whole = F.coalesce(F.filter("token_ids", lambda i: i.isNotNull()), F.array().cast("array<int>"))
    bad = F.exists("token_ids", lambda i: (i < 0) | (i >= len(model.pieces)))
    checked = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("an id that the model doesn't have")).cast("array<int>")).otherwise(whole)
    return coded.select("doc_id", checked.alias("token_ids")).mapInArrow(run, "doc_id long, token_ids array<int>, decoded string")


def lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def encode_decode(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids in decimal, joined by commas), decoded_sha256."""
    both = decode(encode(docs, model), model)
    digest = lambda c: F.sha2(c, 256)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest(F.array_join("token_ids", ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
