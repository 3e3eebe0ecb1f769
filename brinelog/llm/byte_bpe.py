"""Byte-level BPE encoding and decoding by Spark higher-order functions.

A text is cut into pieces by the tokenizer's pattern. A piece's bytes are folded by `aggregate`: each round merges the
adjacent pair with the lowest rank, found in a literal rank map: numbers of two ids and the rank of both together, dealt by
remainders into two arrays, because Spark looks its maps up from end to end. The distinct words of the corpus are counted, the
most frequent `remembered` of them are folded once and broadcast, and all other pieces are folded where they stand. A
remembered word has at most 64 bytes and so 64 ids: 2**18 of them take at most 100 MB, whatever the corpus. Text is never
shuffled. Ids are then strung together per document in the order of its pieces, and decoding concatenates the
vocabulary's binary pieces; both are done on Arrow batches, because putting a document's pieces together again on the
JVM would shuffle every id.

Null text is empty: no ids. Pieces of over `longest` bytes would cost the fold the square of their length and are
merged by the same ranks with a heap in Python. Repeated rows are encoded each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# fixed value: the tokenizers' pattern, with Unicode white space spelt out as Java's \s is ASCII only
SPACES = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
PLACES, RANKS = 9, 18  # bits of a place in a piece and of a rank: one place and three ranks share a long
NEVER = (1 << RANKS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_tables(pairs: list[int]) -> list[list[int]]:
    """Two tables, as long as two primes, with each number (left, right, rank) at its pair's remainder in one of them; NEVER in empty slots."""
    prime = lambda n: next(k for k in range(n, 2 * n + 3) if all(k % i for i in range(2, math.isqrt(k) + 1)))
    n = len(pairs) + 2
    while True:
        sizes = [prime(n), prime(prime(n) + 1)]
        tables = [[NEVER] * k for k in sizes]
        for number in pairs:
            side = 0
            for _ in range(500):
                at = (number >> RANKS << RANKS) % sizes[side]
                number, tables[side][at] = tables[side][at], number
                if number == NEVER:
                    break
                side = 1 - side
            else:
                break
        else:
            return tables
        n += n // 4


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: for two ids that can meet side by side the rank of their bytes together, in two tables; the ids of
    single bytes; and by themselves (`whole`) the pieces that the merges alone would not make.

    Merges within a stretch of a word are those of the stretch alone, up to where it is one part. So where lower ranks alone
    make two parts of a piece, no other two can meet to make it; else all its cuts in two count."""
    met, whole = [], {}
    for piece, rank in ranks.items():
        if len(piece) == 1:
            continue
        halves = merge_long(piece, ranks, rank)
        if len(halves) == 2:
            met.append((*halves, rank))
            continue
        met += [(ranks[piece[:i]], ranks[piece[i:]], rank) for i in range(1, len(piece)) if piece[:i] in ranks and piece[i:] in ranks]
        with contextlib.suppress(UnicodeDecodeError):  # no word has such bytes
            whole[piece.decode()] = rank
    one, two = pair_tables([(a << RANKS | b) << RANKS | rank for a, b, rank in met])
    literal = {"one": one, "two": two, "bytes": [ranks[bytes([i])] for i in range(256)], "whole": whole}
    return F.from_json(F.lit(json.dumps(literal, separators=(",", ":"))), "one array<bigint>, two array<bigint>, bytes array<bigint>, whole map<string,bigint>")


def bound(use, *values: Column) -> Column:
    """use(*values), each evaluated once: as the end of a fold over nothing, since a look into a transformed array works out
    its type again for each row."""
    if not values:
        return use()
    return F.aggregate(F.array().cast("array<int>"), values[0], lambda x, _: x, lambda x: bound(lambda *others: use(x, *others), *values[1:]))


def fold_merges(word: Column, maps: Column) -> Column:
    """The ids of a word's bytes. The literal tables are bound once, or every mention of them would travel with each task."""
    whole = maps["whole"][word]
    merged = bound(lambda *tables: fold_with(word, *tables), maps["one"], maps["two"], F.size(maps["one"]).cast("long"), F.size(maps["two"]).cast("long"), maps["bytes"])
    return F.when(whole.isNotNull(), F.array(whole.cast("int"))).otherwise(merged)


def fold_with(word: Column, one: Column, two: Column, ones: Column, twos: Column, bytes_ids: Column) -> Column:
    """State of the fold: the pairs of neighbouring parts in their order, each one number of its rank, place, left and right id.

    The least number is the lowest rank's leftmost pair. Merging takes it out and changes only the pairs beside it: the right id
    of the one before and the left id of the one behind are now the pair's rank. The last part is paired with NEVER."""
    both, place = 2 * RANKS, (1 << PLACES) - 1
    never = F.lit(NEVER).cast("long")

    def left(number: Column) -> Column:
        return F.shiftright(number, RANKS).bitwiseAND(never)

    def pair(left: Column, right: Column) -> Column:
        return F.shiftleft(left, both).bitwiseOR(F.shiftleft(right, RANKS))

    def ranked(ids: Column, at: Column) -> Column:
        # of two numbers with the same ids only the rank is left; with others, or an empty slot, NEVER or more
        found = F.least(*(F.get(t, (ids % n).cast("int")).bitwiseXOR(ids) for t, n in ((one, ones), (two, twos))), never)
        return F.shiftleft(found, both + PLACES).bitwiseOR(at).bitwiseOR(F.shiftright(ids, RANKS))

    def merge(pairs: Column, _: Column) -> Column:
        def merged(lowest: Column) -> Column:
            def around(made: Column, before: Column, behind: Column) -> Column:
                def beside(x: Column, i: Column) -> Column:
                    again = lambda ids: bound(lambda ids: ranked(ids, x.bitwiseAND(F.lit(place << both))), ids)
                    return F.when(i == behind, again(pair(made, x.bitwiseAND(never)))).when(i == before, again(pair(left(x), made))).otherwise(x)

                return F.transform(F.array_remove(pairs, lowest), beside)

            at = F.array_position(pairs, lowest).cast("int")
            return F.when(lowest >= F.lit(NEVER << both + PLACES), pairs).otherwise(bound(around, F.shiftright(lowest, both + PLACES), at - 2, at - 1))

        return bound(merged, F.array_min(pairs))

    def folded(parts: Column) -> Column:
        ids = F.transform(parts, lambda x, i: pair(x, F.coalesce(F.get(parts, i + 1), never)))
        return F.aggregate(parts, F.transform(ids, lambda x, i: ranked(x, F.shiftleft(i.cast("long"), both))), merge, lambda pairs: F.transform(pairs, lambda x: left(x).cast("int")))

    letters = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return bound(folded, F.transform(letters, lambda x: F.get(bytes_ids, F.ascii(x))))


def merge_long(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[int]:
    """The same merges for a long piece: a heap of pairs over a linked list of parts; of ranks `below` a given one."""
    n = len(piece)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2], NEVER)) < below]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], right[i], alive[j] = stop, right[j], False
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]], NEVER)) < below:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop], NEVER)) < below:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def split_pieces(docs: DataFrame) -> DataFrame:
    """(row, doc_id, word): the pieces of each document in order, a null word where it has none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("words"))
    return rows.select("row", "doc_id", F.explode_outer("words").alias("word"))


def frequent_words(docs: DataFrame, maps: Column, remembered: int) -> DataFrame:
    """(word, ids) of the `remembered` most frequent words; of those that tie at the cut a share, by hash, so that the table
    is neither empty nor (but for chance, under a hundredth) larger."""
    words = split_pieces(docs).where("octet_length(word) <= 64").groupBy("word").agg(F.count("*").alias("n"))
    words = saved(words, "words")
    cut, share, total = 0, 0.0, 0
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():  # `remembered` rows at most
        if total + r["words"] > remembered:
            cut, share = r["n"], (remembered - total) / r["words"]
            break
        total += r["words"]
    drawn = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30)
    chosen = words.where((F.col("n") > cut) | ((F.col("n") == cut) & (drawn < share)))
    return saved(chosen.repartition("word").select("word", fold_merges(F.col("word"), maps).alias("ids")), "frequent")


def encode(docs: DataFrame, ranks: dict[bytes, int], remembered: int, longest: int) -> DataFrame:
    """(row, doc_id, whole, token_ids): the ids of each piece, in order; for pieces over `longest` bytes the piece itself."""
    maps = rank_map(ranks)
    known = frequent_words(docs, maps, remembered)
    pieces = split_pieces(docs)
    joined = pieces.join(F.broadcast(known), "word", "left")
    long = F.octet_length("word") > longest
    ids = F.when(long, F.array().cast("array<int>")).otherwise(F.coalesce("ids", fold_merges(F.col("word"), maps)))
    # other names than the join's: within nested lambdas a name would be taken for an alias of the same select
    return joined.select("row", "doc_id", F.when(long, F.col("word")).alias("whole"), ids.alias("token_ids"))


def encode_decode(docs: DataFrame, ranks_path: str, remembered: int = 1 << 18, longest: int = 512) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per document."""
    ranks = read_ranks(ranks_path)
    if max(ranks.values()) >= NEVER or longest > 1 << PLACES:
        raise ValueError(f"ranks must stay below {NEVER} and folded pieces within {1 << PLACES} bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = {rank: piece for piece, rank in ranks.items()}
        row, doc_id, parts = None, None, []

        def told(document: tuple) -> tuple:
            doc_id, ids = document
            ids = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
            decoded = b"".join(map(vocabulary.__getitem__, ids.tolist()))
            return doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()

        def out(done: list[tuple]) -> pa.RecordBatch:
            a, b, c, d = zip(*map(told, done), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c), pa.array(d)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids, words = batch.column("row").to_numpy(), batch.column("token_ids"), batch.column("whole")
            offsets = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False)
            given = np.flatnonzero(words.is_valid().to_numpy(zero_copy_only=False)) if words.null_count < len(words) else np.zeros(0, np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]))
            done = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if rows[a] != row:
                    if row is not None:
                        done.append((doc_id, parts))
                    row, doc_id, parts = int(rows[a]), batch.column("doc_id")[a].as_py(), []
                for i in given[(given >= a) & (given < b)].tolist():
                    parts.append(values[offsets[a] : offsets[i]].copy())
                    parts.append(np.array(merge_long(words[i].as_py().encode(), ranks), np.int32))
                    a = i + 1
                parts.append(values[offsets[a] : offsets[b]].copy())
            if done:
                yield out(done)
        if row is not None:
            yield out([(doc_id, parts)])

    return encode(docs, ranks, remembered, longest).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
