"""The fold of ranked merges against the library, piece by piece."""

import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from brinelog.llm import byte_bpe


def test_rounds_of_the_fold_give_the_librarys_ids(spark):
    random.seed(17)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    some = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    pieces = ["a", "é", "\t\n", " " * 90, "x" * 512, "ab" * 100, "日本語" * 40] + [some("abcdeé ñ1-日", random.randrange(1, 70)) for _ in range(200)] + [" " + some("etaoinshr", random.randrange(2, 16)) for _ in range(300)]
    ids = byte_bpe.fold_merges(F.col("word"), byte_bpe.rank_map(ranks))
    frame = spark.createDataFrame([(p,) for p in pieces], "word string").repartition(4)
    assert [r for r in frame.select("word", ids.alias("ids")).collect() if r.ids != library.encode_ordinary(r.word)] == []
    # a round changes the neighbours of the merged pair where they stand; it cuts no array into slices and puts them together again
    assert "slice(" not in str(byte_bpe.fold_merges(F.col("word"), F.col("maps")))


def test_the_rank_map_is_by_pairs_of_ids(spark):
    # "ab" + "cd" never meet in "abcd", whose bytes go by "bc" first: the merges alone don't make it, yet as a whole it is one id
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 256, b"ab": 257, b"cd": 258, b"abcd": 259, b"\0\0": 260, b"xyz": 261, b"yz": 262}
    library = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    pieces = ["abcd", "abcda", "xabcd", "ab", "bcd", "abab", "\0\0\0", "\0", "xyz", "xyzx", "axyz", "yz", "aé\0\0"]
    frame = spark.createDataFrame([(p,) for p in pieces], "word string")
    ids = byte_bpe.fold_merges(F.col("word"), byte_bpe.rank_map(ranks))
    assert [(r.word, r.ids) for r in frame.select("word", ids.alias("ids")).collect()] == [(p, library.encode_ordinary(p)) for p in pieces]
    # a rank is found by two ids, without cutting the part's bytes out of the word
    assert "substring(" not in str(byte_bpe.fold_merges(F.col("word"), F.col("maps")))


def test_only_pairs_that_can_meet_are_in_the_map():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    pairs = [(ranks[b"a"] << 18 | ranks[b"b"]) << 18 | ranks[b"ab"], ranks[b"!!"], (ranks[b"t"] << 18 | ranks[b"h"]) << 18 | ranks[b"th"]]
    one, two = byte_bpe.pair_tables(pairs)
    assert sorted(x for x in one + two if x != byte_bpe.NEVER) == sorted(pairs)
    assert byte_bpe.merge_long(b" the", ranks, ranks[b" the"]) == [ranks[b" t"], ranks[b"he"]]
