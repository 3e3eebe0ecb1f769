"""Language identification by prediction by partial matching over bytes.

Each language has context trees of up to `order` bytes, counted on a bounded sample of labelled documents and then
frozen. A byte's probability comes from the longest context known: seen successors by count, the others by the escape of
method C (distinct successors over successors and occurrences) times the shorter context's probability among the bytes
not seen here, and at last 1/256 each; with exclusion, so that the 256 probabilities of a context add up to one and code
lengths are exact. Every context of the sample is kept. The language with the shortest code for the whole text wins;
score is its posterior under equal priors.

The sample is dealt by a hash of doc_id: about `sample` documents a language, of those of at most `sample_bytes` each. The
driver holds it, so it holds at most languages * sample * sample_bytes; the model is checked against `MODEL_BYTES` before it
is broadcast. Documents with null language or text are never learned from. A text that is null or has no letter is `und`
with score 0. Very long texts are coded in steps, whole. Ties go to the language that sorts first; with no labelled
document at all everything is `und`; repeated rows are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import as_bytes, unused

LETTER = re.compile(r"[^\W\d_]")
STEP = 1 << 20
SLICE = 1024
MODEL_BYTES = 1 << 28
LANGUAGES = 1000


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class ContextModel:
    """Frozen code lengths in nats. Bytes are classes (0: never seen); rows of `cost` are two-byte contexts, then three-byte ones (`deep`)."""

    languages: list[str]
    classes: np.ndarray
    deep: np.ndarray
    cost: np.ndarray
    sampled: int = 0  # bytes learned from in the language with the fewest

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Total code length of a text under each language. A text is taken to follow three line ends."""
        n = int(self.classes.max()) + 1
        total = np.zeros(len(self.languages))
        for at in range(0, len(text), STEP):
            before = text[max(0, at - 3) : at].rjust(3, b"\n")
            c = self.classes[np.frombuffer(before + text[at : at + STEP], np.uint8)]
            two = c[1:-2] * n
            two += c[2:-1]
            row = self.deep[c[:-3] * (n * n) + two]
            row = np.where(row < 0, two, row)
            row *= n
            row += c[3:]
            total += self.cost[row].sum(0, dtype=np.float64)
        return total


def blend(counts: np.ndarray, lower: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis. weight: how many bytes a class stands for, so that weight times probability adds up to 1."""
    seen = counts > 0
    total, kinds = counts.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    left = (np.where(seen, 0, lower) * weight).sum(-1, keepdims=True)  # what the shorter context gives the bytes not seen here
    spare = np.where(left > 0, kinds, 0)
    own = counts / np.maximum(total + spare, 1)
    escaped = spare / np.maximum(total + spare, 1) / np.where(left > 0, left, 1) * lower
    return np.where(total > 0, np.where(seen, own, escaped), lower)


def fit(texts: dict[str, list[bytes]], order: int = 3) -> ContextModel:
    """Counts the sampled texts and folds the escapes into one table of code lengths. order: context bytes at most, 2 or 3."""
    languages = sorted(texts)
    joined = {k: np.frombuffer(b"".join(b"\n\n\n" + t for t in texts[k]), np.uint8) for k in languages}
    seen = np.unique(np.concatenate([*joined.values(), np.frombuffer(b"\n", np.uint8)]))
    classes = np.zeros(256, np.int32)
    classes[seen] = np.arange(1, len(seen) + 1)
    n = len(seen) + 1
    weight = np.ones(n)
    weight[0] = 256 - len(seen)
    coded = {k: classes[v].astype(np.int64) for k, v in joined.items()}
    context3 = {k: (c[:-3] * n + c[1:-2]) * n + c[2:-1] for k, c in coded.items()}
    keys = np.unique(np.concatenate([np.zeros(0, np.int64), *context3.values()])) if order > 2 else np.zeros(0, np.int64)
    size = 4 * (n * n + len(keys)) * n * len(languages) + 4 * n**3
    if size > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes is too large to broadcast; lower `order` or `sample`")
    deep = np.full(n**3, -1, np.int32)
    deep[keys] = n * n + np.arange(len(keys))
    cost = np.zeros((n * n + len(keys), n, len(languages)), np.float32)
    for i, k in enumerate(languages):
        c = coded[k]
        p = blend(np.bincount(c, minlength=n), np.full(n, 1 / 256), weight)
        p = blend(np.bincount(c[:-1] * n + c[1:], minlength=n * n).reshape(n, n), p[None], weight)
        p2 = blend(np.bincount((c[:-2] * n + c[1:-1]) * n + c[2:], minlength=n**3).reshape(n, n, n), p[None], weight).reshape(n * n, n)
        cost[: n * n, :, i] = -np.log(p2)
        row = deep[context3[k]] - n * n
        for at in range(0, len(keys), 1 << 12):
            own = (row >= at) & (row < at + (1 << 12)) & (row >= 0)
            part = keys[at : at + (1 << 12)]
            counts = np.bincount((row[own] - at) * n + c[3:][own], minlength=len(part) * n).reshape(len(part), n)
            cost[n * n + at : n * n + at + len(part), :, i] = -np.log(blend(counts, p2[part % (n * n)], weight))
    return ContextModel(languages, classes, deep, cost.reshape((n * n + len(keys)) * n, len(languages)), min((len(v) for v in joined.values()), default=0))


def learn(docs: DataFrame, sample: int = 400, sample_bytes: int = 1 << 16, order: int = 3) -> ContextModel:
    """Fits on about `sample` documents of each language among those that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)) & (F.octet_length("text") <= sample_bytes))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return fit({})
    share = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, sample / v)])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    texts: dict[str, list[bytes]] = {}
    for r in usable.where(drawn < share[F.col("lang")]).select("doc_id", "lang", "text").orderBy("doc_id", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return fit(texts, order)


def predict(docs: DataFrame, model: ContextModel, *keep: str) -> DataFrame:
    """The columns of `keep`, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of at most MODEL_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            languages, scores = [], []
            for text in as_bytes(batch.column(batch.num_columns - 1)):
                if not text or not model.languages or not LETTER.search(text.decode()):
                    languages.append("und")
                    scores.append(0.0)
                    continue
                cost = model.code_lengths(text)
                best = int(cost.argmin())
                languages.append(model.languages[best])
                scores.append(float(1 / np.exp(np.minimum(cost[best] - cost, 0)).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(languages), pa.array(scores)], [*keep, "lang_pred", "score"])

    kept = docs.select(*keep).schema
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return docs.select(*keep, F.col("text").cast("string").alias(unused(kept.names))).mapInArrow(run, StructType([*kept.fields, *added]))


def in_some_language(docs: DataFrame, model: ContextModel, start: int = 16, enough: int = 1 << 15) -> DataFrame:
    """The documents with a letter whose shortest code is no longer than the plain one of 8 bits a byte.

    `start` bytes are free, since a text's first bytes tell little. A model without languages, or with fewer than
    `enough` sampled bytes in one of them, can't reject a text: then every document with a letter stays."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def stays(text: bytes | None, model: ContextModel) -> bool:
        if not text or not LETTER.search(text.decode()):
            return False
        return not model.languages or model.sampled < enough or float(model.code_lengths(text).min()) <= float(np.log(256)) * (len(text) + start)

    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                yield part.filter(pa.array([stays(text, shared.value) for text in as_bytes(part.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, sample: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    return predict(docs, learn(docs, sample), "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
