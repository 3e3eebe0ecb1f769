"""What the quality operator returns, against a plain version of the model's formula."""

import math
import zlib

import numpy as np

from brinelog.llm import quality


def plain_tokens(text):
    """Runs of letters, digits and bytes beyond ASCII; runs of other signs; control bytes and spaces between them."""
    kind = lambda b: 1 if b > 127 or chr(b).isalnum() else 2 if 32 < b < 127 or b == 127 else 0
    found, last = [], 0
    for b in text.lower():
        now = kind(b)
        if now and now == last:
            found[-1].append(b)
        elif now:
            found.append([b])
        last = now
    return [bytes(t) for t in found]


def plain_tails(text, model):
    tokens = plain_tokens(text)
    n, words = max(1, len(tokens)), set(tokens)
    signs = [t for t in tokens if t[0] < 128 and not t[:1].isalnum()]
    most = max((tokens.count(w) for w in words if w not in signs), default=0)
    shares = [len(signs) / n, len(words) / n, most / n, tokens.count(b"|") / n, min(1.0, math.log1p(n) / 10)]
    z = sum(model.weights[b] for b in {zlib.crc32(w) % quality.BUCKETS for w in words}) + sum(a * b for a, b in zip(shares, model.shares, strict=True))
    return [1 / (1 + math.exp(t - z)) for t in model.thresholds]


def test_scores_are_the_plain_formulas(spark):
    rng = np.random.default_rng(21)
    model = quality.OrdinalModel(rng.normal(size=quality.BUCKETS), rng.normal(size=quality.SHARES), np.array([-0.6, 0.8]))
    texts = ["", None, " \n", "Word word WORD, other!! | a|b", "é ñ 你好 ... 12 34", "--- | --- | x", "\x7f\x01q", "the cat " * 40000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = [(i, t, 0.5, True) for i, t in enumerate(texts)] + [(0, "again", 0.1, False), (None, "no id", 0.1, False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, p_good double, selected boolean").repartition(3)
    found = sorted(map(tuple, quality.score(frame, model, 0.4).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        one, two = plain_tails((t or "").encode(), model)
        want.append((i, one + two, one, two, two >= 0.4))
    for a, b in zip(found, sorted(want, key=repr), strict=True):
        assert a[0] == b[0] and a[4] == b[4] and np.allclose(a[1:4], b[1:4], rtol=1e-9, atol=1e-12)


def test_selection_holds_out_of_sample(spark):
    """Junk without toxic words is mostly left out, toxic words nearly always; labels that nothing in the text shows aren't counted."""
    real, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.learn(real, labels.where("doc_id % 4 <> 0"))
    tried = quality.score(real, model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    good, junk = (tried["quality"] == 1) & (tried["toxic"] == 0), (tried["quality"] == 0) & (tried["toxic"] == 0)
    assert tried.loc[good, "selected"].mean() > 0.97
    assert (~tried.loc[junk, "selected"]).mean() > 0.85
    assert tried.loc[good, "expected_grade"].mean() > tried.loc[junk, "expected_grade"].mean() + 0.7
