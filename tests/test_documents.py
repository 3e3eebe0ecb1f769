"""Canonical JSON of documents of any shape against plain Python."""

import json
import random

from brinelog.operators import documents


def plain(v):
    if isinstance(v, (bool, str)) or v is None:
        return v
    if isinstance(v, (int, float)):
        return f"{v:.12g}"
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v]


def text_of(v):
    return json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def made(depth):
    kind = random.randrange(9 if depth else 6)
    if kind == 0:
        return random.choice([None, True, False])
    if kind == 1:
        return "".join(random.choice('ab"\\\n\x0b\x1f é你/\t') for _ in range(random.randrange(6)))
    if kind == 2:
        return random.randrange(-(10**14), 10**14)
    if kind < 6:
        return random.choice([random.random(), random.uniform(-1, 1) * 10.0 ** random.randrange(-20, 25), round(random.uniform(-9, 9), 3), 1.5e300, 5e-324, 0.0001, 0.00001234, 999999999999.5, 123456789012.5, 0.1234567891235])
    if kind == 6:
        return [made(depth - 1) for _ in range(random.randrange(4))]
    return {"".join(random.choice('aZé" \n.') for _ in range(random.randrange(4))): made(depth - 1) for _ in range(random.randrange(5))}


def test_documents_of_any_shape(spark):
    random.seed(11)
    values = [made(5) for _ in range(200)] + [[], {}, [[]], {"": {}}, "x" * 50000, [[[[[[[1]]]]]]]]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0) for i, v in enumerate(values)] + [None, "", "{", "nope", '{"a":1,"a":2}', "1 2", '{"a":1} x', "1],[2", "1,0],[2"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id int, t string, v string, at int").repartition(3)
    found = {r.id: r for r in documents.canonical(frame, "t", "told").collect()}
    assert len(found) == len(texts) and found[0].v == "x"
    for i, v in enumerate(values):
        assert found[i].told == text_of(v)
    assert all(found[i].told is None for i in range(len(values), len(texts)))
    assert documents.canonical(frame.limit(0), "t").count() == 0


def test_flattened(spark):
    frame = spark.createDataFrame([("a", '{"x":[1,{"y":null,"z":[]}],"w":"q"}'), ("b", "7"), ("c", "bad")], "k string, t string")
    assert sorted(map(tuple, documents.flattened(frame, "k", "t").collect())) == [("a", "$.w", "string", '"q"'), ("a", "$.x[0]", "number", '"1"'), ("a", "$.x[1].y", "null", "null"), ("a", "$.x[1].z", "array", "[]"), ("b", "$", "number", '"7"')]
