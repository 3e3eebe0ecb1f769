"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns (assign, access, hex), leftmost and non-overlapping per kind. The method adds
spans of kind `owned`: long mixed tokens without a telling name or shape that look live by the corpus. Every
candidate's hash is counted over the corpus by distinct owners (the source) and repositories (the document); a value
that `copied_owners` owners or `copied_repositories` repositories or more share is a widely copied example, any other
one is specific to its owners and looks live.

Null text counts as empty (no spans). Offsets are code points, end exclusive. Null owners count as one owner; a row
without doc_id is a repository of its own.
Repeated rows are rows of their own. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, saved

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
OPAQUE = re.compile(rb"[A-Za-z0-9+/_=-]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "owned")
HEX_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
TOKEN_RUN = bytes(1 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 0 for b in range(256))
OPAQUE_LENGTH = 24
SCAN = "row long, doc_id long, owner string, n_points long, spans array<struct<kind:int,start:int,stop:int,hash:long>>"


def runs(pattern: re.Pattern, classes: bytes, least: int, text: bytes) -> Iterator[re.Match]:
    """The pattern's maximal runs of at least `least` bytes, looked at only where such a run exists."""
    flat, needle, at = text.translate(classes), b"\x01" * least, 0
    while (at := flat.find(needle, at)) >= 0:
        m = pattern.match(text, at)
        yield m
        at = m.end()


def opaque(token: bytes) -> bool:
    """A token that looks drawn at random: upper and lower case and digits, many different characters, often changing class."""
    if not (re.search(rb"[a-z]", token) and re.search(rb"[A-Z]", token) and len(re.findall(rb"[0-9]", token)) >= 4):
        return False
    changes = len(re.findall(rb"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]", token))
    return len(set(token)) >= 14 and 3 * changes >= len(token)


def find_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(kind, start, stop, hash of the value) in bytes; base kinds first, then opaque tokens outside of them."""
    found, low = [], text.lower()
    if any(name in low for name in NAMES):
        found += [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if b"AKIA" in text:
        found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(2, m.start(), m.end(), m.group()) for m in runs(HEX, HEX_RUN, 32, text)]
    base = [(s, e) for _, s, e, _ in found]
    for m in runs(OPAQUE, TOKEN_RUN, OPAQUE_LENGTH, text):
        if opaque(m.group()) and not any(s < m.end() and m.start() < e for s, e in base):
            found.append((3, m.start(), m.end(), m.group()))
    return [(k, s, e, int.from_bytes(hashlib.sha256(v).digest()[:8], "big", signed=True)) for k, s, e, v in found]


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Candidate spans of every document, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, points = [], []
            for text in as_bytes(batch.column("text")):
                text = text or b""
                ascii_only = text.isascii()
                points.append(len(text) if ascii_only else len(text.decode()))
                found = find_spans(text)
                if not ascii_only and found:
                    cuts = sorted({x for f in found for x in f[1:3]})
                    at, n, before = {}, 0, 0
                    for c in cuts:
                        n += len(text[before:c].decode())
                        at[c], before = n, c
                    found = [(k, at[s], at[e], h) for k, s, e, h in found]
                spans.append([{"kind": k, "start": s, "stop": e, "hash": h} for k, s, e, h in sorted(found, key=lambda f: (f[1], f[0]))])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("owner"), pa.array(points, pa.int64()), pa.array(spans, kind)],
                ["row", "doc_id", "owner", "n_points", "spans"],
            )

    columns = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.col("text").cast("string").alias("text"))
    return columns.mapInArrow(run, SCAN)


def ownership(rows: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories over the whole corpus.

    Repositories are made distinct first, then counted by owner, then added up, so no value's uses meet in one place."""
    repository = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")).alias("row"))
    each = rows.select("owner", repository.alias("repository"), F.explode("spans").alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repository").distinct()
    per_owner = each.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged_spans(docs: DataFrame, owner: str = "source", copied_owners: int = 4, copied_repositories: int = 16) -> tuple[DataFrame, DataFrame]:
    """The scan's rows, and (row, kind, start, stop, n_owners, n_repositories, live) of each span; owned tokens only where they look live."""
    rows = saved(scan(docs, owner), "secrets")
    owners = saved(ownership(rows), "owners")
    each = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    spans = each.join(owners, "hash").withColumn("live", (F.col("n_owners") < copied_owners) & (F.col("n_repositories") < copied_repositories))
    spans = spans.where((F.col("kind") < 3) | F.col("live"))
    return rows, spans


def secret_scan(docs: DataFrame, owner: str = "source", copied_owners: int = 4, copied_repositories: int = 16) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied: one row per document."""
    rows, spans = judged_spans(docs, owner, copied_owners, copied_repositories)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    told = spans.select("row", "live", F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("stop").cast("string")).alias("said")).alias("s"))
    listed = told.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"))
    out = rows.select("row", "doc_id").join(listed, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:int,kind:int,said:string>>")))
    count = lambda k: F.size(F.filter("s", lambda x: x.kind == k)).cast("long")
    text = lambda s: F.array_join(F.transform(s, lambda x: x.said), ",")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text(F.filter("s", lambda x: x.kind < 3)), 256).alias("base_sha256"), text(F.col("s")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def redact(docs: DataFrame, owner: str = "source", copied_owners: int = 4, copied_repositories: int = 16) -> DataFrame:
    """The documents with every span replaced: live-looking values by [SECRET], widely copied ones by [EXAMPLE].

    Documents without spans are untouched, null and empty texts among them; an empty table gives an empty result. Rows that
    repeat a doc_id are redacted by their own text's spans; rows that repeat each other are one repository. Extra columns
    stay as they are, whatever their names; n_chars follows the text where there is one."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    key = F.xxhash64("doc.doc_id", "doc.text")
    rows, spans = judged_spans(whole.select(key.alias("doc_id"), F.col(f"doc.{owner}").alias(owner), F.col("doc.text").alias("text")), owner, copied_owners, copied_repositories)
    cuts = spans.join(rows.select("row", F.col("doc_id").alias("key")), "row").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "live"))).alias("cuts"))
    joined = whole.withColumn("key", key).join(saved(cuts, "cuts"), "key", "left")
    text, start = F.col("doc.text"), F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    between = lambda acc, stop: F.substring(text, acc["at"] + 1, F.greatest(stop - acc["at"], F.lit(0)))
    mark = lambda c: F.when(c["live"], F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
    put = lambda acc, c: F.when(c["stop"] <= acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], between(acc, c["start"]), mark(c)).alias("out"), c["stop"].alias("at")))
    done = F.aggregate("cuts", start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    new = {"text": done, "n_chars": F.length(done).cast("long")}
    return joined.select(*[(F.when(F.col("cuts").isNull(), F.col(f"doc.`{c}`")).otherwise(new[c]) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
