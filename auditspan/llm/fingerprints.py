"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes picks chunk ends: a hard mask before the normal chunk length and an easy one after it, so lengths stay
near normal. A fingerprint is the set of the chunks' digests with their lengths, and two texts' likeness is the shared length over
the shorter set's. An edit changes the chunks it touches and no others.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

LEAST, NORMAL, MOST = 16, 48, 192
#: Bits of the hash that must be zero at a chunk's end, before and after the normal length.
HARD, EASY = 7, 4
#: Each stored chunk: 12 hexadecimal digits of digest and 2 of length.
DIGEST, ENTRY = 12, 14
#: Texts are read in ranges of the id of about so many bytes on average, one after another, each a task.
RANGE_BYTES = 256 << 20

GEAR = np.random.default_rng(20250101).integers(0, 2**32, 256, np.uint64).astype(np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks of data end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubling: after it, h[i] sums the gears of 2 * step bytes, each shifted by its age
        h[step:] += h[:-step] << np.uint32(step)
    easy = (h >> np.uint32(32 - EASY) == 0).nonzero()[0] + 1
    hard = easy[h[easy - 1] >> np.uint32(32 - HARD) == 0].tolist()
    easy = easy.tolist()
    ends, start = [], 0
    while n - start > LEAST:
        i = bisect_left(hard, start + LEAST)
        if i < len(hard) and hard[i] < start + NORMAL:
            end = hard[i]
        else:
            i = bisect_left(easy, start + NORMAL)
            end = min(easy[i] if i < len(easy) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[str, int]:
    """The digest of each distinct chunk and its length in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in chunk_ends(data):
        piece = data[start:end]
        out[xxhash.xxh3_64_hexdigest(piece)[:DIGEST]] = end - start
        start = end
    return out


def fingerprint(found: dict[str, int]) -> str:
    return "".join(f"{d}{n:02x}" for d, n in sorted(found.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Shared length over the shorter fingerprint's length; 1 for two empty texts, 0 if one is empty."""
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    shared = sum(n for d, n in a.items() if d in b)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """(all columns but one of that name, fingerprint); a null text is empty and has an empty fingerprint."""
    make = F.pandas_udf(lambda s: s.map(lambda t: fingerprint(chunks(t or ""))), "string")
    return docs.drop(*[c for c in docs.columns if c.lower() == name]).withColumn(name, make(F.col(text)))


_OUT = "doc_id {}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_report(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The contract's row for each document.

    The next document is the next in descending doc_id; equal ids go by descending text, null texts as empty ones, and null ids come last.
    Each range of the id is read in order, one row ahead; the first text of a range is also sent to the range before it. Repeated rows each count; an empty table gives no rows. Long texts are chunked whole; rows stream, so a task holds two texts, however many its
    range has. Rows of one doc_id are one range: ids are taken to name documents, and a table where one id has a third of all rows has one long task.
    Columns other than doc_id and text do not matter, whatever their names."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    parts = max(2, total // range_bytes, 3 * docs.sparkSession.sparkContext.defaultParallelism)
    cuts = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10 * parts).alias("cuts")).first()["cuts"] or []
    # The bounds are doubles, which keep the order of ids; each range's true first row is looked up, so rounding moves no row.
    splits = sorted({float("-inf"), 0.0, *(float(c) for c in cuts), float("inf")})
    ranged = Bucketizer(splits=splits, inputCol="place", outputCol="range").transform(rows.withColumn("place", F.col("key").cast("double"))).drop("place").withColumn("range", F.col("range").cast("int"))
    tops = ranged.groupBy("range").agg(F.max("key").alias("key"))  # a row for each range that has rows
    first = ranged.join(F.broadcast(tops), ["range", "key"], "left_semi")
    lead = first.groupBy("range").agg(F.max("text").alias("text"))
    count = len(splits) - 1
    filled = sorted(r["range"] for r in tops.select("range").collect())
    follows = dict(zip(filled, filled[1:] + filled[:1]))  # where a range's first text goes: the range of the next larger ids, from the last to the first
    ghosts = lead.select(F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("key"), "text", F.get(F.lit([follows.get(i, i) for i in range(count)]), F.col("range")).alias("range"), F.lit(True).alias("ghost"))
    every = ranged.select("doc_id", "key", "text", "range", F.lit(False).alias("ghost")).unionByName(ghosts)
    # One range a task: of the numbers that Spark's hash sends to a task, its range goes by the least.
    spread = docs.sparkSession.range(max(64, count * 32)).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("task")).agg(F.min("id").alias("id"))
    lanes = {r.task: r.id for r in spread.collect()}  # a row for each range
    lane = F.get(F.lit([lanes.get(i, i) for i in range(count)]), F.col("range"))
    every = every.withColumn("lane", lane.cast("long")).repartition(count, "lane").sortWithinPartitions("range", "ghost", F.col("key").desc(), F.col("text").desc())

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ghost")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, own = [], None, {}
        for doc_id, text, ghost in rows_of(batches):
            new = chunks(text)
            if held is not None:
                before, whole = held
                n = len(whole)
                edited = whole[:n - n // 2] + text[:n // 2]
                changed = chunks(edited)
                out.append((before, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, new)))
            held, own = (None, {}) if ghost else ((doc_id, text), new)
            if len(out) >= 2000:
                yield _batch(out, kinds, names)
                out = []
        if out:
            yield _batch(out, kinds, names)

    kinds = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return every.select("doc_id", "text", "ghost").mapInArrow(make, _OUT.format(kind))


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
