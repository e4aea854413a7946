"""A two-pass external shuffle into shards.

Pass one scatters the records uniformly over memory-sized buckets by a seeded hash of the whole row and of its number among equal rows;
pass two shuffles each bucket by Fisher-Yates.
The buckets end to end are one random order of all records, which is cut into shards whose counts differ by one at most (law `rows`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh, small, written

SHARDS, SEED = 8, 20250101
#: A bucket holds about so many bytes of records, which one task keeps in memory a few times over.
BUCKET_BYTES = 32 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of a text, and one for the record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of n places; numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.default_rng(seed).permutation(n)


#: Copies of one row are numbered by so many in a task.
COPIES = 1 << 16


def _numbered(docs: DataFrame, number: str, most: int) -> DataFrame:
    """docs with a number from 0 that tells equal rows apart. Rows are counted by hash first, and only those of repeated hashes are brought together, as counts.

    Where a hash has more than `most` rows, the numbers come in ranges of so many, dealt over the tasks before they become rows."""
    digest, n, part = fresh(docs, "_hash", "_count", "_part")
    hashed = docs.withColumn(digest, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    repeated = written(hashed.groupBy(digest).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1))
    if repeated.isEmpty():
        return docs.withColumn(number, F.lit(0).cast("long"))
    hot = not repeated.where(F.col(n) > most).isEmpty()
    repeated = small(repeated.select(digest), 500_000)
    counted = hashed.join(repeated, digest, "left_semi").groupBy(*(F.col(f"`{c}`") for c in docs.columns)).agg(F.count(F.lit(1)).alias(n))
    first, last = F.lit(0).cast("long"), F.col(n) - 1
    if hot:
        counted = counted.withColumn(part, F.explode(F.sequence(first, F.floor(last / most)))).repartition(part, *(F.col(f"`{c}`") for c in docs.columns))
        first, last = F.col(part) * most, F.least(last, F.col(part) * most + (most - 1))
    copies = counted.withColumn(number, F.explode(F.sequence(first, last))).drop(n, part)
    return hashed.join(repeated, digest, "left_anti").drop(digest).withColumn(number, F.lit(0).cast("long")).unionByName(copies)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES, copies: int = COPIES) -> DataFrame:
    """docs with shard (int) and slot (long, from 0 without gaps in each shard).

    The order depends on the seed, the rows and the bucket size alone, not on `copies`, on how Spark partitions docs or on how many cores there are.
    Null ids and texts hash like any value; equal rows are numbered and scatter like others; an empty table stays empty. A text of any length
    is one record. Extra columns named shard or slot give way, and other names don't matter.
    A lost executor's buckets are made again the same, since each bucket is sorted before it is shuffled."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    total = docs.agg(F.sum(record_size(F.col(text))).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows = int(total["rows"])
    buckets = max(shards, -(-int(total["bytes"] or 0) // bucket_bytes))
    bucket, digest, before, number = fresh(docs, "_bucket", "_digest", "_before", "_number")
    key = [*(F.col(f"`{c}`") for c in docs.columns), F.col(number)]
    placed = _numbered(docs, number, copies).withColumn(digest, F.xxhash64(F.lit(seed + 1), *key)).withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int"))

    counts = written(placed.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")))  # a row for each bucket
    starts = counts.select(bucket, (F.sum("_n").over(Window.orderBy(bucket)) - F.col("_n")).alias(before))
    joined = placed.join(small(starts, 100_000), bucket)
    out = StructType([*(StructField(f.name, f.dataType, True) for f in docs.schema), StructField("shard", IntegerType()), StructField("slot", LongType())])

    def shuffle(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([(digest, "ascending"), (number, "ascending")])
        n, start = part.num_rows, part.column(before)[0].as_py()
        part = part.take(pa.array(fisher_yates(n, [seed, key[0].as_py()])))
        at = np.arange(start, start + n, dtype=np.int64)
        shard = at * shards // rows
        slot = at - -(-shard * rows // shards)  # less the first place of its shard
        part = part.drop_columns([bucket, digest, before, number])
        return part.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return joined.groupBy(bucket).applyInArrow(shuffle, out)


def shard_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, law `rows`. The texts themselves are shuffled, and the shards written to the shared folder, a folder each; the row is read from there."""
    out = written(sharded(docs), "shard")
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", record_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
