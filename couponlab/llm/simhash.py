"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

The 64 bits are cut into ``distance + g`` blocks.  Fingerprints that differ in at
most ``distance`` bits agree in g blocks at least, so they meet under one of the
choices of g blocks.  They are joined on those blocks and then compared bit by bit.
The number of blocks follows from the number of fingerprints, so that chance
meetings stay rare; every number of blocks finds all pairs.

Equal fingerprints are one row from the start.  A key with many fingerprints is cut
into chunks, and each pair of chunks is compared on its own, so no task holds an
unbounded group.  Within a group the search walks from fingerprint to fingerprint
and leaves out what it has reached; it returns a spanning forest, not all pairs.

Rows: a null or empty text has fingerprint 0 and is linked like any other; repeated
rows each keep a line; null document ids are passed over when a group is named, and
a group of only such rows has a null name; an empty table gives an empty table.
Columns named like an output column are replaced.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.llm.components import components
from couponlab.llm.tables import ROW, numbered, set_aside, settled, written

BITS = 64
#: Fingerprints of one key that are compared at once.
CHUNK = 4096
#: Groups up to this size are compared pair by pair, larger ones by walking.
_SMALL = 8
#: Shingles whose bits are counted at once.
_COUNTED = 1 << 16
FINGERPRINT = "fingerprint"


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """Bits set in over half of the hashes of the text's word shingles, repeats included, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, last)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _COUNTED):
        part = hashes[at : at + _COUNTED].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(documents: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """The documents with ``fingerprint``, a signed 64-bit integer."""
    kept = documents.drop(FINGERPRINT)
    schema = T.StructType([*kept.schema.fields, T.StructField(FINGERPRINT, T.LongType())])

    def run(batches):
        for batch in batches:
            made = pa.array([fingerprint(v.as_py(), size) for v in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, FINGERPRINT])

    return kept.mapInArrow(run, schema)


def block_masks(blocks: int, distance: int) -> list[int]:
    """For each choice of agreeing blocks the bits it keeps, as signed 64-bit integers."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(parts, blocks - distance)]
    return [s - (1 << BITS) if s >> (BITS - 1) else s for s in sums]


def blocks_for(count: int, distance: int) -> int:
    """The fewest blocks, two more than the distance at least, whose keys outnumber the fingerprints fourfold."""
    blocks = distance + 2
    while blocks < BITS and BITS * (blocks - distance) // blocks < log2(max(count, 1)) + 2:
        blocks += 1
    return blocks


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Unsigned, since the bits of a negative number are counted on its absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64))


def _walk(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that span the components of one group."""
    left, right = [], []
    rest = np.arange(len(prints))
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            at = waiting.pop()
            near = _differing(prints[rest], prints[at]) <= distance
            found = rest[near]
            left += [at] * len(found)
            right += found.tolist()
            waiting += found.tolist()
            rest = rest[~near]
    return left, right


def _compared(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal keys (rows sorted by key): pairs of small groups, a spanning forest of others."""
    new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts, sizes = np.r_[0, new], np.diff(np.r_[0, new, len(keys)])
    size_of, group = np.repeat(sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    for step in range(1, _SMALL):
        i = np.flatnonzero((size_of[:-step] <= _SMALL) & (group[step:] == group[:-step])) if len(prints) > step else np.arange(0)
        i = i[_differing(prints[i], prints[i + step]) <= distance]
        a.append(prints[i])
        b.append(prints[i + step])
    for g in np.flatnonzero(sizes > _SMALL):
        own = prints[starts[g] : starts[g] + sizes[g]]
        left, right = _walk(own, distance)
        a.append(own[left])
        b.append(own[right])
    return np.concatenate(a), np.concatenate(b)


def _compare_groups(distance: int):
    """Links from rows that come sorted by group; a group cut by the end of a batch waits for the next."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            cut = np.flatnonzero(np.any(rows[:, :4] != rows[-1, :4], axis=1))
            cut = cut[-1] + 1 if len(cut) else 0
            held, rows = rows[cut:], rows[:cut]
            if len(rows):
                yield _links(*_compared(rows[:, :4], rows[:, 4], distance))
        if held is not None and len(held):
            yield _links(*_compared(held[:, :4], held[:, 4], distance))

    return run


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    low, high = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that join all pairs within the distance into their components."""
    masks = block_masks(blocks_for(prints.count(), distance), distance)
    keys = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("choice"), F.col(FINGERPRINT).bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]
    )
    keyed = prints.select(F.explode(keys).alias("k"), FINGERPRINT).select("k.*", FINGERPRINT)
    shared = written(keyed.groupBy("choice", "bits").count().where("count > 1"), "shared-keys")
    chunks = F.ceil(F.col("count") / CHUNK)
    own = F.pmod(F.xxhash64(FINGERPRINT), chunks)
    met = keyed.join(shared, ["choice", "bits"]).select("choice", "bits", FINGERPRINT, own.alias("own"), chunks.alias("chunks"))
    dealt = met.select(
        "choice", "bits", FINGERPRINT, "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("with")
    ).select("choice", "bits", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), FINGERPRINT)
    group = ["choice", "bits", "low", "high"]
    ordered = dealt.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(_compare_groups(distance), "a bigint, b bigint").distinct()


def groups(marked: DataFrame, key: str, distance: int = 4) -> DataFrame:
    """For each fingerprint of the table ``marked`` its group's ``label`` and ``component_id``, the group's smallest key."""
    return settled(marked.sparkSession, "fingerprint-groups", lambda: _groups(marked, key, distance))


def _groups(marked: DataFrame, key: str, distance: int) -> DataFrame:
    prints = written(marked.groupBy(FINGERPRINT).agg(F.min(key).alias("first")), "distinct-fingerprints")
    labels = components(links(prints, distance)).withColumnRenamed("node", FINGERPRINT)
    named = prints.join(labels, FINGERPRINT, "left").withColumn("label", F.coalesce("label", FINGERPRINT))
    named = written(named, "named-fingerprints")
    # A table of its own, so that both sides of the join are scans and a group with most fingerprints can be split.
    roots = written(named.groupBy("label").agg(F.min("first").alias("component_id")), "group-roots")
    return named.join(roots, "label").select(FINGERPRINT, "label", "component_id")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """``key``, ``fingerprint`` and ``component_id``, the smallest key that can be reached, one row for each document."""
    marked = written(with_fingerprints(documents.select(key, text), text, size).select(key, FINGERPRINT), "fingerprints")
    return marked.join(groups(marked, key, distance), FINGERPRINT).select(key, FINGERPRINT, "component_id")


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, distance: int = 4) -> DataFrame:
    """The documents, of each group that with the smallest key (one without a key only if none has one)."""
    own, back = set_aside(documents, FINGERPRINT, "label", "component_id")
    marked = written(with_fingerprints(numbered(own, "*"), text, size), "fingerprinted")
    named = marked.select(ROW, key, FINGERPRINT).join(groups(marked, key, distance), FINGERPRINT)
    # The least of (no key, key, row): combined in each task, so a group of any size sends one row from each.
    first = named.groupBy("label").agg(F.min(F.struct(F.col(key).isNull().alias("none"), key, ROW)).alias("first"))
    kept = written(first.select(F.col(f"first.{ROW}").alias(ROW)), "kept-rows")
    # The kept rows grow with the documents, so they are never broadcast.
    return marked.join(kept.hint("merge"), ROW, "left_semi").select(*back)


def hex_digits(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def op8_simhash(spark, folder: str) -> DataFrame:
    """Fingerprints of all documents and the groups that at most four differing bits link."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    found = near_duplicates(documents)
    return found.select("doc_id", hex_digits(F.col(FINGERPRINT)).alias(FINGERPRINT), "component_id")
