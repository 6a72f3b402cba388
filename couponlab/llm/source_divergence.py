"""Divergence of sources within a language, by stripes that mappers combine.

A partition folds whole documents into hash stripes: term to document frequency and
occurrences by source, per language.  Stripes are spilled when they hold ENTRIES
numbers, merged by (language, term), and those of kept terms are written as a table.
Merged stripes give the divergences directly: a shard of a language's stripes makes
dense blocks of shares, term by source, and adds up differences per pair of sources
and the largest ones per term.  Shards are summed and ranked afterwards.

All numbers are integers; shares are parts of ``SCALE``.

Hot keys: a common term sends one row a task, spill and source; a large language is
split in shards by its number of stripe entries, and its sources in blocks.

Rows: a null text, language or source is read as ''; repeated rows count as documents
each; a text without terms still makes its (language, source) a group; a language
without kept terms gives pairs of value 0; an empty table gives an empty table; other
columns are ignored, clashing names too.  Ties are ordered by the UTF-8 of the item.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponlab.llm.tables import written

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCUMENTS = 30
#: Shares are parts of this; SMOOTHING is added to each count.
SCALE, SMOOTHING = 1_000_000_000, 5
#: Terms reported of each group.
TERMS = 50
#: Numbers that a partition's stripes hold before they are spilled.
ENTRIES = 300_000
#: Stripe entries of a shard, cells of its dense block, and sources whose rows one task works out.
SHARD_ENTRIES, SHARD_CELLS, BLOCK = 16_384, 2_000_000, 256
#: Bytes of text taken apart at once.
SLICE = 8_000_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STRIPES = "lang string, term string, source string, documents bigint, n bigint"
_RESULT = "lang string, source string, part string, item string, value bigint"


def terms_of(text: str) -> Counter:
    """Occurrences of each term, as UTF-8: runs of ASCII letters, lower-cased, and of whatever is not ASCII."""
    data = text.encode("utf-8").translate(_LETTERS)
    found, start = Counter(), 0
    while start < len(data):
        stop = data.find(b" ", start + SLICE)
        stop = len(data) if stop < 0 else stop
        found.update(data[start:stop].split())
        start = stop
    return found


class Stripes:
    """A partition's stripes: per language, term to [documents, {source: occurrences}]."""

    def __init__(self):
        self._of: dict[str, dict[bytes, dict[str, list[int]]]] = {}
        self.entries = 0

    def add(self, lang: str, source: str, terms: Counter) -> None:
        stripes = self._of.setdefault(lang, {})
        for term, n in terms.items():
            stripe = stripes.get(term)
            if stripe is None:
                stripes[term] = {source: [1, n]}
                self.entries += 1
                continue
            counts = stripe.get(source)
            if counts is None:
                stripe[source] = [1, n]
                self.entries += 1
            else:
                counts[0] += 1
                counts[1] += n

    def spill(self, size: int = 50_000):
        """All stripes as batches of rows; none are left."""
        rows = (
            (lang, term, source, *counts)
            for lang, stripes in self._of.items()
            for term, stripe in stripes.items()
            for source, counts in stripe.items()
        )
        kinds = [pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        names = ["lang", "term", "source", "documents", "n"]
        while self.entries:
            part = [row for _, row in zip(range(min(size, self.entries)), rows)]
            self.entries -= len(part)
            columns = [pa.array(c, kind) for c, kind in zip(zip(*part), kinds)]
            columns[1] = columns[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)
        self._of = {}


def folded(documents: DataFrame) -> DataFrame:
    """Stripes of each partition, a row for each (language, term, source) of a spill."""

    def run(batches):
        stripes = Stripes()
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                stripes.add(lang.as_py(), source.as_py(), terms_of(text.as_py()))
                if stripes.entries >= ENTRIES:
                    yield from stripes.spill()
        yield from stripes.spill()

    return documents.mapInArrow(run, _STRIPES)


def kept_stripes(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Merged stripes of the kept terms: ``lang``, ``term`` and ``counts``, an array of (source, n)."""
    # One shuffle by term serves both groupings; mappers have combined already.
    spread = folded(documents).repartition("lang", "term")
    by_source = spread.groupBy("lang", "term", "source").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"))
    merged = by_source.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    return merged.where(F.col("documents") >= least).drop("documents")


def _groups(documents: DataFrame, stripes: DataFrame) -> DataFrame:
    """Every (language, source) with the total of its kept terms, and its language's terms, total, shards and blocks."""
    each = stripes.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source"))
    totals = each.agg(F.sum("c.n").alias("total"))
    terms = stripes.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("counts")).alias("entries"))
    sources = documents.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    groups = sources.withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    langs = langs.join(terms, "lang", "left").fillna(0, ["terms", "entries"])
    shards = F.greatest(
        F.ceil(F.col("entries") / SHARD_ENTRIES), F.ceil(F.col("terms") * F.col("sources") / SHARD_CELLS), F.lit(1)
    )
    langs = langs.withColumn("shards", shards.cast("int")).withColumn("blocks", F.ceil(F.col("sources") / BLOCK).cast("int"))
    return groups.join(langs.drop("sources", "entries"), "lang")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / totals), exactly."""
    if counts.size and counts.max() > np.iinfo(np.int64).max // SCALE:
        counts, totals = counts.astype(object), np.asarray(totals, object)
    return (1 + SCALE * counts // totals).astype(np.int64)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def diverged(stripes: pa.Table, groups: pa.Table) -> pa.Table:
    """Of a shard: summed differences between its block's sources and all others, and its largest terms."""
    sources = groups.column("source").combine_chunks()
    lang, own = groups.column("lang")[0].as_py(), np.flatnonzero(groups.column("own").to_numpy(zero_copy_only=False))
    terms, added = stripes.column("term").combine_chunks(), SMOOTHING * int(groups.column("terms")[0].as_py())
    lists = stripes.column("counts").combine_chunks()
    entries = lists.flatten()
    counts = np.zeros((len(terms), len(sources)), np.int64)
    if len(entries):
        at = np.repeat(np.arange(len(terms)), pc.list_value_length(lists).to_numpy())
        column = pc.index_in(entries.field("source"), value_set=sources).to_numpy()
        counts[at, column] = entries.field("n").to_numpy()
    share = shares(counts + SMOOTHING, _numbers(groups, "total") + added) if len(terms) else counts
    whole = shares(counts.sum(1) + SMOOTHING, _numbers(groups, "lang_total")[0] + added) if len(terms) else counts.sum(1)
    names, found = sources.to_pylist(), {"source": [], "part": [], "item": [], "value": []}

    def emit(source: str, part: str, items: list[str], values: np.ndarray) -> None:
        found["source"] += [source] * len(items)
        found["part"] += [part] * len(items)
        found["item"] += items
        found["value"].append(values)

    for a in own.tolist():
        apart = np.abs(share - share[:, a : a + 1]).sum(0)
        emit(names[a], "pair", names[:a] + names[a + 1 :], np.delete(apart, a))
        over = share[:, a] - whole
        places = np.flatnonzero((counts[:, a] > 0) & (over > 0))
        if len(places) > TERMS:
            # All that tie with the last one stay; ranks are given once the shards are together.
            places = places[over[places] >= -np.partition(-over[places], TERMS - 1)[TERMS - 1]]
        emit(names[a], "term", terms.take(pa.array(places)).to_pylist(), over[places])
    values = np.concatenate(found["value"]) if found["value"] else np.zeros(0, np.int64)
    columns = [pa.array(found[k], pa.string()) for k in ("source", "part", "item")]
    return pa.table([pa.array([lang] * len(values), pa.string()), *columns, pa.array(values)], names=["lang", "source", "part", "item", "value"])


def divergences(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Ranked divergences of the sources of each language: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: against each other source, the differences of shares summed over all kept terms.  Part ``term``:
    the kept terms that the source has more often than its language, the first ``TERMS`` of them.
    """
    read = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    stripes = written(kept_stripes(read, least), "stripes")
    groups = written(_groups(read, stripes), "groups")

    langs = groups.select("lang", "shards", "blocks").distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard")
    left = stripes.join(written(langs, "langs"), "lang").select("lang", "term", "counts", shard, every)
    right = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("*", every)
    own = (F.pmod(F.xxhash64("source"), F.col("blocks")) == F.col("block")).alias("own")
    right = right.select("lang", "shard", "block", "source", "total", "lang_total", "terms", own)
    keys = ["lang", "shard", "block"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(diverged, _RESULT)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    shown = written(parts, "divergences")
    pairs = shown.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))
    terms = shown.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TERMS)
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*order).unionByName(terms.select(*order))


def op13_source_divergence(spark, folder: str) -> DataFrame:
    """Divergence of the sources of every language of ``documents``."""
    return divergences(spark.read.parquet(f"{folder}/documents.parquet"))
