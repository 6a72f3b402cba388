"""Approximate nearest neighbours by inner product with an adaptive scan of dimensions.

Rows fall into bands of norm, each a factor of two wide.  A vector x is divided by the
greatest norm of its band and gets one more component, which makes its length 1; a query
is divided by its own norm and gets a zero.  Then the nearest of a band by distance are
its nearest by inner product, and a single-precision distance is off by a little of the
row's own norm, whatever norms other rows have.  All are turned by one random rotation,
so the first d of D components carry about d/D of a squared distance.  Rows lie in the
list of their nearest centroid.  A query scans the lists of its nearest centroids, the
greatest norms first and a block of columns at a time; after each block a candidate is
given up whose partial distance is too great, by a test of the hypothesis that its
product is over the query's present k-th.  What is left is measured again on the original
vectors in double precision.

Bands above the one of most rows, as far as they hold few rows, are a list of their own
that every query measures whole, in double precision: their rows are near half of all
queries, in no direction's lists.

Centroids are learned from a bounded sample, but every row is in a list.  Lists are
packed into buckets of bounded size and a long list is cut into several, so a vector
with very many copies is spread; queries come in chunks.

``SHARE`` of the lists is scanned.  These vectors have hardly any clusters: on 51,282
rows a seventh of the lists holds 61 % of the true neighbours, 57 % of them 96 %.

Rows: vectors that are null, empty, zero or hold nulls or values that are not finite
take no part, nor do those of another length than most have, nor null ids; repeated
rows are rows of their own, and only the query's own row is left out; equal products
go by the smaller id, but infinite ones by what they would be without the limit of
doubles; a table without queries or candidates gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from couponlab.llm.tables import ROW, numbered, written

#: Rows the centroids are learned from, and centroids, at most.
SAMPLE = 20_000
LISTS = 4096
#: The part of the lists that a query scans.
SHARE = 0.75
#: Rows of a bucket and queries of a chunk, about.
BUCKET = 8192
CHUNK = 1024
#: Columns of a block, and how many deviations a partial distance may be off.
COLUMNS = 16
DEVIATIONS = 1.5
SEED = 11
# A product beyond doubles is worked out with the candidate smaller by this power of two.
_SHIFT = 64


def _slack(width: int) -> float:
    """Distances of vectors of length 1 are scanned in single precision; this much more than the k-th is measured again."""
    return max(1e-4, width * 2.0**-21)


def measured(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each row, and its norm over two to the power of that, without overflow."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    share, more = np.frexp(np.sqrt((np.ldexp(vectors, -exponents[:, None]) ** 2).sum(axis=1)))
    # Norms about a power of two, such as 1, are in one band.
    low = share < 0.5**0.5
    return (exponents + more - low).astype(np.int64), np.where(low, 2 * share, share)


class Space:
    """The greatest norm of each band, the rotation and the centroids, small by their bounds, and what goes with them."""

    def __init__(self, greatest: dict[int, float], rotation: np.ndarray, centroids: np.ndarray):
        self.greatest, self.rotation, self.centroids = greatest, rotation, centroids

    def turned(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        bands, norms = measured(vectors)
        over = norms if query else np.array([self.greatest[b] for b in bands.tolist()])
        units = np.ldexp(vectors, -bands[:, None]) / over[:, None]
        spare = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, 1 - (units**2).sum(axis=1)))
        return np.column_stack([units, spare]) @ self.rotation

    def ranked(self, turned: np.ndarray, count: int) -> np.ndarray:
        """The nearest centroids of each row, nearest first."""
        far = (self.centroids**2).sum(axis=1) - 2 * turned.astype(np.float32) @ self.centroids.T
        return far.argmin(axis=1)[:, None] if count == 1 else np.argsort(far, axis=1, kind="stable")[:, :count]


def learned(sample: np.ndarray, greatest: dict[int, float], lists: int) -> Space:
    """A random rotation, and centroids by Lloyd's steps on the sample."""
    draw = np.random.default_rng(SEED)
    rotation = np.linalg.qr(draw.normal(size=(sample.shape[1] + 1,) * 2))[0]
    turned = Space(greatest, rotation, rotation).turned(sample).astype(np.float32)
    lists = min(lists, len(turned))
    space = Space(greatest, rotation, turned[np.sort(draw.choice(len(turned), lists, replace=False))])
    for _ in range(8):
        own = space.ranked(turned, 1)[:, 0]
        sums = np.zeros((lists, turned.shape[1]))
        np.add.at(sums, own, turned)
        counts = np.bincount(own, minlength=lists)[:, None]
        space.centroids = np.where(counts > 0, sums / np.maximum(counts, 1), space.centroids).astype(np.float32)
    return space


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def scan(queries: np.ndarray, candidates: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Squared distances of every query to every candidate, infinite where a candidate was given up."""
    width = queries.shape[1]
    far = np.zeros((len(queries), len(candidates)), np.float32)
    alive = np.ones(far.shape, bool)
    for at in range(0, width, COLUMNS):
        q, x = queries[:, at : at + COLUMNS], candidates[:, at : at + COLUMNS]
        seen = min(width, at + COLUMNS)
        if alive.mean() > 0.2:
            far += (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * q @ x.T
        else:
            i, j = np.nonzero(alive)
            far[i, j] += ((q[i] - x[j]) ** 2).sum(axis=1)
        if seen < width:
            limit = bound * (seen / width) * (1 + DEVIATIONS / np.sqrt(seen)) ** 2
            alive &= far <= limit[:, None]
    far[~alive] = np.inf
    return far


def _ratio(space: Space, a: int, b: int) -> float:
    """The greatest norm of band a over that of band b, kept finite and above zero."""
    return float(np.ldexp(space.greatest[a] / space.greatest[b], max(-1000, min(1000, a - b))))


def products_of(asked: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products row by row; and for infinite ones what orders them, else 0."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores, beyond = (asked * vectors).sum(axis=1), np.zeros(len(asked))
        at = np.flatnonzero(~np.isfinite(scores))
        if len(at):
            exponents = np.frexp(np.abs(asked[at]).max(axis=1))[1]
            small = (np.ldexp(asked[at], -exponents[:, None]) * np.ldexp(vectors[at], -_SHIFT)).sum(axis=1)
            scores[at] = np.ldexp(small, exponents + _SHIFT)
            beyond[at] = np.where(np.isinf(scores[at]), small, 0)
    return scores, beyond


def search(space: Space, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best candidates of one bucket for each query of one chunk."""
    names = ["query", "query_id", "row", "vec_id", "score", "beyond"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    empty = pa.table([pa.array([], t) for t in kinds], names=names)
    if not left.num_rows or not right.num_rows:
        return empty
    vectors, asked = _matrix(left["vector"]), _matrix(right["vector"])
    lists, rows, ids = (left[c].to_numpy() for c in ("list", "row", "vec_id"))
    query_rows, query_ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
    probed = right["lists"].to_pylist()
    wanted = {}
    for i, own in enumerate(probed):
        for one in own:
            wanted.setdefault(one, []).append(i)
    turned, turned_queries = space.turned(vectors), space.turned(asked, query=True)
    singles, single_queries = turned.astype(np.float32), turned_queries.astype(np.float32)
    slack, bands, exact = _slack(turned.shape[1]), measured(vectors)[0], len(space.centroids)
    # The greatest products of each query, over the greatest norm of the band at hand.
    best, pairs, held = np.full((len(asked), k + 1), -np.inf), [], []

    def kept():
        # What a band still holds of the best when its last list has been scanned.
        for i, j, products in held:
            near = (products >= best[i].min(axis=1) - slack / 2) & (rows[j] != query_rows[i])
            pairs.append((i[near], j[near]))
        held.clear()

    unit = None
    for band, one in sorted(((b, o) for b, o in set(zip(bands.tolist(), lists.tolist())) if o in wanted), key=lambda g: (-g[0], g[1])):
        if unit not in (None, band):
            kept()
            best *= _ratio(space, unit, band)
        unit = band
        i, j = np.array(wanted[one]), np.flatnonzero((lists == one) & (bands == band))
        limit = 2 - 2 * best[i].min(axis=1) + slack
        i, limit = i[limit >= 0], limit[limit >= 0]
        if not len(i):
            continue
        if one == exact:
            products = turned_queries[i] @ turned[j].T
        else:
            products = 1 - scan(single_queries[i], singles[j], limit).astype(np.float64) / 2
        merged = np.concatenate([best[i], products], axis=1)
        # One more than k, since the query's own row may be among them.
        best[i] = np.partition(merged, -k - 1, axis=1)[:, -k - 1 :]
        a, b = np.nonzero(np.isfinite(products) & (products >= best[i].min(axis=1)[:, None] - slack / 2))
        held.append((i[a], j[b], products[a, b]))
    kept()
    if not pairs:
        return empty
    i, j = (np.concatenate(p) for p in zip(*pairs))
    parts = [products_of(asked[i[s : s + CHUNK]], vectors[j[s : s + CHUNK]]) for s in range(0, len(i), CHUNK)]
    scores, beyond = (np.concatenate([[0.0][:0], *p]) for p in (zip(*parts) if parts else ((), ())))
    order = np.lexsort((rows[j], ids[j], -beyond, -scores, i))
    i, j, scores, beyond = i[order], j[order], scores[order], beyond[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, scores, beyond = (c[place < k] for c in (i, j, scores, beyond))
    made = [query_rows[i], query_ids[i], rows[j], ids[j], scores, beyond]
    return pa.table([pa.array(m, t) for m, t in zip(made, kinds)], names=names)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``row``, ``vec_id`` and ``vector`` of the rows that take part, as a table."""
    as_doubles = F.col(vector).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = numbered(vectors, F.col(key).alias("vec_id"), as_doubles.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    kept = written(rows.withColumnRenamed(ROW, "row"), "vectors")
    lengths = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size")
    most = lengths.first()
    return kept.where(F.size("vector") == (most["size"] if most else 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the k nearest rows found for each row where ``is_query(key)`` holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)

    def to_band(batches):
        for batch in batches:
            made = measured(_matrix(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), batch.column("asked")], names=["band", "norm", "asked"])

    own = rows.select("vector", F.when(is_query(F.col("vec_id")), 1).alias("asked"))
    own = own.mapInArrow(to_band, "band bigint, norm double, asked int").groupBy("band")
    # One row for each band: some two thousand at most, by the range of doubles.
    facts = own.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("norm"), F.count("asked").alias("q")).orderBy(F.desc("band")).collect()
    total, asked_rows = sum(f["n"] for f in facts), sum(f["q"] for f in facts)
    if not asked_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    above, apart = 0, set()
    for fact in facts:
        above += fact["n"]
        if above > BUCKET or fact["n"] == max(f["n"] for f in facts):
            break
        apart.add(fact["band"])
    taken = rows.select("vector", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).select("vector").toArrow()
    space = learned(_matrix(taken["vector"]), {f["band"]: f["norm"] for f in facts}, min(LISTS, max(1, round(total**0.5))))
    shared = spark.sparkContext.broadcast((space.greatest, space.rotation, space.centroids))

    def to_list(batches):
        space = Space(*shared.value)
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            own = space.ranked(space.turned(vectors), 1)[:, 0]
            own[np.isin(measured(vectors)[0], list(apart))] = len(space.centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "list"])

    listed = written(rows.mapInArrow(to_list, "row bigint, vec_id bigint, vector array<double>, list bigint"), "listed-vectors")

    # One number for each list: at most LISTS rows, and that of the greatest norms.
    counts = np.zeros(len(space.centroids) + 1, np.int64)
    for one, count in listed.groupBy("list").count().collect():
        counts[one] = count
    first, cuts, filled, bucket = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // BUCKET)), 0, 0
    for one, count in enumerate(counts):
        if filled and filled + count > BUCKET:
            bucket, filled = bucket + 1, 0
        first[one] = bucket
        bucket, filled = (bucket + cuts[one], 0) if cuts[one] > 1 else (bucket, filled + count)
    chunks = -(-asked_rows // CHUNK)
    least, probes = 4 * (k + 1), max(1, int(np.ceil(share * len(space.centroids))))

    def ask(batches):
        space = Space(*shared.value)
        for batch in batches:
            out = {"bucket": [], "at": [], "lists": []}
            turned = space.turned(_matrix(batch.column("vector")), query=True)
            for at, order in enumerate(space.ranked(turned, len(space.centroids))):
                # Enough lists to hold k rows in any case.
                order = order[: max(probes, int(np.searchsorted(np.cumsum(counts[order]), least)) + 1)]
                wanted = {}
                for one in [*order.tolist(), len(space.centroids)][: None if apart else -1]:
                    for cut in range(int(cuts[one])):
                        wanted.setdefault(int(first[one]) + cut, []).append(one)
                for b, own in wanted.items():
                    out["bucket"].append(b)
                    out["at"].append(at)
                    out["lists"].append(own)
            taken = pa.array(out["at"], pa.int64())
            made = [batch.column(c).take(taken) for c in ("row", "vec_id", "vector")]
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array(out["bucket"], pa.int64()), pa.array(out["lists"], pa.list_(pa.int64()))],
                names=["row", "vec_id", "vector", "bucket", "lists"],
            )

    queries = listed.where(is_query(F.col("vec_id"))).select("row", "vec_id", "vector")
    asked = queries.mapInArrow(ask, "row bigint, vec_id bigint, vector array<double>, bucket bigint, lists array<bigint>")
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    packing = spark.createDataFrame([(i, int(a), int(c)) for i, (a, c) in enumerate(zip(first, cuts))], "list bigint, first bigint, cuts bigint")
    held = listed.join(F.broadcast(packing), "list").select(
        "row",
        "vec_id",
        "vector",
        "list",
        (F.col("first") + F.pmod(F.xxhash64("row"), F.col("cuts"))).alias("bucket"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk"),
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return search(Space(*shared.value), left, right, k)

    found = held.groupBy("bucket", "chunk").cogroup(asked.groupBy("bucket", "chunk")).applyInArrow(
        compare, "query bigint, query_id bigint, row bigint, vec_id bigint, score double, beyond double"
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_dimension_scan(spark, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth vector by inner product."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    return nearest(vectors, lambda key: key % 20 == 0)
