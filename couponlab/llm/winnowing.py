"""Benchmark decontamination by winnowing.

Of the hashes of k consecutive words the least of every w in a row is kept, the
rightmost of equals.  Any k + w - 1 words that two texts share hold a hash that
both have kept.  Kept hashes of documents and of benchmark items are joined, and each
hit is extended word by word to both sides; words are compared as words, so equal
hashes of different words do nothing.  An item shorter than the window is compared
as a whole: all grams of its length are kept.

Document hashes that no item can have are dropped where they are made, by a bitmap
of fixed size over the item hashes.  It saves work only; a full bitmap lets all pass.

Rows: null, empty or wordless texts have no words, hit nothing and are hit by
nothing; repeated rows each keep a line; items of null id hit words but are not
counted; no items or an empty table give no hits.  Documents keep only ``key``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponlab.llm.hashing import Powers, mixed, prefix_sums, ranges
from couponlab.llm.tables import ROW, numbered, written

#: Words of a window, and of the grams that are hashed.
WINDOW = 10
GRAM = 5
#: Bits of the bitmap, as powers of two, at least and at most: 1 MB to 64 MB.  In between there are 16 or more to a hash.
BITMAP, BITMAP_MOST = 23, 29
#: Bytes hashed at once; a longer word is hashed alone.
PIECE = 1 << 20

# Place 1 is the first bit of bucket 1 in Spark's bitmap functions; a bucket has 32,768 bits.
_FIRST = 32768

GRAMS = "array<struct<width:int,hash:bigint,pos:bigint,lead:int,words:array<string>>>"

# Lower-cases A-Z; what separates words becomes 0.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[ord("A") : ord("Z") + 1] += 32
_LETTERS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0


class Words:
    """The words of one text: their places in its lower-cased bytes and their hashes."""

    def __init__(self, text: str, powers: Powers):
        self._bytes = _LETTERS[np.frombuffer(text.encode("utf-8"), np.uint8)]
        inside = np.zeros(len(self._bytes) + 2, np.int8)
        inside[1:-1] = self._bytes != 0
        edges = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        made, at = [np.zeros(0, np.uint64)], 0
        while at < len(self.starts):
            base = self.starts[at]
            upto = max(at + 1, int(np.searchsorted(self.ends, base + PIECE, "right")))
            sums = prefix_sums(self._bytes[base : self.ends[upto - 1]], powers)
            made.append(ranges(sums, self.starts[at:upto] - base, self.ends[at:upto] - base, powers))
            at = upto
        self.hashes = np.concatenate(made)

    def __len__(self) -> int:
        return len(self.starts)

    def words(self, start: int, end: int) -> list[str]:
        return [self._bytes[a:b].tobytes().decode("utf-8") for a, b in zip(self.starts[start:end], self.ends[start:end])]

    def grams(self, size: int) -> np.ndarray:
        n = len(self) - size + 1
        out = np.full(max(n, 0), size, np.uint64)
        for j in range(size if n > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.hashes[j : j + n]
        return mixed(out)


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every window, the rightmost of equals."""
    n = len(hashes) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = hashes[:n].copy()
    for j in range(1, window):
        np.minimum(least, hashes[j : j + n], out=least)
    chosen, open_ = np.zeros(len(hashes), bool), np.ones(n, bool)
    for j in reversed(range(window)):
        hit = open_ & (hashes[j : j + n] == least)
        chosen[j : j + n] |= hit
        open_ &= ~hit
    return np.flatnonzero(chosen)


def _gram(words: Words, width: int, hash_: np.uint64, pos: int, size: int, reach: int) -> dict:
    start, end = max(0, pos - reach), min(len(words), pos + size + reach)
    return {"width": width, "hash": int(hash_.astype(np.int64)), "pos": pos, "lead": pos - start, "words": words.words(start, end)}


def _grams_of(words: Words, widths: list[int], bitmap: np.ndarray | None, size_bits: int = BITMAP) -> list[dict]:
    """Kept grams of every width with the words around them, those the bitmap lets pass."""
    out = []
    for width in widths:
        size = GRAM if width == WINDOW else width
        hashes = words.grams(size)
        places = kept(hashes, width - size + 1)
        if bitmap is not None:
            bits = (hashes[places] >> np.uint64(64 - size_bits)).astype(np.int64) + _FIRST
            places = places[(bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
        out += [_gram(words, width, hashes[p], int(p), size, width - size) for p in places]
    return out


def _marked(rows: DataFrame, text: str, pick) -> DataFrame:
    """``rows`` without the text, with ``n_words`` and ``grams``, which ``pick(words)`` gives."""
    others = [c for c in rows.columns if c != text]
    kinds = {c: t for c, t in rows.dtypes}
    struct = pa.struct(
        [("width", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))]
    )

    def run(batches):
        powers = Powers()
        for batch in batches:
            n_words, grams = [], []
            for value in batch.column(text):
                words = Words(value.as_py() or "", powers)
                n_words.append(len(words))
                grams.append(pick(words) if len(words) else [])
            made = [pa.array(n_words, pa.int64()), pa.array(grams, pa.list_(struct))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], names=[*others, "n_words", "grams"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "n_words bigint", f"grams {GRAMS}"])
    return rows.mapInArrow(run, schema)


def _bits_for(hashes: int) -> int:
    """The power of two of a bitmap that a given number of hashes fills to a sixteenth at most, within bounds."""
    return min(max(BITMAP, (16 * hashes - 1).bit_length()), BITMAP_MOST)


def _bitmap(grams: DataFrame, size_bits: int) -> np.ndarray:
    """A bit for the leading bits of every hash.  It only narrows what is joined: a full one would let all pass."""
    place = F.shiftrightunsigned("hash", 64 - size_bits) + 1
    rows = grams.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(((1 << size_bits) + _FIRST) // 8, np.uint8)
    for bucket, bits in rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit")).collect():
        out[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _agreeing(a: Column, b: Column) -> Column:
    """How many words the two lists begin with in common."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted as strings) and ``contaminated``."""
    context = documents.sparkSession.sparkContext

    def of_item(words):
        width = min(len(words), WINDOW)
        return _grams_of(words, [width], None)

    items = _marked(benchmark.select("item_id", "text"), "text", of_item)
    gram = written(items.select("item_id", F.explode("grams").alias("g")).select("item_id", "g.*").drop("pos"), "item-grams")
    around = ["width", "hash", "lead", "words"]
    contexts = written(gram.select(*around).distinct().withColumn("context", F.monotonically_increasing_id()), "item-contexts")
    owners = written(gram.join(contexts, around).select("context", "item_id").distinct(), "context-items")

    widths = sorted(r[0] for r in contexts.select("width").distinct().collect())
    size_bits = _bits_for(contexts.count())
    bitmap = context.broadcast(_bitmap(contexts, size_bits))
    of_document = lambda words: _grams_of(words, widths, bitmap.value, size_bits)
    marked = written(_marked(numbered(documents, key, F.col(text).alias("text")), "text", of_document), "document-grams")

    met = marked.select(ROW, F.explode("grams").alias("g")).select(ROW, "g.*").join(
        contexts.select("width", "hash", F.col("lead").alias("item_lead"), F.col("words").alias("item_words"), "context"), ["width", "hash"]
    )
    before = _agreeing(F.reverse(F.slice("words", F.lit(1), F.col("lead"))), F.reverse(F.slice("item_words", F.lit(1), F.col("item_lead"))))
    rest = lambda w, lead: F.slice(w, F.col(lead) + 1, F.size(w))
    after = _agreeing(rest("words", "lead"), rest("item_words", "item_lead"))
    size = F.when(F.col("width") == WINDOW, GRAM).otherwise(F.col("width"))
    hits = met.select(ROW, "context", "width", "pos", size.alias("size"), before.alias("before"), after.alias("after"))
    hits = hits.where((F.col("after") >= F.col("size")) & (F.col("before") + F.col("after") >= F.col("width")))
    hits = written(
        hits.select(ROW, "context", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end")), "hits"
    )

    furthest = F.expr(f"max(`end`) over (partition by {ROW} order by start rows between unbounded preceding and 1 preceding)")
    spans = hits.groupBy(ROW, "start").agg(F.max("end").alias("end"))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(furthest, F.lit(0))))
    covered = spans.select(ROW, fresh.alias("fresh")).groupBy(ROW).agg(F.sum("fresh").alias("n_hit"))
    named = hits.select(ROW, "context").distinct().join(owners, "context").select(ROW, F.col("item_id").cast("string").alias("item"))
    listed = named.distinct().groupBy(ROW).agg(F.array_sort(F.collect_list("item")).alias("items"))
    return (
        marked.select(ROW, key, "n_words")
        .join(covered, ROW, "left")
        .join(listed, ROW, "left")
        .select(
            key,
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no benchmark window occurs in.  Equal texts share their fate, so they are told apart by content."""
    content = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    found = contamination(documents.select(content.alias("__content"), text), benchmark, "__content", text)
    hit = found.where("contaminated").select("__content").distinct()
    return documents.join(hit, content == F.col("__content"), "left_anti")


def op4_winnowing(spark, folder: str) -> DataFrame:
    """Words of every document that lie in a window of the benchmark, and the items concerned."""
    read = spark.read.parquet
    found = contamination(read(f"{folder}/documents.parquet"), read(f"{folder}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
