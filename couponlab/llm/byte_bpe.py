"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has a bucket for each merge rank; a bucket holds places of the linked
list of parts.  Which buckets are filled is kept in a bitmap of 256-bit words, with
a bitmap over its words above it.  Find-first-set on both levels gives the lowest
rank in a few steps whatever the length of the pre-token.
Entries whose pair has changed since are stale and are skipped.

Rows: a null or empty text has no tokens and decodes to no bytes; repeated rows
and other columns stay; an empty table gives an empty table.  Columns named like
an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.llm.splitting import Splitter
from couponlab.llm.word_cache import TwoGenerations

#: Pre-tokens remembered in each Python worker.
CACHE_WORDS = 800_000
#: Bits of a bitmap word, as a power of two.
_SHIFT = 8
_WORD = 1 << _SHIFT
_MASK = _WORD - 1
#: Bits of the lower words, and of the one above them.
_BIT = [1 << i for i in range(1 << 12)]
#: Bits of the right token in the key of a pair.
_PAIR = 24


class RankQueue:
    """Places by rank, lowest rank first, leftmost place first within a rank."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        # A bit for each rank, and in ``top`` a bit for each word that has some.
        self.words = [0] * (max(1, ranks) + _WORD - 1 >> _SHIFT)
        self.top = 0

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heapq.heappush(bucket, place)
            return
        self.buckets[rank] = [place]
        self.words[rank >> _SHIFT] |= _BIT[rank & _MASK]
        self.top |= 1 << (rank >> _SHIFT)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        first = bits & -bits
        rank = word << _SHIFT | first.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits ^ first
        if bits == first:
            self.top &= self.top - 1
        return rank, bucket[0]


class Merges:
    """The merges of a rank file: a token for each byte, and the token that two adjacent ones make.

    Tokens are known by their rank.  Every split of a token in two tokens is a pair that makes it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.whole = ranks
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.size = max(ranks.values()) + 1
        if self.size > _WORD * len(_BIT):
            raise ValueError("more ranks than the queue has bits for")
        self.pairs = {}
        get = ranks.get
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = get(token[:cut])
                if left is not None:
                    right = get(token[cut:])
                    if right is not None:
                        self.pairs[left << _PAIR | right] = rank


def encode_piece(piece: bytes, merges: Merges, queue: RankQueue) -> list[int]:
    """Ids of one pre-token.  ``queue`` is empty before and after; its push and pop are written out here."""
    whole = merges.whole.get(piece)
    if whole is not None:
        return [whole]
    ids, get, bit = list(map(merges.first.__getitem__, piece)), merges.pairs.get, _BIT
    n = len(ids)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    buckets, words, top = queue.buckets, queue.words, 0
    # The rank now valid for the pair that starts here; None: none, or the part is gone.
    pair = [get(a << _PAIR | b) for a, b in zip(ids, ids[1:])]
    pair.append(None)
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> _SHIFT
                words[word] |= bit[rank & _MASK]
                top |= bit[word]
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        lowest = bits & -bits
        rank = (word << _SHIFT) + lowest.bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heapq.heappop(bucket)
        else:
            (i,) = bucket
            del buckets[rank]
            words[word] = bits ^ lowest
            if bits == lowest:
                top ^= bit[word]
        if pair[i] != rank:
            continue
        j = following[i]
        k = following[i] = following[j]
        ids[i] = rank
        pair[j] = new = None
        if k < n:
            before[k] = i
            new = get(rank << _PAIR | ids[k])
            if new is not None:
                if new in buckets:
                    heapq.heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    word = new >> _SHIFT
                    words[word] |= bit[new & _MASK]
                    top |= bit[word]
        pair[i] = new
        h = before[i]
        if h >= 0:
            new = get(ids[h] << _PAIR | rank)
            if pair[h] != new:
                pair[h] = new
                if new is not None:
                    if new in buckets:
                        heapq.heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        word = new >> _SHIFT
                        words[word] |= bit[new & _MASK]
                        top |= bit[word]
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = following[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Codec:
    """Encodes texts and decodes ids in one Python worker.  Ids travel as packed little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        merges = Merges(ranks)
        queue = RankQueue(merges.size)

        def packed(word: str) -> bytes:
            return array("I", encode_piece(word.encode("utf-8"), merges, queue)).tobytes()

        self._of = TwoGenerations(packed, CACHE_WORDS)
        self._split = Splitter(pattern)
        tokens = [b""] * merges.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self._lengths = np.array([len(t) for t in tokens], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self._of.__getitem__, self._split(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        sizes = self._lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(total)].tobytes()


def _codec(shared, pattern: str) -> Codec:
    """The worker keeps the broadcast value from task to task, and with it the codec and its words."""
    state = shared.value
    return state.get("codec") or state.setdefault("codec", Codec(state["ranks"], pattern))


def _mapped(rows: DataFrame, source: str, added: list[T.StructField], vocabulary: str, pattern: str, make) -> DataFrame:
    """``rows`` with the columns that ``make(codec, value of source)`` gives for each row."""
    shared = rows.sparkSession.sparkContext.broadcast({"ranks": read_ranks(vocabulary)})
    names = [f.name for f in added]
    kept = rows.drop(*[n for n in names if n != source])
    schema = T.StructType([*kept.schema.fields, *added])
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches):
        codec = _codec(shared, pattern)
        for batch in batches:
            made = [make(codec, value.as_py()) for value in batch.column(source)]
            columns = [pa.array([m[i] for m in made], kinds[f.dataType.simpleString()]) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def encode(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with ``ids``: the token ids of the text, packed as little-endian unsigned 32-bit integers."""
    added = [T.StructField(ids, T.BinaryType())]
    return _mapped(documents, text, added, vocabulary, pattern, lambda codec, value: (codec.encode(value or ""),))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with ``decoded``: the bytes that the packed ids stand for."""
    added = [T.StructField(decoded, T.BinaryType())]
    return _mapped(encoded, ids, added, vocabulary, pattern, lambda codec, value: (codec.decode(value or b""),))


def tokens(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents with ``ids`` (packed), ``n_tokens`` and ``lossless``: whether the ids decode to the text's bytes."""

    def make(codec, value):
        packed = codec.encode(value or "")
        return packed, len(packed) // 4, codec.decode(packed) == (value or "").encode("utf-8")

    added = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("lossless", T.BooleanType()),
    ]
    return _mapped(documents, text, added, vocabulary, pattern, make)


def round_trip(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: the documents with ``n_tokens`` and digests of the ids and of the decoded bytes."""

    def make(codec, value):
        packed = codec.encode(value or "")
        decoded = codec.decode(packed)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()

    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return _mapped(documents, text, added, vocabulary, pattern, make)


def op5_byte_bpe(spark, folder: str) -> DataFrame:
    """Every document encoded by ``byte_bpe_50k.tiktoken`` and decoded again."""
    import public_tokenizers

    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    made = round_trip(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
