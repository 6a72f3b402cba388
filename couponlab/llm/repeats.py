"""Removal of repeated byte strings by sorting suffixes bucket by bucket.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a
smaller id.  Two suffixes that agree for LENGTH bytes also agree, a few bytes on, at
two places that both belong to a difference cover: for any two places there is a step
below the period that brings both into it.  So:

1. Documents are dealt by ranges of their id into blocks of bounded size, so that an
   earlier block holds smaller ids only.
2. The suffixes at cover places are sorted by their first ``LENGTH - PERIOD + 1`` bytes,
   a bucket to a task.  What comes back to a block is, for each cover suffix, whether
   another document has the same.  Only suffixes within a period before such a place
   can repeat; the blocks are written again with a bit for each.
3. Those are sorted by their first LENGTH bytes, ``TURNS`` groups of buckets one after
   the other; each turn drops its shuffle before the next begins.  What comes back is
   whether the suffix starts in an earlier block.

Strings stand for their order by fingerprints, and one bit answers for each, so no
text travels but the blocks.  Repeats within a block are settled in the block, by their
bytes.  The cover's fingerprints have 32 bits beside the bucket and only narrow the
search; those of step 3, between blocks, have 96.  Each block sends a string once, so a
passage that all documents share sends one fingerprint a block.

Rows: null and empty texts have no bytes and lose none; rows with a null id lose
nothing and take nothing from others; rows of one id take nothing from each other and
stay in one block, which must fit a task as the longest document must; repeated rows
each keep a line; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from couponlab.llm.hashing import Powers, mixed, prefix_sums, ranges
from couponlab.llm.tables import partitions, settled, written

LENGTH = 50
#: A perfect difference cover: every step modulo the period is a difference of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes that two strings of LENGTH still share at the place where the cover meets both.
COVER_LENGTH = LENGTH - PERIOD + 1
#: Bytes of a block, and of the text whose suffixes share a bucket, about.
BLOCK = 1 << 20
BUCKET = 1 << 22
#: Groups of buckets that are sorted one after the other.
TURNS = 3
#: Bytes of text to a task, about; more text gets more tasks.
TASK = 1 << 26
#: Places whose fingerprints are worked out together; what that takes stays in the processor's cache.
_PIECE = 1 << 14

_BLOCKS = "block bigint, ids array<bigint>, sizes array<bigint>, data binary"
_SENT = "bucket bigint, block bigint, strings binary"
_ANSWERS = "block bigint, bucket bigint, bits binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


class Block:
    """Texts of one block, joined, and the strings in them."""

    def __init__(self, ids, sizes, data: bytes, buckets: int, powers: Powers):
        self.ids, self.sizes = np.asarray(ids, np.int64), np.asarray(sizes, np.int64)
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self._shift = np.uint64(64 - (buckets.bit_length() - 1))
        self._powers = powers
        self._sums = prefix_sums(self.data, powers)
        # The eight bytes from each place on, without a copy.
        self._words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) if len(data) > 7 else np.zeros(0, "<u8")

    @cached_property
    def document(self) -> np.ndarray:
        """The document of each place."""
        return np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def whole(self, size: int) -> np.ndarray:
        """Whether a string of ``size`` bytes from each place ends within its document."""
        short = np.minimum(self.sizes, size - 1)
        return np.repeat(np.tile([True, False], len(short)), np.column_stack([self.sizes - short, short]).ravel())

    def prints(self, places: np.ndarray, size: int) -> np.ndarray:
        out = np.empty(len(places), np.uint64)
        for at in range(0, len(places), _PIECE):
            piece = places[at : at + _PIECE]
            out[at : at + _PIECE] = ranges(self._sums, piece, piece + size, self._powers)
        return out

    def alike(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the strings of LENGTH bytes at two places are the same bytes, pair by pair."""
        same = np.ones(len(one), bool)
        for step in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            same &= self._words[one + step] == self._words[other + step]
        return same

    def ordered(self, places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Strings of LENGTH bytes in order: the order, their fingerprints, where a new string begins; if bytes were alike.

        Neighbours in the order are compared byte by byte.  Only if different strings share a fingerprint are they
        told apart by the 32 further bits.
        """
        order = np.argsort(prints)
        ordered = prints[order]
        new = _new(ordered)
        again = np.flatnonzero(~new)
        exact = bool(self.alike(places[order[again - 1]], places[order[again]]).all())
        if not exact:
            second = self.second_prints(places)
            order = np.lexsort((second, prints))
            ordered = prints[order]
            new = _new(ordered) | _new(second[order])
        return order, ordered, new, exact

    def strings(self, places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Strings of LENGTH bytes, each once, in order: fingerprint, a place; which a place has; its first document, by bytes.

        If different strings share a fingerprint, the documents are found from the strings themselves.
        """
        if not len(places):
            return prints, places, places, places
        order, ordered, new, exact = self.ordered(places, prints)
        starts = np.flatnonzero(new)
        which = np.empty(len(places), np.int64)
        which[order] = np.cumsum(new) - 1
        if exact:
            first = np.minimum.reduceat(self.document[places[order]], starts)[which]
        else:
            rows = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[places]
            string = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
            lowest = np.full(len(places), len(self.sizes))
            np.minimum.at(lowest, string, self.document[places])
            first = lowest[string]
        return ordered[starts], places[order[starts]], which, first

    def runs(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the sorted fingerprints fill, in order, and where each begins, with the end behind."""
        own = (prints >> self._shift).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        return own[starts], np.r_[starts, len(own)]

    def cover(self) -> np.ndarray:
        """Cover places with a whole string before their document ends."""
        strings = np.maximum(self.sizes - COVER_LENGTH + 1, 0)
        counts = strings // PERIOD * len(COVER) + np.searchsorted(COVER, strings % PERIOD)
        most = int(counts.max(initial=0)) // len(COVER) + 1
        steps = (PERIOD * np.arange(most)[:, None] + np.array(COVER)).ravel()
        before = np.cumsum(counts) - counts
        return steps[np.arange(counts.sum()) - np.repeat(before, counts)] + np.repeat(self.ends - self.sizes, counts)

    def shared(self, places: np.ndarray, prints: np.ndarray, answers: pa.StructArray | None) -> np.ndarray:
        """The places whose fingerprint another document has, here or, by the answers, elsewhere."""
        order = np.argsort(prints)
        ordered = prints[order]
        new = _new(ordered)
        which = np.cumsum(new) - 1
        found = _answered(self, ordered[new], answers)
        again = np.flatnonzero(~new)
        # Where a fingerprint has two documents, two neighbours in the order differ.
        differ = self.document[places[order[again - 1]]] != self.document[places[order[again]]]
        found[which[again[differ]]] = True
        return places[order[found[which]]]

    def suspects(self, shared: np.ndarray) -> np.ndarray:
        """Whether a string of LENGTH bytes from a place may repeat: one of the shared cover places is in its first period."""
        near = np.zeros(len(self.data), bool)
        near[shared] = True
        # A whole string is longer than the period, so the place found is in the same document.
        _spread(near[::-1], PERIOD)
        return near & self.whole(LENGTH)

    def second_prints(self, places: np.ndarray) -> np.ndarray:
        """32 more bits for the string at each place, from hashes of its halves."""
        half = LENGTH // 2
        a, b = self.prints(places, half), self.prints(places + half, half)
        return (mixed(a * np.uint64(3) + (b ^ (b >> np.uint64(17)))) >> np.uint64(32)).astype("<u4")

    def results(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each document: bytes removed, runs removed, digest of what is kept.  ``gone``: places of strings that go."""
        removed = np.zeros(len(self.data), bool)
        removed[gone] = True
        _spread(removed, LENGTH)
        filled = self.sizes > 0
        heads, tails = (self.ends - self.sizes)[filled], self.ends[filled] - 1
        begins, stops = removed.copy(), removed.copy()
        begins[1:] &= ~removed[:-1]
        stops[:-1] &= ~removed[1:]
        begins[heads], stops[tails] = removed[heads], removed[tails]
        begins, stops = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        document = np.searchsorted(self.ends, begins, side="right")
        lost, runs = np.zeros(len(self.sizes), np.int64), np.bincount(document, minlength=len(self.sizes))
        np.add.at(lost, document, stops - begins)
        kept = self.data[~removed]
        ends = np.cumsum(self.sizes - lost)
        digests = [hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip([0, *ends.tolist()], ends.tolist())]
        return lost, runs, digests


def _new(ordered: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _spread(marks: np.ndarray, width: int) -> None:
    """Mark the places behind each mark too, ``width`` with its own."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        marks[step:] |= marks[:-step]
        reach += step


def _pack(batches):
    """Blocks from texts that come in order of id; a block ends between two ids."""
    block, size, ids, texts = TaskContext.get().partitionId() << 32, 0, [], []

    def done():
        sizes = [len(t) for t in texts]
        columns = [[block], [ids], [sizes], [b"".join(texts)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.large_binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays([*arrays[:3], arrays[3].cast(pa.binary())], names=["block", "ids", "sizes", "data"])

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            if ids and size >= BLOCK and key != ids[-1]:
                yield done()
                block, size, ids, texts = block + 1, 0, [], []
            texts.append(text.as_py().encode("utf-8"))
            ids.append(key)
            size += len(texts[-1])
    if ids:
        yield done()


def _blocks(batches, buckets: int, powers: Powers | None = None):
    """The cells of each row, lists as arrays, and its block."""
    powers = powers or Powers()
    for batch in batches:
        for row in range(batch.num_rows):
            cells = {c: batch.column(c)[row] for c in batch.schema.names}
            cells = {c: v.values if isinstance(v, pa.ListScalar) else v.as_py() for c, v in cells.items()}
            yield cells, Block(cells["ids"].to_numpy(), cells["sizes"].to_numpy(), cells["data"], buckets, powers)


def _answered(block: Block, prints: np.ndarray, answers: pa.StructArray | None) -> np.ndarray:
    """The bits of all buckets put together, in order of fingerprint."""
    (filled, bounds), out = block.runs(prints), np.zeros(len(prints), bool)
    if answers is not None:
        runs = np.searchsorted(filled, answers.field("bucket").to_numpy())
        for low, high, bits in zip(bounds[runs].tolist(), bounds[runs + 1].tolist(), answers.field("bits").to_pylist()):
            out[low:high] = np.unpackbits(np.frombuffer(bits, np.uint8), count=high - low)
    return out


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "strings"])


def _send_cover(buckets: int):
    """The cover strings of each block by bucket, 4 bytes each."""
    shift = np.uint64(max(0, 32 - (buckets.bit_length() - 1)))

    def run(batches):
        for cells, block in _blocks(batches, buckets):
            places = block.cover()
            prints = np.sort(block.prints(places, COVER_LENGTH))
            prints = prints[_new(prints)]
            filled, bounds = block.runs(prints)
            short = ((prints >> shift) & np.uint64(0xFFFFFFFF)).astype("<u4")
            yield _sent([(b, cells["block"], short[i:j].tobytes()) for b, i, j in zip(filled.tolist(), bounds, bounds[1:])])

    return run


def _mark_suspects(buckets: int):
    """The blocks with a bit for each byte: whether the string there may repeat."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            marks = []
            for cells, block in _blocks([batch], buckets, powers):
                places = block.cover()
                shared = block.shared(places, block.prints(places, COVER_LENGTH), cells["near"])
                marks.append(np.packbits(block.suspects(shared)).tobytes())
            kept = [batch.column(c) for c in ("block", "ids", "sizes", "data")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(marks, pa.binary())], names=["block", "ids", "sizes", "data", "suspects"])

    return run


def _suspects(cells: dict, block: Block) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(cells["suspects"], np.uint8), count=len(block.data)).view(bool))


def _send_suspects(buckets: int, turn: int):
    """The suspect strings of this turn's buckets, 12 bytes each."""

    def run(batches):
        for cells, block in _blocks(batches, buckets):
            places = _suspects(cells, block)
            prints = block.prints(places, LENGTH)
            own = prints >> np.uint64(64 - (buckets.bit_length() - 1))
            mine = own - own // np.uint64(TURNS) * np.uint64(TURNS) == turn
            places, prints = places[mine], prints[mine]
            order, ordered, new, _ = block.ordered(places, prints)
            prints = ordered[new]
            second, whole = block.second_prints(places[order[new]]), prints.astype("<u8")
            filled, bounds = block.runs(prints)
            cut = zip(filled.tolist(), bounds, bounds[1:])
            yield _sent([(b, cells["block"], whole[i:j].tobytes() + second[i:j].tobytes()) for b, i, j in cut])

    return run


def _by_block(table: pa.Table, width: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Blocks in order, what each sent, and how many strings that is."""
    blocks, strings = table["block"].to_numpy(), table["strings"].to_pylist()
    order = np.argsort(blocks, kind="stable")
    return blocks[order], [strings[i] for i in order], np.array([len(strings[i]) // width for i in order], np.int64)


def _answers(blocks: np.ndarray, counts: np.ndarray, bucket: int, bits: np.ndarray) -> pa.Table:
    packed = [np.packbits(part).tobytes() for part in np.split(bits, np.cumsum(counts)[:-1])]
    arrays = [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int64()), pa.array(packed, pa.binary())]
    return pa.table(arrays, names=["block", "bucket", "bits"])


def _sort_cover(table: pa.Table) -> pa.Table:
    """Sort the cover strings of one bucket; a bit is set where another block has the string too."""
    blocks, strings, counts = _by_block(table, 4)
    values = np.frombuffer(b"".join(strings), "<u4")
    order = np.argsort(values)
    same = values[order][1:] == values[order][:-1]
    bits = np.zeros(len(values), bool)
    bits[order] = np.r_[False, same] | np.r_[same, False]
    return _answers(blocks, counts, table["bucket"][0].as_py(), bits)


def _sort_suspects(table: pa.Table) -> pa.Table:
    """Sort the suspect strings of one bucket; a bit is set where an earlier block has the string too."""
    blocks, strings, counts = _by_block(table, 12)
    first = np.frombuffer(b"".join(s[: 8 * n] for s, n in zip(strings, counts)), "<u8")
    second = np.frombuffer(b"".join(s[8 * n :] for s, n in zip(strings, counts)), "<u4")
    block = np.repeat(np.arange(len(blocks)), counts)
    order = np.argsort(first)
    same = first[order][1:] == first[order][:-1]
    if np.any(same & (second[order][1:] != second[order][:-1])):
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    starts = np.flatnonzero(np.r_[True, ~same])
    earliest = np.minimum.reduceat(block[order], starts)
    bits = np.zeros(len(first), bool)
    bits[order] = block[order] > np.repeat(earliest, np.diff(np.r_[starts, len(order)]))
    return _answers(blocks, counts, table["bucket"][0].as_py(), bits)


def _finish(buckets: int):
    def run(batches):
        for cells, block in _blocks(batches, buckets):
            places = _suspects(cells, block)
            prints, _, which, first = block.strings(places, block.prints(places, LENGTH))
            earlier = _answered(block, prints, cells["earlier"])
            # Ids come in order, so the first document with a string has the smallest id.
            within = block.ids[first] < block.ids[block.document[places]]
            columns = (block.ids, block.sizes, *block.results(places[earlier[which] | within]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _joined(blocks: DataFrame, answers: DataFrame, name: str, tasks: int) -> DataFrame:
    """The blocks with their answers, a short list of bit strings each."""
    own = answers.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return blocks.repartition(tasks, "block").join(own, "block", "left")


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document its bytes, the bytes and runs removed, and the digest of the rest, under the id's name ``doc_id``."""
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    tasks = max(partitions(spark), size // TASK)
    ordered = known.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")
    buckets = 1 << (max(TURNS * tasks, size // BUCKET) - 1).bit_length()

    def with_suspects() -> DataFrame:
        blocks = written(ordered.mapInArrow(_pack, _BLOCKS), "blocks")
        sent = blocks.mapInArrow(_send_cover(buckets), _SENT)
        near = written(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_sort_cover, _ANSWERS), "cover-answers")
        return _joined(blocks, near, "near", tasks).mapInArrow(_mark_suspects(buckets), _BLOCKS + ", suspects binary")

    marked = settled(spark, "marked-blocks", with_suspects)
    earlier = None
    for turn in range(TURNS):
        sent = marked.mapInArrow(_send_suspects(buckets, turn), _SENT)
        answers = written(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_sort_suspects, _ANSWERS), "suspect-answers")
        earlier = answers if earlier is None else earlier.unionByName(answers)
    found = _joined(marked, earlier, "earlier", tasks).mapInArrow(_finish(buckets), RESULT)
    without = rows.where("doc_id is null").select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )
    return found.unionByName(without)


def op10_suffix_dedup(spark, folder: str) -> DataFrame:
    """Bytes of every document that repeat 50 bytes of a document with a smaller id."""
    return remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
