"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words: a run of spaces and what follows it up to the next space.  No
piece crosses from a letter to a space, so words merge apart from each other.  The
words that a worker has not met yet lie in flat numpy arrays, one symbol a character.
Each round finds the lowest pair rank of every word by a segmented minimum, merges
its occurrences in all words at once, leftmost first, and compacts the arrays.  Words
without a pair left are put out; the rounds end when none remains.

One at a time, the library always merges the best pair, leftmost first.  Merging many
at once gives the same pieces as long as no merge brings forth a pair that is as good
or better; a word stops its round at the first merge that does.

A word of n characters takes at most n rounds.  Words are cut where no piece holds both
characters, and long runs of spaces where their pieces end, so such words stay short.

Rows: a null or empty text has no ids and decodes to an empty text; repeated rows and
columns of other names stay; an empty table gives an empty table; columns named like
an output column are replaced.  A null list of ids decodes to an empty text; an id
outside the vocabulary fails the query.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words remembered in each Python worker, and the longest of them.
CACHE_WORDS = 400_000
CACHE_LENGTH = 64
#: Bytes of text (or numbers of ids), and characters of new words, handled at once.
SLICE = 4_000_000
SPACE = "▁"

_NONE = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_CODE_POINTS = 0x110000
_WORDS = re.compile(" *[^ ]+| +$")


def read_model(path: str) -> dict:
    """What the work needs of a model file, read once by the driver: pieces, their kinds and scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    normal, trained = model.normalizer_spec, model.trainer_spec
    kinds = [p.type for p in model.pieces]
    known = (
        trained.model_type == trained.BPE
        and not normal.precompiled_charsmap
        and not normal.remove_extra_whitespaces
        and normal.add_dummy_prefix
        and normal.escape_whitespaces
        and not trained.treat_whitespace_as_suffix
        and trained.byte_fallback
        and set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
    )
    if not known:
        raise ValueError("known are BPE models with byte fallback, a space put in front, and no other normalizing")
    pieces = [p.piece for p in model.pieces]
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, kind in zip(pieces, kinds) if kind == _NORMAL):
        raise ValueError("a piece goes from a letter to a space")
    return {"pieces": pieces, "kinds": kinds, "scores": [p.score for p in model.pieces], "unknown": trained.unk_surface}


class PairTable:
    """Numbers by pair of symbols, looked up for whole arrays: open addressing, a few probes."""

    def __init__(self, pairs: dict[tuple[int, int], int], missing: int):
        self._shift = 64 - max(4, (4 * len(pairs)).bit_length())
        size = 1 << (64 - self._shift)
        self._keys, self._values = np.full(size, -1, np.int64), np.full(size, missing, np.int32)
        self._mask = size - 1
        if pairs:
            keys = np.array([a << 32 | b for a, b in pairs], np.int64)
            values = np.fromiter(pairs.values(), np.int32, len(pairs))
            slots = self._slots(keys)
            while len(keys):
                # Of those that want a free slot the first takes it; the others go on to the next.
                free = np.flatnonzero(self._keys[slots] < 0)
                _, first = np.unique(slots[free], return_index=True)
                won = free[first]
                self._keys[slots[won]], self._values[slots[won]] = keys[won], values[won]
                rest = np.ones(len(keys), bool)
                rest[won] = False
                keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self._shift)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots = self._slots(keys)
        there = self._keys[slots]
        # An empty slot holds the value for a missing pair.
        values = self._values[slots]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):
            slots[other] = (slots[other] + 1) & self._mask
            there = self._keys[slots[other]]
            values[other] = self._values[slots[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return values


class Merger:
    """Merges words to ids, many words at once."""

    def __init__(self, model: dict):
        pieces, kinds, scores = model["pieces"], model["kinds"], np.array(model["scores"], np.float32)
        self._size = len(pieces)
        ids = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        # Characters without a piece of their own are symbols behind the vocabulary, by code point.
        self._symbol = np.arange(_CODE_POINTS, dtype=np.int64) + self._size
        for p, i in ids.items():
            if len(p) == 1:
                self._symbol[ord(p)] = i
        self._rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        def symbol(part: str) -> int | None:
            return int(self._symbol[ord(part)]) if len(part) == 1 else ids.get(part)

        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                left, right = symbol(p[:cut]), symbol(p[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self._pairs = PairTable(pairs, -1)
        self._together = PairTable({(ord(a), ord(b)): 1 for p in ids for a, b in zip(p, p[1:])}, 0)
        self._run = self._run_length(ids, scores)
        self._byte = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == _BYTE:
                self._byte[int(pieces[i][3:-1], 16)] = i

    @staticmethod
    def _run_length(ids: dict[str, int], scores: np.ndarray) -> int:
        """The length at which runs of spaces may be cut; 0: they may not.

        Runs of spaces that are pieces must all have one score, below all others, and no piece may go on from two
        spaces: then a run merges last and from the left, and only its last space may have gone elsewhere.  If the
        first spaces of a long run grow into the longest piece before any space behind them is touched, that piece
        stays, and the rest merges like a run of its own.
        """
        runs = {len(p): scores[i] for p, i in ids.items() if set(p) == {SPACE} and len(p) > 1}
        others = [scores[i] for p, i in ids.items() if len(p) > 1 and set(p) != {SPACE}]
        if len(set(runs.values())) != 1 or min(others, default=np.inf) <= min(runs.values()):
            return 0
        if any(p.startswith(2 * SPACE) and set(p) != {SPACE} for p in ids):
            return 0
        longest = max(runs)
        parts = [1] * (2 * longest)
        while parts[0] < longest:
            pair = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in runs), None)
            if pair is None:
                return 0
            parts[pair : pair + 2] = [parts[pair] + parts[pair + 1]]
        return longest if parts[1:] == [1] * longest else 0

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined symbol of each pair."""
        joined = self._pairs(left, right)
        return np.where(joined >= 0, self._rank[joined], _NONE), joined

    def _heads(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where a word starts, or a part of one that cannot merge with what is left of it."""
        head = np.ones(len(points), bool)
        head[1:] = self._together(points[:-1], points[1:]) == 0
        head[starts] = True
        if self._run:
            space = points == ord(SPACE)
            within = np.arange(len(points)) - np.maximum.accumulate(np.where(head | ~space, np.arange(len(points)), 0))
            head |= space & (within > 0) & (within % self._run == 0)
        return head

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, end to end, and where each word's begin (one more entry for the end)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=bounds[1:])
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbols = self._merged(self._symbol[points], self._heads(points, bounds[:-1][np.diff(bounds) > 0]))
        places = np.flatnonzero(symbols >= 0)
        symbols = symbols[places]
        unknown = symbols >= self._size
        if not unknown.any():
            return symbols.astype(np.int32), np.searchsorted(places, bounds)
        # A character without a piece becomes the pieces of its bytes.
        encoded = [chr(c - self._size).encode("utf-8") for c in symbols[unknown].tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[unknown] = [len(b) for b in encoded]
        ids = np.repeat(symbols, sizes)
        ids[np.repeat(unknown, sizes)] = self._byte[np.frombuffer(b"".join(encoded), np.uint8)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids.astype(np.int32), ends[np.searchsorted(places, bounds)]

    def _merged(self, symbol: np.ndarray, head: np.ndarray) -> np.ndarray:
        """For each place the symbol that starts there in the end, -1 where none does."""
        out = np.full(len(symbol), -1, np.int64)
        at = np.arange(len(symbol))
        rank, joined = np.full(len(symbol), _NONE, np.int32), np.full(len(symbol), -1, np.int32)
        inner = np.flatnonzero(~head[1:])
        rank[inner], joined[inner] = self._found(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(head)
            sizes = np.diff(starts, append=len(symbol))
            low = np.minimum.reduceat(rank, starts)
            closed = low == _NONE
            if closed.any():
                stays = np.repeat(~closed, sizes)
                out[at[~stays]] = symbol[~stays]
                symbol, at, head, rank, joined = (x[stays] for x in (symbol, at, head, rank, joined))
                low, sizes = low[~closed], sizes[~closed]
                if not len(symbol):
                    break
            lowest = np.repeat(low, sizes)
            p = self._taken(symbol, head, rank, joined, lowest)
            symbol[p] = joined[p]
            stays = np.ones(len(symbol), bool)
            stays[p + 1] = False
            symbol, at, head, rank, joined = (x[stays] for x in (symbol, at, head, rank, joined))
            p = p - np.arange(len(p))
            touched = np.concatenate([p, p[~head[p]] - 1])
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[~head[touched + 1]]
            rank[touched], joined[touched] = self._found(symbol[touched], symbol[touched + 1])
        return out

    def _taken(self, symbol, head, rank, joined, lowest) -> np.ndarray:
        """Places whose pair merges in this round."""
        p = np.flatnonzero(rank == lowest)
        k = np.arange(len(p))
        # Of occurrences that overlap in a chain: the first, the third and so on.
        after = np.zeros(len(p), bool)
        after[1:] = p[1:] == p[:-1] + 1
        p = p[(k - np.maximum.accumulate(np.where(after, 0, k))) % 2 == 0]
        new = joined[p].astype(np.int64)
        # The pairs a merge brings forth, when those left of it are done and those right of it are not.
        left = symbol[p - 1]
        beside = np.flatnonzero(p[1:] == p[:-1] + 2) + 1
        beside = beside[~head[p[beside]]]
        left[beside] = new[beside - 1]
        better = ~head[p] & (self._found(left, new)[0] <= lowest[p])
        right = np.minimum(p + 2, len(symbol) - 1)
        better |= (p + 2 < len(symbol)) & ~head[right] & (self._found(new, symbol[right])[0] <= lowest[p])
        if not better.any():
            return p
        word = np.cumsum(head)[p]
        earlier = np.cumsum(better) - better
        first = np.ones(len(p), bool)
        first[1:] = word[1:] != word[:-1]
        return p[earlier == np.maximum.accumulate(np.where(first, earlier, 0))]


class Codec:
    """Encodes texts and decodes ids in one Python worker."""

    def __init__(self, model: dict):
        self._merger = Merger(model)
        self._known: dict[str, bytes] = {}
        kinds = np.array(model["kinds"])
        texts = []
        for piece, kind in zip(model["pieces"], model["kinds"]):
            if kind == _BYTE:
                texts.append(bytes([int(piece[3:-1], 16)]))
            elif kind == _UNKNOWN:
                texts.append(model["unknown"].encode("utf-8"))
            else:
                texts.append(b"" if kind == _CONTROL else piece.replace(SPACE, " ").encode("utf-8"))
        self._lengths = np.array([len(t) for t in texts], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._control, self._is_byte = kinds == _CONTROL, kinds == _BYTE
        self._leads = np.array([k == _NORMAL and p.startswith(SPACE) for p, k in zip(model["pieces"], model["kinds"])])

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, each without the first of its spaces."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        words = text.split(" ")
        return [w[1:] for w in _WORDS.findall(f" {text}")] if "" in words else words

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        edges = [0, *np.flatnonzero(np.diff(ends // SLICE)) + 1, len(new)]
        for a, b in zip(edges, edges[1:]):
            ids, starts = self._merger([SPACE + w.replace(" ", SPACE) for w in new[a:b]])
            packed, starts = ids.astype("<i4").tobytes(), (4 * starts).tolist()
            self._known.update(zip(new[a:b], [packed[s:e] for s, e in zip(starts, starts[1:])]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and where each text's begin (one more entry for the end)."""
        split = list(map(self.words, texts))
        new = set().union(*split) - self._known.keys()
        if new:
            self._learn(new)
        packed = [b"".join(map(self._known.__getitem__, words)) for words in split]
        if len(self._known) > CACHE_WORDS:
            self._known = {}
        for word in new:
            if len(word) > CACHE_LENGTH:
                self._known.pop(word, None)
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(b) // 4 for b in packed], out=starts[1:])
        return np.frombuffer(b"".join(packed), "<i4"), starts

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each range of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self._lengths)):
            raise ValueError("an id is outside the vocabulary")
        sizes = self._lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        data = self._bytes[np.repeat(self._starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        texts = []
        for first, last in zip(starts[:-1].tolist(), starts[1:].tolist()):
            shown = first
            while shown < last and self._control[ids[shown]]:
                shown += 1
            # The space that encoding put in front goes.
            skipped = 1 if shown < last and self._leads[ids[shown]] else 0
            part = data[ends[first] + skipped : ends[last]]
            try:
                texts.append(part.decode("utf-8"))
            except UnicodeDecodeError:
                texts.append(self._mended(ids[first:last], skipped))
        return texts

    def _mended(self, ids: np.ndarray, skipped: int) -> str:
        """The text of ids whose byte pieces are not all UTF-8: each byte that is not gives U+FFFD."""
        out, run = [], b""
        for i in ids.tolist():
            piece = self._bytes[self._starts[i] : self._starts[i] + self._lengths[i]].tobytes()
            if self._is_byte[i]:
                run += piece
            elif piece:
                out += [utf8_or_replaced(run), piece.decode("utf-8")]
                run = b""
        return "".join([*out, utf8_or_replaced(run)])[skipped:]


def utf8_or_replaced(data: bytes) -> str:
    """UTF-8 decoded character by character; a byte that starts none gives U+FFFD by itself."""
    out, i = [], 0
    while i < len(data):
        size = 1 if data[i] < 0xC0 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            out.append(data[i : i + size].decode("utf-8"))
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        i += size
    return "".join(out)


def _slices(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of rows of about SLICE in all."""
    edges, room = [0], SLICE
    for i, size in enumerate(sizes):
        if size > room and i > edges[-1]:
            edges.append(i)
            room = SLICE
        room -= size
    return list(zip(edges, [*edges[1:], len(sizes)]))


def _mapped(rows: DataFrame, source: str, added: list[T.StructField], model: str, make) -> DataFrame:
    """``rows`` with the columns that ``make(codec, column of source)`` gives for a slice of a batch.

    The driver reads the model file and broadcasts its pieces, a MB or so set by the vocabulary alone.
    """
    shared = rows.sparkSession.sparkContext.broadcast({"model": read_model(model)})
    names = [f.name for f in added]
    kept = rows.drop(*[n for n in names if n != source])
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches):
        # The worker keeps the broadcast value from task to task, and with it the codec and its words.
        state = shared.value
        codec = state.get("codec") or state.setdefault("codec", Codec(state["model"]))
        for batch in batches:
            column = batch.column(source)
            measured = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
            for a, b in _slices(measured(column).fill_null(0).to_pylist()):
                made = make(codec, column.slice(a, b - a))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def _encoded(codec: Codec, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids, starts = codec.encode([t or "" for t in texts.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())), ids, starts


def encode(documents: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with ``ids``: the token ids of their text, without begin or end ids."""
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    return _mapped(documents, text, added, model, lambda codec, texts: [_encoded(codec, texts)[0]])


def decode(encoded: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with ``decoded``: the text that the ids stand for."""

    def make(codec, lists):
        lists = lists.fill_null([])
        starts = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(starts[0], starts[-1] - starts[0]).to_numpy(zero_copy_only=False)
        return [pa.array(codec.decode(values.astype(np.int64), starts - starts[0]), pa.string())]

    return _mapped(encoded, ids, [T.StructField(decoded, T.StringType())], model, make)


def round_trip(documents: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: the documents with ``ids`` and ``decoded``."""

    def make(codec, texts):
        lists, ids, starts = _encoded(codec, texts)
        return [lists, pa.array(codec.decode(ids, starts), pa.string())]

    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return _mapped(documents, text, added, model, make)


def op11_piece_bpe(spark, folder: str) -> DataFrame:
    """Every document encoded by ``piece_bpe_32k.model`` and decoded again."""
    import public_tokenizers

    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    made = round_trip(documents, public_tokenizers.path("piece_bpe_32k.model"))
    return made.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
