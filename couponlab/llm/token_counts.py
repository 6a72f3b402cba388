"""Token counts of whole texts under a byte-level BPE vocabulary.

A pre-token starts as one symbol a byte.  The adjacent pairs wait in a heap by
(rank, place); the pair of lowest rank is popped, joined in a linked list, and
the two new pairs are pushed.  The count is the number of symbols at the start
less the number of merges; token ids are never put together.  A pre-token of n
bytes takes O(n log n) time and O(n) memory, however long it is.

Rows: a null or empty text counts 0 tokens; repeated rows and columns of other
names stay as they are; an empty table gives an empty table.  Columns named like
an output column are replaced.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponlab.llm.splitting import Splitter
from couponlab.llm.word_cache import TwoGenerations

#: Words remembered in each Python worker.
CACHE_WORDS = 1_000_000
#: Stands behind the last symbol; no pair has it.
_END = (1 << 20) - 1
#: The part of a heap entry that holds the place; the rank is above it.
_PLACE = (1 << 40) - 1
OUTPUT = ("n_bytes", "n_tokens", "over_limit")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_rules(path: str) -> dict:
    """What counting needs of a ``tokenizers`` file, read once by the driver: pairs by rank, special strings, splitting."""
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("the counter knows byte-level vocabularies without normalizer or added space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take white space or whole words are not known")
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {
        "vocab": spec["model"]["vocab"],
        "pairs": pairs,
        "special": [t["content"] for t in spec["added_tokens"]],
        "pattern": PATTERN,
    }


def merges_made(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """How many merges a pre-token takes.  ``pairs``: left symbol times 2^20 plus right symbol, to (rank, joined symbol)."""
    n = len(symbols)
    symbols.append(_END)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop = pairs.get, heapq.heappush, heapq.heappop
    # The merge now valid for the pair that starts here; None: none, or the symbol is gone.
    valid = [get(a << 20 | b) for a, b in zip(symbols, symbols[1:])]
    heap = [found[0] << 40 | i for i, found in enumerate(valid) if found]
    heapq.heapify(heap)
    made = 0
    while heap:
        entry = pop(heap)
        i = entry & _PLACE
        found = valid[i]
        if found is None or found[0] != entry >> 40:
            continue
        made += 1
        j = following[i]
        k = following[i] = following[j]
        joined = symbols[i] = found[1]
        valid[j] = None
        found = valid[i] = get(joined << 20 | symbols[k])
        if found:
            push(heap, found[0] << 40 | i)
        if k < n:
            before[k] = i
        h = before[i]
        if h >= 0:
            found = valid[h] = get(symbols[h] << 20 | joined)
            if found:
                push(heap, found[0] << 40 | h)
    return made


class Counter:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, rules: dict):
        letters = byte_letters()
        vocab = rules["vocab"]
        first = [0] * 256
        for letter, byte in letters.items():
            first[byte] = vocab[letter]
        pairs = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(rules["pairs"])}

        def count(word: str) -> int:
            symbols = [first[b] for b in word.encode("utf-8")]
            n = len(symbols)
            return n - merges_made(symbols, pairs)

        self._of = TwoGenerations(count, CACHE_WORDS)
        self._split = Splitter(rules["pattern"])
        special = [s for s in rules["special"] if s]
        self._special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def _plain(self, text: str) -> int:
        return sum(map(self._of.__getitem__, self._split(text)))

    def __call__(self, text: str) -> int:
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts = self._special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(documents: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """The documents with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of their text.

    The driver reads the vocabulary file and broadcasts its rules, a few MB set by the vocabulary alone.
    """
    rules = documents.sparkSession.sparkContext.broadcast({"rules": read_rules(vocabulary)})
    kept = documents.drop(*OUTPUT)
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*kept.schema.fields, *added])

    def count(batches):
        # The worker keeps the broadcast value from task to task, and with it the counter and its words.
        state = rules.value
        counter = state.get("counter") or state.setdefault("counter", Counter(state["rules"]))
        for batch in batches:
            n_bytes, n_tokens = [], []
            for value in batch.column(text):
                word = value.as_py() or ""
                n_bytes.append(len(word.encode("utf-8")))
                n_tokens.append(counter(word))
            columns = [*batch.columns, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_bytes", "n_tokens"])

    counted = kept.mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op2_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document under ``byte_bpe_50k.json``."""
    import public_tokenizers

    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(documents, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
