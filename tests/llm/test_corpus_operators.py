"""Decontamination, near duplicates, repeats, quality, language and neighbours against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from couponlab.llm import components, hashing, language, neighbours_scan, quality, repeats, simhash, winnowing

FOLDER = "/root/testdata/sf0.001"


def texts_of(spark, table: str, key: str = "doc_id") -> list[tuple]:
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key, "text").collect()]


def lowered(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination ----------------------------------------------------------


def contaminated_by_hand(documents, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    windows: dict[tuple, set] = {}
    for item, text in items:
        own = words(text)
        width = min(10, len(own))
        for at in range(len(own) - width + 1 if own else 0):
            windows.setdefault(tuple(own[at : at + width]), set()).add(str(item))
    out = {}
    for document, text in documents:
        own, hit, names = words(text), set(), set()
        for width in {len(w) for w in windows}:
            for at in range(len(own) - width + 1):
                if owners := windows.get(tuple(own[at : at + width])):
                    hit |= set(range(at, at + width))
                    names |= owners
        out[document] = (len(own), len(hit), sorted(names))
    return out


def found_windows(frame):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in frame.collect()}


def test_winnowing_finds_every_window(spark):
    draw, words = random.Random(1), "a b c D e é 7".split()
    some = lambda n: [draw.choice(["  , ", " ", "-"]).join(draw.choice(words) for _ in range(n)) for _ in range(1)][0]
    documents = [(i, some(draw.choice([0, 3, 12, 40, 300]))) for i in range(100)] + [(900, None), (901, "!!")]
    items = [(i, some(draw.choice([0, 2, 5, 9, 10, 11, 14]))) for i in range(50)] + [(77, None), (3, some(12))]
    frame = spark.createDataFrame([(*d, 1) for d in documents], "doc_id bigint, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert found_windows(winnowing.contamination(frame, bench)) == contaminated_by_hand(documents, items)
    assert winnowing.contamination(frame, bench.limit(0)).where("contaminated").count() == 0
    assert winnowing.contamination(frame.limit(0), bench).count() == 0
    kept = {r["doc_id"] for r in winnowing.clean(frame, bench).collect()}
    assert kept == {d for d, v in contaminated_by_hand(documents, items).items() if not v[1]}


def test_winnowing_on_the_tables(spark):
    read = spark.read.parquet
    got = winnowing.contamination(read(f"{FOLDER}/documents.parquet"), read(f"{FOLDER}/benchmark.parquet"))
    want = contaminated_by_hand(texts_of(spark, "documents"), texts_of(spark, "benchmark", "item_id"))
    assert found_windows(got) == want and any(v[1] for v in want.values())


# --- near duplicates ----------------------------------------------------------


def print_by_hand(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def groups_by_hand(prints: dict) -> dict:
    names, values = list(prints), np.array(list(prints.values()), np.uint64)
    label = {n: n for n in names}
    changed = True
    while changed:
        changed = False
        for i, name in enumerate(names):
            near = min(label[names[j]] for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4))
            if near < label[name]:
                label[name], changed = near, True
    return label


def test_fingerprints_and_groups(spark):
    documents = [*texts_of(spark, "documents"), (5000, None), (5001, ""), (5002, "One two"), (5003, "one  TWO")]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in simhash.near_duplicates(frame).collect()}
    prints = {d: print_by_hand(t) for d, t in documents}
    assert {d: r["fingerprint"] % 2**64 for d, r in found.items()} == prints
    assert {d: r["component_id"] for d, r in found.items()} == groups_by_hand(prints)
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [4096, 16])
def test_links_of_dense_and_far_prints(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    draw = random.Random(4)
    seeds = [draw.getrandbits(64) for _ in range(6)]
    values = {draw.getrandbits(64) for _ in range(150)}
    for seed in seeds:
        for _ in range(60):
            value = seed
            for bit in draw.sample(range(64), draw.randrange(4)):
                value ^= 1 << bit
            values.add(value)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"))
    labels = {r["node"] % 2**64: r["label"] for r in components.components(found).collect()}
    want = groups_by_hand({v: v for v in values})
    same: dict = {}
    for value, group in want.items():
        same.setdefault(group, set()).add(value)
    got: dict = {}
    for value in values:
        got.setdefault(labels.get(value, ("alone", value)), set()).add(value)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same.values()))


def test_enough_blocks_for_any_number():
    assert [simhash.blocks_for(n, 4) for n in (0, 1, 10**5, 10**7, 10**9)] == [6, 6, 6, 7, 8]
    for blocks in (6, 7, 8):
        assert {bin(m % 2**64).count("1") >= 64 * (blocks - 4) // blocks - blocks for m in simhash.block_masks(blocks, 4)} == {True}


def test_chains_become_one_component(spark):
    draw, order = random.Random(3), list(range(200))
    draw.shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:])] + [(900, 901), (901, 900), (900, 900), (None, 3)]
    found = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(200)}, 900: 900, 901: 900}


def test_one_of_each_group_stays(spark):
    documents = spark.createDataFrame(
        [(4, "a b c d e"), (2, "A B c d e"), (2, "A B c d e"), (None, "a b c d e"), (None, "z y x w v"), (9, None)], "doc_id bigint, text string"
    )
    assert sorted((r["doc_id"] or -1) for r in simhash.keep_one(documents).collect()) == [-1, 2, 9]


def test_bitmap_follows_the_number_of_hashes():
    assert [winnowing._bits_for(n) for n in (0, 1, 1 << 19, (1 << 19) + 1, 10_000_000, 1 << 40)] == [23, 23, 23, 24, 28, 29]


# --- repeats ------------------------------------------------------------------


def repeats_by_hand(documents):
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in documents]
    for document, text in data:
        for i in range(len(text) - 49):
            first[text[i : i + 50]] = min(document, first.get(text[i : i + 50], document))
    out = {}
    for document, text in data:
        gone = bytearray(len(text))
        for i in range(len(text) - 49):
            if first[text[i : i + 50]] < document:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[document] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_cover_meets_every_step():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_only_filled_buckets_are_visited():
    block = repeats.Block([1], [4], b"abcd", 1 << 40, repeats.Powers())
    prints = np.array([5, 9, 1 << 30, (1 << 64) - 1], np.uint64)
    filled, bounds = block.runs(prints)
    assert filled.tolist() == [0, 64, (1 << 40) - 1] and bounds.tolist() == [0, 2, 3, 4]
    filled, bounds = block.runs(prints[:0])
    assert filled.tolist() == [] and bounds.tolist() == [0]


@pytest.mark.parametrize("block, bucket, task", [(300, 1 << 22, 1 << 26), (1 << 20, 1 << 22, 1 << 26), (300, 16, 2000)])
def test_repeated_bytes_go(spark, monkeypatch, block, bucket, task):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "BUCKET", bucket)
    monkeypatch.setattr(repeats, "TASK", task)
    draw = random.Random(3)
    pool = ["".join(draw.choice("abcé ") for _ in range(draw.choice([30, 49, 50, 51, 70, 400]))) for _ in range(12)]
    noise = lambda: "".join(draw.choice("xyzü") for _ in range(draw.randrange(60)))
    documents = [(i, "".join(draw.choice(pool) if draw.random() < 0.5 else noise() for _ in range(draw.randrange(8)))) for i in range(90)]
    documents += [(300, None), (301, ""), (302, "a" * 500), (303, "a" * 60)]
    frame = spark.createDataFrame([(*d, 0) for d in [*documents, (None, pool[5])]], "doc_id bigint, text string, n_bytes int")
    found = [tuple(r) for r in repeats.remove_repeats(frame).collect()]
    assert {r[0]: r[1:] for r in found if r[0] is not None} == repeats_by_hand(documents)
    assert [r[2] for r in found if r[0] is None] == [0] and len(found) == len(documents) + 1
    assert repeats.remove_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_strings_of_one_fingerprint_are_compared_by_bytes(spark, monkeypatch, bits):
    """With fingerprints of a few bits only, nothing but repeated bytes goes within a block."""
    whole, mask = repeats.ranges, np.uint64((1 << 64) - (1 << (64 - bits)))
    monkeypatch.setattr(repeats, "ranges", lambda *given: whole(*given) & mask)
    draw = random.Random(8)
    pool = ["".join(draw.choice("abc") for _ in range(70)) for _ in range(5)]
    documents = [(i, "".join(draw.choice([draw.choice(pool), "".join(draw.choice("xyz") for _ in range(40))]) for _ in range(3))) for i in range(12)]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string")
    # One range of ids, so one block.
    monkeypatch.setattr(repeats, "partitions", lambda session: 1)
    found = [tuple(r) for r in repeats.remove_repeats(frame).collect()]
    assert {r[0]: r[1:] for r in found} == repeats_by_hand(documents)


def test_block_tells_strings_of_one_fingerprint_apart():
    text = b"p" * 50 + b"q" * 50 + b"p" * 50
    block = repeats.Block([1, 2, 3], [50, 50, 50], text, 16, repeats.Powers())
    places = np.array([0, 50, 100])
    prints, at, which, first = block.strings(places, np.zeros(3, np.uint64))
    assert len(prints) == 2 and which[0] == which[2] != which[1] and first.tolist() == [0, 1, 0]
    assert block.alike(places[:1], places[2:]).all() and not block.alike(places[:1], places[1:2]).any()


@pytest.mark.parametrize("sizes", [[], [0, 0], [3], [0, 29, 30, 0, 31, 49, 50, 51, 0, 180, 400, 70, 0]])
def test_places_of_a_block_match_a_plain_loop(sizes):
    draw = random.Random(len(sizes))
    data = bytes(draw.choice(b"ab") for _ in range(sum(sizes)))
    block = repeats.Block(list(range(len(sizes))), sizes, data, 16, repeats.Powers())
    spans = [(sum(sizes[:i]), sum(sizes[: i + 1])) for i in range(len(sizes))]
    cover = [p for a, b in spans for p in range(a, b) if (p - a) % repeats.PERIOD in repeats.COVER and p + repeats.COVER_LENGTH <= b]
    assert block.cover().tolist() == cover
    shared = sorted(draw.sample(cover, len(cover) // 9))
    near = [any(p <= c < p + repeats.PERIOD for c in shared) and p + 50 <= b for a, b in spans for p in range(a, b)]
    assert block.suspects(np.array(shared, np.int64)).tolist() == near
    # Whole documents too, so that runs of two documents touch.
    strings = [p for a, b in spans for p in range(a, b - 49) if draw.random() < 0.02 or a == spans[-3][0]]
    lost, runs, digests = block.results(np.array(strings, np.int64))
    for (a, b), n, r, digest in zip(spans, lost, runs, digests, strict=True):
        gone = [any(p <= i < p + 50 for p in strings if a <= p < b) for i in range(a, b)]
        kept = bytes(x for x, g in zip(data[a:b], gone) if not g)
        starts = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (n, r, digest) == (sum(gone), starts, hashlib.sha256(kept).hexdigest())


def test_documents_without_strings_keep_their_lines(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 5), (3, "")], "doc_id bigint, text string")
    found = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(frame).collect())
    assert found == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (3, 10, 0, 0)]


def test_powers_are_not_made_anew_for_each_longer_block():
    powers = repeats.Powers()
    up, down = powers.up_to(1 << 20)
    longer, _ = powers.up_to((1 << 20) + 50_000)
    assert np.shares_memory(up, longer) and longer[: 1 << 20].tolist() == up.tolist()
    assert (up * down == 1).all()


def test_sending_the_cover_costs_little_more_than_its_fingerprints():
    data = np.random.default_rng(5).integers(97, 123, 1 << 20, np.uint8).tobytes()
    cells = {"block": [0], "ids": [list(range(256))], "sizes": [[4096] * 256], "data": [data]}
    batch = pa.RecordBatch.from_pydict(cells)
    places = np.flatnonzero(np.isin(np.arange(len(data) - 50) % repeats.PERIOD, repeats.COVER))

    def least():
        powers = hashing.Powers()
        sums = hashing.prefix_sums(np.frombuffer(data, np.uint8), powers)
        np.sort(hashing.ranges(sums, places, places + repeats.COVER_LENGTH, powers))

    def sending():
        assert sum(b.num_rows for b in repeats._send_cover(256)([batch])) == 256

    def cost(run):
        taken = []
        for _ in range(7):
            began = time.process_time()
            run()
            taken.append(time.process_time() - began)
        return min(taken)

    assert cost(sending) < 2 * cost(least)


# --- quality ------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    scored = quality.op9_quality(spark, FOLDER.replace("0.001", "0.01"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = scored.collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    unseen = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in unseen)
    assert len(unseen) > 50 and right / len(unseen) > 0.95


def test_scalar_scores_are_those_of_the_vectors():
    """The score from one number a bucket equals the softmax over the averaged features of the bag."""
    draw = np.random.default_rng(0)
    model = np.append(draw.normal(size=quality.BUCKETS), 0.3)
    for text in ("", None, "a a a b", "Één woord", "x" * 5000):
        own = quality.bag(text)
        mean = sum(model[b] * n for b, n in own.items()) / sum(own.values())
        assert quality.Scorer(model)(text) == pytest.approx(1 / (1 + np.exp(-(mean + model[-1]))))


def test_quality_of_odd_rows(spark):
    documents = spark.createDataFrame([(1, None, 9.0), (1, "", 9.0), (None, "x", 9.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([(1, None), (2, 5)], "doc_id bigint, quality int")
    rows = quality.score(documents, none).collect()
    assert [(r["score"], r["predicted"]) for r in rows] == [(0.5, 1)] * 3
    assert quality.score(documents.limit(0), none).count() == 0


def test_quality_learns_from_the_whole_sample(spark):
    texts = {i: f"w{i} a a b" for i in range(4500)}
    documents = spark.createDataFrame([*texts.items(), (7, "again"), (7, None)], "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id bigint, quality int")
    usable = [i for i in texts if zlib.crc32(str(i).encode()) % 5]
    alone = documents.where("doc_id != 7")
    bags = quality.training_bags(alone, labels, "doc_id", "text", quality.SAMPLE)
    assert len(bags) == len(set(usable) - {7}) > 3000

    def plain(buckets, shares, label):
        return sorted(zip(buckets.tolist(), np.round(shares, 5).tolist())), label

    def by_hand(i):
        own = quality.bag(texts[i])
        return plain(np.array(list(own)), np.array(list(own.values()), np.float32) / sum(own.values()), i % 2)

    assert sorted(plain(*b) for b in bags) == sorted(by_hand(i) for i in usable if i != 7)
    assert len(quality.training_bags(documents, labels, "doc_id", "text", 10)) == 10


# --- language -----------------------------------------------------------------


def test_language_follows_the_evidence(spark):
    pages, documents = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("pages", "documents"))
    rows = language.identify(pages, documents).collect()
    assert len(rows) == pages.count()
    assert np.mean([r["language"] == r["declared"] for r in rows]) > 0.97
    assert all(0 < r["probability"] <= 1 for r in rows)
    odd = spark.createDataFrame(
        [(1, None, None), (2, "", "<html>"), (3, "http://a.example.com/x", "<html lang='fr-CA'><p>ok"), (3, "http://a.example.com/x", "<html lang='fr-CA'><p>ok")],
        "page_id bigint, url string, html string",
    )
    found = language.identify(odd, documents).collect()
    assert sorted((r["page_id"], r["declared"], r["host"]) for r in found) == [(1, "", ""), (2, "", ""), (3, "fr", "a.example.com"), (3, "fr", "a.example.com")]
    assert language.identify(odd.limit(0), documents).count() == 0
    assert language.identify(odd, documents.limit(0)).count() == 0


# --- neighbours ---------------------------------------------------------------


def nearest_by_hand(rows: list[tuple[int, list[float]]], k: int) -> dict[int, list[tuple[int, float]]]:
    return {
        q: sorted(((-float(np.dot(v, w)), other) for other, w in rows if other != q))[:k]
        for q, v in rows
        if q % 20 == 0
    }


def test_neighbours_and_recall(spark):
    vectors = spark.read.parquet(f"{FOLDER.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in vectors.collect()]
    want, found = nearest_by_hand(rows, 20), {}
    for r in neighbours_scan.nearest(vectors, lambda key: key % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert set(found) == set(want) and all(f == sorted(f) and len(f) == 20 for f in found.values())
    hits = [len({i for _, i in want[q]} & {i for _, i in found[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    same = [1.0, 2.0, 2.0]
    rows = [(i, same) for i in range(45)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, [1.0, None, 1.0]), (103, [1.0, float("nan"), 1.0])]
    rows += [(104, [float("inf"), 1.0, 1.0]), (105, [1.0]), (106, []), (None, same), (60, [10.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    found: dict = {}
    for r in neighbours_scan.nearest(frame, lambda key: key % 20 == 0, k=20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {0, 20, 40, 60}
    assert [(i, s) for _, i, s in sorted(found[20])] == [(60, 10.0)] + [(i, 9.0) for i in [*range(19)]]
    few = spark.createDataFrame([(0, same), (1, same), (2, [-1.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in neighbours_scan.nearest(few, lambda key: key % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 9.0), (0, 2, 2, -1.0)]
    assert neighbours_scan.nearest(few.limit(0), lambda key: key % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", [[1e3], [1e5], [1e30], [1e3, 1e30, 1e200, 1e-200]])
def test_neighbours_beside_great_norms(spark, norms):
    draw = np.random.default_rng(3)
    units = draw.normal(size=(2000, 32))
    units /= np.linalg.norm(units, axis=1)[:, None]
    # The first rows, of odd ids and no queries, get the norms.
    units[: len(norms)] *= np.array(norms)[:, None]
    rows = [(2 * i + 1 if i < len(norms) else 10 * i, v) for i, v in enumerate(units)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    want, found = nearest_by_hand(rows, 20), {}
    for r in neighbours_scan.nearest(frame, lambda key: key % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    assert np.mean([len({i for _, i in want[q]} & set(found.get(q, {}))) / 20 for q in want]) >= 0.9
    great = {2 * i + 1 for i, n in enumerate(norms) if n > 1}
    assert all({i for _, i in want[q]} & great == set(found[q]) & great for q in want)


def test_products_beyond_doubles(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [2e200, 0.0]), (3, [-1e200, 0.0]), (4, [1e200, -1e300]), (5, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = neighbours_scan.nearest(frame, lambda key: key == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, np.inf), (1, np.inf), (4, np.inf), (5, 1e200), (3, -np.inf)]


def shown_by_regex(page: str) -> str:
    return html.unescape(re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", page))


def test_visible_text_in_one_pass():
    draw = random.Random(3)
    parts = ["<script>", "</script >", "<STYLE a>", "</style>", "<!--", "-->", "<", ">", "<b>", "a", " ", "&lt;", "<scripts>", "<!-->"]
    for _ in range(3000):
        page = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        assert language.visible_text(page) == shown_by_regex(page), page
    started = time.monotonic()
    for part in ("<script>", "<!--", "<", "<style ", "</script"):
        language.visible_text(part * (1_000_000 // len(part)))
    assert time.monotonic() - started < 5


def fused_by_hand(pages: list[tuple], langs: list[str], model: np.ndarray) -> list[tuple]:
    """The whole fusion in plain Python; pages are (id, host, declared, html)."""
    n = len(langs)
    counts = [language.trigram_counts(language.visible_text(p[3] or "")) for p in pages]
    logs = [model @ c * language.TEMPER for c in counts]
    guess = [int(v.argmax()) if c.any() else None for v, c in zip(logs, counts)]
    facts = [{"host": h, "domain": ".".join(h.split(".")[-2:]) if "." in h else "", "suffix": h.split(".")[-1], "declared": d} for _, h, d, _ in pages]
    tally = {by: Counter((f[by], g) for f, g in zip(facts, guess)) for by in ("host", "domain", "suffix", "declared")}
    out = []
    for row, fact, log, own in zip(pages, facts, logs, guess):
        def others(by):
            return np.array([tally[by][fact[by], i] - (own == i) for i in range(n)], float)

        every = np.array([guess.count(i) - (own == i) for i in range(n)], float)
        values = {by: len({f[by] for f in facts}) for by in ("suffix", "declared")}
        score = np.array(log)
        for by in ("declared", "suffix"):
            score += np.log((others(by) + language.UNSEEN) / (every + language.UNSEEN * (values[by] + 1)))
        prior = (every + language.UNSEEN) / (every.sum() + language.UNSEEN * n)
        for by in ("domain", "host"):
            prior = (others(by) + prior * language.LEAN) / (others(by).sum() + language.LEAN)
        score += np.log(prior)
        share = 1 / np.exp(score - score.max()).sum()
        out.append((row[0], langs[int(score.argmax())], share, None if own is None else langs[own]))
    return out


def test_fusion_against_plain_python(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    langs, model = language.text_model(documents)
    texts = {r["lang"]: r["text"] for r in documents.where("length(text) > 300").select("lang", "text").collect()}
    draw, pages = random.Random(4), []
    for i in range(300):
        lang = draw.choice(sorted(texts))
        host = draw.choice(["a.example.org", "b.example.org", f"c.{lang}", "plain", ""])
        declared = draw.choice([lang, "", "en"])
        start = draw.randrange(100)
        body = draw.choice([texts[lang][start : start + 200], texts[lang][start : start + 12], "", "<p></p>"])
        pages.append((i, host, declared, f'<html lang="{declared}"><b>{body}</b></html>' if declared else body))
    # Pages without text on a host of English ones do not vote.
    pages += [(1000 + i, "en.host.org", "", f"<p>{texts['en'][i : i + 200]}</p>") for i in range(20)]
    pages += [(2000 + i, "en.host.org", "", ["", None, "<p></p>", "ab"][i % 4]) for i in range(201)]
    rows = [(i, f"http://{h}/x" if h else None, page) for i, h, _, page in pages]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in language.identify(table, documents).collect()}
    for key, lang, share, text_language in fused_by_hand(pages, langs, model):
        row = found[key]
        assert row["text_language"] == text_language
        assert row["language"] == lang and abs(row["probability"] - share) < 1e-9, (key, row)
        if key >= 1000:
            assert lang == "en"


def test_pages_of_unclosed_html_tags(spark):
    pages = spark.createDataFrame([(1, None, "<html " * 100_000), (2, None, '<html x><html lang="de">')], "page_id bigint, url string, html string")
    started = time.monotonic()
    declared = {r["page_id"]: r["d"] for r in pages.select("page_id", language.declared_in(F.col("html")).alias("d")).collect()}
    assert declared == {1: "", 2: ""} and time.monotonic() - started < 10
