"""SentencePiece BPE against the library, whitening against numpy, divergences against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from couponlab.llm import piece_bpe, source_divergence, whitening

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- pieces -------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(piece_bpe.read_model(MODEL))


def odd_texts() -> list[str | None]:
    draw = random.Random(5)
    points = [chr(draw.choice([draw.randrange(0xD800), draw.randrange(0xE000, 0x110000)])) for _ in range(300)]
    letters = points + list(" '\n\t a1!sdmt▁  ") * 10
    texts = ["".join(draw.choice(letters) for _ in range(60)) for _ in range(100)]
    for alphabet in ("ab", "=-", "aeinst ", "0123456789abcdef", " a"):
        texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(200))) for _ in range(60)]
    runs = [" " * n + rest for n in (1, 15, 16, 17, 31, 32, 33, 48, 2001) for rest in ("", "the", "1", "\n")]
    plain = [None, "", "a▁b", "\x00a", "ﬁ①", "x" * 3001, "ab" * 2000, "<s>a</s><unk><0x41>", "é é", "a" + " " * 50 + "b"]
    return [*texts, *runs, *plain]


def test_pieces_equal_the_library(spark, library):
    texts = odd_texts()
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    documents = spark.createDataFrame([*rows, rows[3], (None, "again", None, None)], "doc_id bigint, text string, decoded string, ids array<int>")
    made = piece_bpe.round_trip(documents, MODEL).collect()
    assert len(made) == len(texts) + 2
    for row in made:
        expected = library.encode(row["text"] or "")
        assert row["ids"] == expected, row["text"]
        assert row["decoded"] == library.decode(expected)


def test_pieces_of_documents(spark, library):
    found = {r["doc_id"]: r for r in piece_bpe.op11_piece_bpe(spark, FOLDER).collect()}
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(found) == len(documents)
    for row in documents:
        ids = library.encode(row["text"] or "")
        made = found[row["doc_id"]]
        assert made["n_tokens"] == len(ids)
        assert made["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert made["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_decoding_of_any_ids(codec, library):
    draw = random.Random(7)
    lists = [[draw.randrange(3, 500) for _ in range(draw.randrange(12))] for _ in range(400)]
    lists += [[], [1], [1, 264, 2], [0, 264], [1, 0], [3 + 0xE2, 3 + 0x96], [3 + 0xC3, 3 + 0xA9, 264], [28705, 28705]]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    made = codec.decode(np.array([i for x in lists for i in x], np.int64), starts)
    assert made == [library.decode(x) for x in lists]


def test_ids_out_of_range_fail(codec):
    with pytest.raises(ValueError):
        codec.decode(np.array([32000]), np.array([0, 1]))


def test_encode_and_decode_apart_and_empty(spark, library):
    documents = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id bigint, text string")
    encoded = piece_bpe.encode(documents, MODEL)
    assert [r["decoded"] for r in piece_bpe.decode(encoded, MODEL).orderBy("doc_id").collect()] == ["two words", ""]
    none = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert piece_bpe.decode(none, MODEL).head()["decoded"] == ""
    assert piece_bpe.round_trip(documents.limit(0), MODEL).collect() == []


def test_long_words_take_little_time(codec, library):
    draw = random.Random(9)
    for text in (" " * 300_000, "a" * 300_000, "".join(draw.choice("etaoin") for _ in range(50_000))):
        ids, _ = codec.encode([text])
        assert ids.tolist() == library.encode(text)


def test_merges_that_bring_forth_better_pairs():
    """A vocabulary whose joined pieces may rank above their parts, against one merge at a time."""
    draw = random.Random(11)
    for _ in range(60):
        pieces = {"".join(draw.choice("ab") for _ in range(draw.randrange(2, 6))) for _ in range(12)}
        pieces = ["a", "b", *sorted(pieces)]
        scores = [float(-draw.randrange(6)) for _ in pieces]
        merger = piece_bpe.Merger({"pieces": pieces, "kinds": [1] * len(pieces), "scores": scores})
        score = dict(zip(pieces, scores))
        words = ["".join(draw.choice("ab") for _ in range(draw.randrange(1, 25))) for _ in range(20)]
        ids, starts = merger(words)
        for word, a, b in zip(words, starts, starts[1:]):
            parts = list(word)
            while True:
                joined = [(-score[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in score]
                if not joined:
                    break
                i = min(joined)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert [pieces[i] for i in ids[a:b]] == parts, (word, score)


# --- whitening ----------------------------------------------------------------


def whitened_by_hand(x: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    return centred @ vectors[:, :components] / np.sqrt(values[:components]), values


def test_whitening_of_embeddings(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in r["embedding"]] for r in rows])
    expected, values = whitened_by_hand(x, 32)
    made = whitening.op12_whitening(spark, FOLDER).toPandas()
    assert len(made) == 32 * len(rows)
    table = made.pivot(index="vec_id", columns="component", values="whitened").loc[[r["vec_id"] for r in rows]].to_numpy()
    assert np.allclose(table * np.sign((table * expected).sum(0)), expected, atol=1e-8)
    shares = made.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, values[:32] / values.sum(), rtol=1e-10)
    deviations = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    assert (made.groupby("vec_id")["deviation"].first().loc[[r["vec_id"] for r in rows]].to_numpy() == deviations).all()
    assert (made["n"] == len(rows)).all() and made["identity_error"].max() < 1e-9


def test_odd_vectors(spark):
    draw = np.random.default_rng(3)
    sound = draw.normal(size=(40, 3)).round(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(sound)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 0.0], [1e30, 0.0, 0.0], [1.0], [1.0, 2.0]]
    again = [(0, sound[0].tolist(), "y"), (None, sound[1].tolist(), "z")]
    table = spark.createDataFrame([*rows, *again, *((100 + i, v, "o") for i, v in enumerate(odd))], "vec_id bigint, embedding array<double>, whitened string")
    vectors = whitening.integer_vectors(table)
    fitted = whitening.fit(vectors)
    assert fitted.n == 42
    x = np.floor(64 * np.vstack([sound, sound[:2]])).astype(int) + 1_000_000
    expected, values = whitened_by_hand(x, 3)
    made = whitening.transform(vectors, fitted).collect()
    assert len(made) == 42 and {r["vec_id"] for r in made} == {*range(40), None}
    first = np.array([r["whitened"] for r in made if r["vec_id"] == 7])[0]
    assert np.allclose(np.abs(first), np.abs(expected[7]), atol=1e-9)
    assert np.allclose(fitted.variances, values, rtol=1e-10)
    empty = whitening.integer_vectors(table.limit(0))
    assert whitening.fit(empty) is None


def test_directions_without_variance(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(10)]
    vectors = whitening.integer_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    fitted = whitening.fit(vectors)
    for row in whitening.transform(vectors, fitted).collect():
        assert row["whitened"][0] is not None and row["whitened"][1:] == [None, None]
    assert whitening.identity_error(vectors, fitted) < 1e-12


def test_merging_over_many_partitions(spark):
    draw = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(400, 5)) * [1, 1, 5, 20, 20])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(40)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        vectors = whitening.integer_vectors(table)
        fitted = whitening.fit(vectors)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows])
    assert fitted.n == 400 and fitted.sums == x.sum(0).tolist()
    assert np.allclose(fitted.variances, whitened_by_hand(x, 5)[1], rtol=1e-10)


def test_deviation_beyond_64_bits():
    fitted = whitening.Whitening(3, [10**15, 0], np.eye(2), np.ones(2), 2.0)
    x = np.array([[1, 2], [10**15, 0]])
    exact = [(3 - 10**15) ** 2 + 36, (2 * 10**15) ** 2]
    assert fitted.deviations(x) == [None if e >= 1 << 63 else e for e in exact]


def test_spectrum_updates_equal_the_scatter():
    draw = np.random.default_rng(5)
    tables = [
        draw.normal(size=(300, 8)) * draw.random(8) * 50,
        np.repeat(draw.normal(size=(5, 8)), 20, 0),
        np.eye(8)[draw.integers(0, 8, 200)] * 7,
        np.ones((20, 8)),
        draw.integers(-1, 2, (100, 8)) * 1e-3 + np.array([1e6, 0, 0, 0, 0, 0, 0, 0]),
    ]
    for rows in tables:
        for block in (1, 7, 64):
            held = whitening.Spectrum(8)
            for i in range(0, len(rows), block):
                held.add(rows[i : i + block])
            centred = rows - rows.mean(0)
            scatter = centred.T @ centred
            scale = max(1e-12, np.abs(scatter).max())
            assert np.abs((held.vectors * held.values) @ held.vectors.T - scatter).max() < 1e-9 * scale + 1e-7
            assert np.abs(held.vectors.T @ held.vectors - np.eye(8)).max() < 1e-12


def test_secular_roots_between_poles():
    draw = np.random.default_rng(6)
    for gap in (1.0, 1e-6, 1e-12):
        d = np.cumsum(draw.random(12) * gap + gap / 10)
        z = draw.normal(size=12) * 10.0 ** -draw.integers(0, 6, 12)
        origin, off = whitening.secular_roots(d, z, 0.7)
        roots = origin + off
        assert (roots >= d - 1e-15).all() and (roots[:-1] <= d[1:] + 1e-15).all()
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + 0.7 * np.outer(z, z)), rtol=1e-12)


# --- divergences --------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergences_by_hand(rows: list[tuple], least: int) -> set[tuple]:
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(TERM.findall((text or "").translate(SMALL)))
        documents[lang or ""].update(found.keys())
        counts[lang or "", source or ""].update(found)
    out = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        groups = {g[1]: c for g, c in counts.items() if g[0] == lang}

        def share(of: Counter) -> dict:
            total = sum(of[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 5) // total for t in kept}

        whole = share(sum(groups.values(), Counter()))
        shares = {s: share(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(shares[s][t] - whole[t], t) for t in kept if groups[s][t] > 0 and shares[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def corpus() -> list[tuple]:
    draw = random.Random(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Über", "ÜBER", "日本", "été"]
    rows = []
    for i in range(400):
        source = draw.choice(["hot", "hot", "hot", "b", "c", None, "é"])
        text = " ".join(draw.choice(words[: 40 if source == "hot" else 124]) for _ in range(draw.randrange(40)))
        rows.append((draw.choice(["en", "en", "de", None]), source, text.upper() if i % 3 == 0 else text))
    rows += [("en", "hot", None), ("xx", "one", "rare"), ("xx", "two", None), ("xx", None, ""), ("yy", "alone", "1 2 3"), rows[0], rows[0]]
    return rows


def test_divergences(spark, monkeypatch):
    rows = corpus()
    table = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "lang string, source string, text string, n bigint, term string")
    order = ["lang", "source", "part", "item", "value", "rank"]
    expected = divergences_by_hand(rows, 30)
    assert {tuple(r) for r in source_divergence.divergences(table).select(*order).collect()} == expected
    # Many spills, shards and blocks give the same.
    monkeypatch.setattr(source_divergence, "ENTRIES", 20)
    monkeypatch.setattr(source_divergence, "SHARD_ENTRIES", 50)
    monkeypatch.setattr(source_divergence, "BLOCK", 2)
    monkeypatch.setattr(source_divergence, "SLICE", 10)
    assert {tuple(r) for r in source_divergence.divergences(table.repartition(7)).select(*order).collect()} == expected
    assert source_divergence.divergences(table.limit(0)).collect() == []


def test_terms_of_long_texts(monkeypatch):
    text = "Ab ab-cd Éé  日本x1y " * 50
    expected = Counter(t.encode() for t in TERM.findall(text.translate(SMALL)))
    assert source_divergence.terms_of(text) == expected
    monkeypatch.setattr(source_divergence, "SLICE", 3)
    assert source_divergence.terms_of(text) == expected
    assert source_divergence.terms_of("") == Counter()


def test_shares_of_great_counts():
    counts, totals = np.array([[9 * 10**9 + 5, 10**15]]), np.array([10**10, 10**15 + 7])
    assert source_divergence.shares(counts, totals).tolist() == [[1 + 10**9 * c // t for c, t in zip([9 * 10**9 + 5, 10**15], [10**10, 10**15 + 7])]]
