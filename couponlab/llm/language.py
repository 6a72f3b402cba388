"""Language of web pages by fusing evidence in Bayes' way.

For each language the logarithms of four things are added: the likelihood of the
visible text (hashed byte trigrams, learned from documents of known language), of the
language the markup declares, of the address suffix, and the prior of the host.  The
last three come from grouped counts over all pages, under the language that the text
alone suggests.  The prior of a host leans on that of its domain, and this on that of
all pages; a page's own count is taken out first.

Rows: a page without text (null, empty, tags only) has no text language, is no vote in
any count and gets what the rest says; of a page's ``html`` tags the first counts; a null
or hostless address has host and suffix ``''``; a page without a declaration has the
declaration ``''``; repeated rows each keep a line; without documents of known language
there is no language to choose and the result is empty, as for an empty table.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from couponlab.llm.tables import ROW, numbered, written

#: Buckets of the hashed trigrams.
BUCKETS = 1 << 15
#: Weight of text evidence, since neighbouring trigrams say the same thing thrice.
TEMPER = 1 / 3
#: Pages that the wider level counts for in the narrower one, and what an unseen value counts for.
LEAN = 5.0
UNSEEN = 0.5

_TAG = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)
_CLOSING = {kind: re.compile(rf"</{kind}\s*>", re.I) for kind in ("script", "style")} | {"!--": re.compile("-->")}


def visible_text(page: str) -> str:
    """The page without tags, comments, scripts and styles, in one pass: what was not found once is not looked for again."""
    shown, at, missing = [], 0, set()
    while tag := _TAG.search(page, at):
        kind, stop = (tag[1] or tag[2] or "").lower(), 0
        if kind and kind not in missing:
            closing = _CLOSING[kind].search(page, tag.end())
            if closing:
                stop = closing.end()
            else:
                missing.add(kind)
        stop = stop or page.find(">", tag.start()) + 1
        if not stop:
            break
        shown.append(page[at : tag.start()])
        at = stop
    return html.unescape(" ".join([*shown, page[at:]]))


def trigram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the byte trigrams of the lower-cased text."""
    b = np.frombuffer(" ".join(text.lower().split()).encode("utf-8"), np.uint8).astype(np.uint32)
    mixed = (b[:-2] * np.uint32(65599) + b[1:-1]) * np.uint32(65599) + b[2:] if len(b) > 2 else b[:0]
    return np.bincount((mixed * np.uint32(2654435761)) >> np.uint32(32 - 15), minlength=BUCKETS)


def text_model(documents: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the logarithm of each bucket's share in each; one number a language and bucket."""

    def count(batches):
        sums = {}
        for batch in batches:
            for value, own in zip(batch.column(0), batch.column(1).to_pylist()):
                sums[own] = sums.get(own, 0) + trigram_counts(value.as_py())
        langs = list(sums)
        counts = pa.array([sums[one].tolist() for one in langs], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), counts], names=["lang", "counts"])

    known = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    parts = known.mapInArrow(count, "lang string, counts array<bigint>").select("lang", F.posexplode("counts").alias("bucket", "n"))
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).where("n > 0").toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    table = np.full((len(langs), BUCKETS), UNSEEN)
    if langs:
        place = {one: i for i, one in enumerate(langs)}
        table[[place[x] for x in rows["lang"].to_pylist()], rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def declared_in(page: Column) -> Column:
    text = F.coalesce(page, F.lit(""))
    # Only the first tag is searched, so a page of unclosed tags takes linear time.
    place = F.instr(F.lower(text), "<html")
    tag = F.when(place > 0, F.substring_index(F.substr(text, place), ">", 1)).otherwise("")
    return F.lower(F.regexp_extract(tag, r"""(?i)^<html\b.*?\blang\s*=\s*["']?([A-Za-z]+)""", 1))


def _votes(i: int) -> Column:
    """Pages whose text suggests this language; pages without text suggest none."""
    return F.count_if(F.col("guess") == i).cast("double")


def _counted(evidence: DataFrame, by: str, n: int) -> DataFrame:
    """Pages of each language under each value of ``by``, as one array."""
    sums = [_votes(i).alias(f"n{i}") for i in range(n)]
    return evidence.groupBy(by).agg(*sums).select(by, F.array(*[f"n{i}" for i in range(n)]).alias(f"of_{by}"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _leaning(counts: Column, wider: Column) -> Column:
    """Shares of the counts, with the wider level's shares counting for LEAN pages."""
    whole = _sum(counts) + LEAN
    return F.zip_with(counts, wider, lambda c, w: (c + w * LEAN) / whole)


def identify(pages: DataFrame, documents: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """For each page ``language``, its ``probability``, and ``text_language``, ``declared``, ``suffix`` and ``host`` behind it."""
    spark = pages.sparkSession
    langs, model = text_model(documents)
    n = len(langs)
    if not n:
        columns = f"{key} {dict(pages.dtypes)[key]}, language string, probability double, text_language string, declared string, suffix string, host string"
        return spark.createDataFrame([], columns)
    shared = spark.sparkContext.broadcast(model)
    host = host_of(F.col(url))
    rows = numbered(
        pages,
        F.col(key).alias("key"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"),
        F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"),
        declared_in(F.col(page)).alias("declared"),
        F.coalesce(F.col(page), F.lit("")).alias("page"),
    )

    def read(batches):
        for batch in batches:
            values, guesses = [], []
            for page_text in batch.column("page"):
                counts = trigram_counts(visible_text(page_text.as_py()))
                values.append((shared.value @ counts * TEMPER).tolist())
                guesses.append(int(np.argmax(values[-1])) if counts.any() else None)
            kept = [c for c in batch.schema.names if c != "page"]
            made = [pa.array(values, pa.list_(pa.float64())), pa.array(guesses, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "text_log", "guess"])

    kind = dict(pages.dtypes)[key]
    schema = f"{ROW} bigint, key {kind}, host string, domain string, suffix string, declared string, text_log array<double>, guess int"
    evidence = written(rows.mapInArrow(read, schema), "page-evidence")
    informed = evidence
    for by in ("host", "domain", "suffix", "declared"):
        # Counts as a table of their own: a join of two tables lets adaptive execution split a very common host.
        informed = informed.join(written(_counted(evidence, by, n), f"pages-by-{by}"), by)
    total = evidence.agg(*[_votes(i).alias(f"n{i}") for i in range(n)]).first()
    values = {by: evidence.select(by).distinct().count() for by in ("suffix", "declared")}
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce((i == F.col("guess")).cast("double"), F.lit(0.0)))
    others = lambda counts: F.zip_with(counts, "own", lambda c, o: c - o)
    every = others(F.array(*[F.lit(float(t or 0)) for t in total]))

    def likelihood(by: str) -> Column:
        """Share of this value among the other pages of each language."""
        return F.zip_with(others(F.col(f"of_{by}")), "every", lambda c, e: F.log((c + UNSEEN) / (e + UNSEEN * (values[by] + 1))))

    placed = informed.withColumn("own", own).withColumn("every", every)
    even = F.transform("every", lambda e: (e + UNSEEN) / (_sum(F.col("every")) + UNSEEN * n))
    placed = placed.withColumn("even", even).withColumn("by_domain", _leaning(others(F.col("of_domain")), F.col("even")))
    placed = placed.withColumn("prior", _leaning(others(F.col("of_host")), F.col("by_domain")))
    parts = [F.col("text_log"), likelihood("declared"), likelihood("suffix"), F.transform("prior", lambda p: F.log(p))]
    fused = parts[0]
    for part in parts[1:]:
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    scored = placed.withColumn("fused", fused).withColumn("best", F.array_max("fused"))
    share = F.lit(1.0) / _sum(F.transform("fused", lambda x: F.exp(x - F.col("best"))))
    names = F.array(*[F.lit(x) for x in langs])
    return scored.select(
        F.col("key").alias(key),
        F.get(names, (F.array_position("fused", F.col("best")) - 1).cast("int")).alias("language"),
        share.alias("probability"),
        F.get(names, F.col("guess")).alias("text_language"),
        "declared",
        "suffix",
        "host",
    )


def op6_language_id(spark, folder: str) -> DataFrame:
    """The language of every page; texts of all documents of known language are what is learned from."""
    return identify(spark.read.parquet(f"{folder}/pages.parquet"), spark.read.parquet(f"{folder}/documents.parquet"))
