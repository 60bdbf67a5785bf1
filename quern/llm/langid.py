"""Language of web pages: text likelihoods, declared language and host priors, fused by Bayes' rule."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_blocks, stash, table

#: Labelled documents a language that the text model is fitted on, about; chosen by a hash of the id.
SAMPLE = 2000
#: Trigrams are counted by a hash of this many bits.
HASH_BITS = 16
#: Trigrams of a text overlap and repeat, so their joint likelihood counts as that of EVIDENCE independent ones at most.
EVIDENCE = 50.0
#: Pseudo-counts: of a uniform language for all pages, of all pages for a suffix, of the suffix for a host, of any declaration for a language.
GLOBAL_MASS, SUFFIX_MASS, HOST_MASS, DECLARED_MASS = 1.0, 10.0, 5.0, 1.0

#: Bytes of html that are parsed and scored at once.
BLOCK_BYTES = 1 << 20

#: What hides all up to its end, and the ends.
_HIDING = re.compile(r"(?i)<(?:(script|style|noscript|template|head)\b|!--)")
_END = {x: re.compile(rf"(?i)</{x}\s*>") for x in ("script", "style", "noscript", "template", "head")} | {"": re.compile("-->")}
_TAG = re.compile(r"(?s)<[^>]*>")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")
_HOST = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)")
#: What can hide or end the search for the html element, and the element itself; then its attributes one by one.
_OPENING = re.compile(r"(?i)<(?:(!--)|(script|style|title)\b|(body)\b|html(?=[\s/>]))")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+")
_CLOSED = {x: re.compile(f"(?i)</{x}\\b") for x in ("script", "style", "title")}
_PRIMARY = re.compile(r"[\"']?\s*([A-Za-z]{2,3})")
_SPLIT = re.compile(r"[\W\d_]+")


def visible_text(html: str) -> str:
    """The text without comments, tags, entities and what scripts, styles, templates and the head hide; a blank stands for each.

    One pass forward: what is open without an end hides nothing, and its end is sought once, not at every opening, so a
    page of any length and make takes time in proportion.
    """
    shown, at, start, endless = [], 0, 0, set()
    while found := _HIDING.search(html, start):
        kind = (found[1] or "").lower()
        end = None if kind in endless or kind not in _END else _END[kind].search(html, found.end())
        if end is None:
            endless.add(kind)
            start = found.start() + 1
        else:
            shown += [html[at : found.start()], " "]
            at = start = end.end()
    text = "".join([*shown, html[at:]])
    tags = text.rfind(">") + 1  # beyond it no tag has an end
    return _ENTITY.sub(" ", _TAG.sub(" ", text[:tags]) + text[tags:])


def trigrams(text: str) -> np.ndarray:
    """Hashes of the letter trigrams of the lower-cased text; words are set apart by one blank."""
    points = np.frombuffer(f" {_SPLIT.sub(' ', text.lower())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
    return ((mixed * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in ((x["lang"], x["text"]) for block in byte_blocks(iter([batch]), "text", BLOCK_BYTES) for x in block.to_pylist()):
            held = totals.setdefault(lang, np.zeros(1 << HASH_BITS, np.int64))
            held += np.bincount(trigrams(text), minlength=1 << HASH_BITS)
    for lang, held in totals.items():
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["lang", "gram", "n"])


class TextModel:
    """Log-probabilities of hashed trigrams, a row for each language."""

    def __init__(self, langs: list[str], log_p: np.ndarray) -> None:
        self.langs, self.log_p = langs, log_p

    def log_likelihoods(self, text: str) -> np.ndarray:
        """Of the text in each language, tempered to EVIDENCE trigrams; zeros for a text without letters."""
        grams = trigrams(text)
        if len(grams) <= 1 or not self.langs:
            return np.zeros(len(self.langs))
        if len(grams) > 1 << HASH_BITS:  # no more columns at once than there are hashes
            at, n = np.unique(grams, return_counts=True)
            return (self.log_p[:, at] @ n.astype(np.float64)) * (EVIDENCE / len(grams))
        return self.log_p[:, grams].sum(1, dtype=np.float64) * min(1.0, EVIDENCE / len(grams))


def fit(docs: DataFrame, sample: int = SAMPLE) -> TextModel:
    """Fit on about `sample` documents of each language, the ones whose hashed ids are lowest: a bound that is
    a parameter. Every labelled language has a row. What comes to the driver is a count for each language and
    trigram hash; the model takes 256 KB a language."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = docs.groupBy("lang").count().collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample / r["count"]))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * float(1 << 30)
    counts = docs.where(low).select("lang", "text").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(counts["lang"].unique().to_pylist())
    table_ = np.full((len(langs), 1 << HASH_BITS), 0.5)
    if langs:
        row = pc.index_in(counts["lang"], pa.array(langs, pa.string())).to_numpy()
        table_[row, counts["gram"].to_numpy()] += counts["n"].to_numpy()
    return TextModel(langs, np.log(table_ / table_.sum(1, keepdims=True)).astype(np.float32))


def host(url: str) -> str:
    """The host in lower case, without a leading www. or m.; empty if there is none."""
    found = _HOST.match(url)
    return re.sub(r"^(?:www|m)\.|\.$", "", found[1].lower()) if found else ""


def declared_language(html: str) -> str:
    """The primary subtag of the html element's lang attribute (or xml:lang), lower case; empty if there is none.

    All that stands before the body is read, of whatever length, once; comments, scripts, styles and titles are not.
    """
    at = 0
    while found := _OPENING.search(html, at):
        comment, hidden, body = found.groups()
        at = found.end()
        if body:
            break
        if comment:
            at = html.find("-->", found.start() + 2)
            if at < 0:
                break
        elif hidden:
            closed = _CLOSED[hidden.lower()].search(html, at)
            if not closed:
                break
            at = closed.end()
        else:
            said = {}
            while attribute := _ATTRIBUTE.match(html, at):
                said.setdefault(attribute[1].lower(), attribute[2] or "")
                at = attribute.end()
            for name in ("lang", "xml:lang"):
                if subtag := _PRIMARY.match(said.get(name, "")):
                    return subtag[1].lower()
    return ""


def _scorer(model: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "html", BLOCK_BYTES):
            html, url = block.column("html").to_pylist(), block.column("url").to_pylist()
            logs = [model.value.log_likelihoods(visible_text(h)) for h in html]
            best = [model.value.langs[int(x.argmax())] if x.any() else None for x in logs]
            columns = [pa.array([host(u) for u in url], pa.string()), pa.array([declared_language(h) for h in html], pa.string()), pa.array([x.tolist() for x in logs], pa.list_(pa.float64())), pa.array(best, pa.string())]
            yield pa.RecordBatch.from_arrays([block.column("page_id"), *columns], names=["page_id", "host", "declared", "logs", "text_lang"])

    return score


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, declared, text_lang, lang and probability of each page.

    lang maximises P(text | lang) P(declared | lang) P(lang | host). The text likelihood is a trigram model of the
    labelled documents. The two others are counted over all pages by the languages that texts alone suggest: for
    declarations by language, and for hosts smoothed by their address suffix, which is smoothed by all pages. A page
    leaves its own suggestion out of its host's counts, lest its text count twice. Counts are grouped sums; a host
    with a third of all pages is one row of them, and joins to its pages as a table with one row a host.

    Null html has no letters: the priors decide. Null url has the empty host. Ties go to the first language by
    name. Equal rows are judged alike; empty tables work (without labels lang is null); other columns don't matter.
    """
    spark = pages.sparkSession
    model = fit(docs, sample)
    langs = model.langs
    slim = pages.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "html")])
    kind = slim.schema["page_id"].dataType.simpleString()
    scored = stash(slim.mapInArrow(_scorer(spark.sparkContext.broadcast(model)), f"page_id {kind}, host string, declared string, logs array<double>, text_lang string"), "page-scores")
    if not langs:
        return scored.select("page_id", "host", "declared", "text_lang", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    n = len(langs)
    of = lambda name: [F.sum((F.col("text_lang") == x).cast("long")).alias(f"{name}{i}") for i, x in enumerate(langs)]
    known = scored.where(F.col("text_lang").isNotNull())
    # declarations outside the known languages are one value, so this has (n + 1) x n counts at most
    said = F.when(F.col("declared").isin(langs), F.col("declared")).otherwise("other")
    told = {(r["said"], r["text_lang"]): r["count"] for r in known.where("declared != ''").groupBy(said.alias("said"), "text_lang").count().collect()}
    by_lang = [sum(c for (_, lang), c in told.items() if lang == x) for x in langs]
    log_told = [(d, [math.log((told.get((d, x), 0) + DECLARED_MASS) / (by_lang[i] + DECLARED_MASS * (n + 1))) for i, x in enumerate(langs)]) for d in [*langs, "other"]]
    suffix = F.element_at(F.split("host", r"\."), -1)
    packed = lambda name: F.array(*[f"{name}{i}" for i in range(n)]).alias(name)
    hosts = stash(known.groupBy("host").agg(*of("h"), F.count(F.lit(1)).alias("h_sum")).select("host", suffix.alias("suffix"), packed("h"), "h_sum"), "hosts")
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(F.get("h", F.lit(i))).alias(f"s{i}") for i in range(n)], F.sum("h_sum").alias("s_sum"))
    suffixes = stash(suffixes.select("suffix", packed("s"), "s_sum"), "suffixes")
    every = suffixes.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"g{i}") for i in range(n)]).first()
    overall = [(every[i] or 0) + GLOBAL_MASS / n for i in range(n)]
    p_all = [x / sum(overall) for x in overall]
    # the shares of a suffix, then of a host; a page without either falls back on what is above. One expression over
    # the languages, so that plans don't grow with their number
    named = scored.withColumn("suffix", suffix).join(hosts.drop("suffix"), "host", "left").join(suffixes, "suffix", "left")
    named = named.withColumn("said", F.when(F.col("declared") != "", said))
    named = named.join(F.broadcast(spark.createDataFrame(log_told, "said string, told array<double>")), "said", "left")
    mine = F.col("text_lang").isNotNull().cast("long")
    listed = lambda values: F.array(*[F.lit(x) for x in values])

    def score(log: Column, i: Column) -> Column:
        own = F.get(listed(langs), i).eqNullSafe(F.col("text_lang")).cast("long")
        count = lambda c: F.coalesce(F.get(c, i), F.lit(0)) - own
        total = lambda c: F.coalesce(c, F.lit(0)) - mine
        p_suffix = (count("s") + F.get(listed(p_all), i) * SUFFIX_MASS) / (total("s_sum") + SUFFIX_MASS)
        p_host = (count("h") + p_suffix * HOST_MASS) / (total("h_sum") + HOST_MASS)
        return log + F.coalesce(F.get("told", i), F.lit(0.0)) + F.log(p_host)

    scores = F.transform("logs", score)
    fused = named.withColumn("scores", scores).withColumn("top", F.array_max("scores"))
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("scores", F.col("top")).cast("int"))
    return fused.select("page_id", "host", "declared", "text_lang", lang.alias("lang"), (F.lit(1.0) / total).alias("probability"))


def op4_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
