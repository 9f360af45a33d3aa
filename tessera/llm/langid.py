"""Language identification by Bayesian evidence fusion.

Method: the likelihood of a page's text under each language (byte trigrams, naive Bayes) is combined with the language that
its markup declares, with its address suffix and with the prior of its host.  Priors are smoothed from level to level: all
pages, then the suffix, then the host, each by grouped sums of what the texts say.

The text model is fitted on at most ``max_rows`` labelled documents, those with the least hash of their id; all pages are
scored.

Defined results: a null page or one without text is judged by the other evidence; a null URL has an empty host and suffix;
a missing declaration is evidence of its own kind; without labelled documents the language is null; ties go to the language
that sorts first; repeated rows get repeated results, and count as often in the priors; a page of any length is read whole;
an empty table gives an empty table; columns beside the id, URL and page are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_map, materialize
from tessera.llm.urlfilter import host_of, path_of

BUCKETS = 1 << 15
#: A text's evidence counts as that of so many independent trigrams at most, as neighbouring ones are not independent.
EVIDENCE = 60
#: The sample is counted in so many parts.
SAMPLE_PARTS = 4
#: Pages that the prior of the level above counts as.
KAPPA = 20.0
_TAGS = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the byte trigrams of a lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(17)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 4_000) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and log probabilities (language by bucket)."""
    chosen = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).distinct().orderBy(F.xxhash64("__id"), "__id", "__lang").limit(max_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("__lang", text_col)

    def count(cols):
        out: dict[str, np.ndarray] = {}
        for lang, text in zip(cols["__lang"], cols[text_col], strict=True):
            out[lang] = out.get(lang, 0) + np.bincount(trigrams(text or ""), minlength=BUCKETS)
        return {"lang": list(out), "counts": [x.astype(np.int64) for x in out.values()]}

    # a row for each language and batch of the sample, whatever the number of partitions of the documents
    rows = rows.repartition(SAMPLE_PARTS)
    total: dict[str, np.ndarray] = {}
    for r in arrow_map(rows, count, "lang string, counts array<long>").toArrow().to_pylist():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["counts"])
    langs = sorted(total)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    table = np.array([total[x] for x in langs]) + 0.5
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def text_of(page: str | None) -> str:
    return html.unescape(_TAGS.sub(" ", page or ""))


def likelihood(text: str, logp: np.ndarray) -> np.ndarray:
    """Log likelihoods of a text, best at zero; none without trigrams.  A long text is summed piece by piece."""
    t = trigrams(text)
    if len(t) < 3 or not len(logp):
        return np.zeros(len(logp))
    total = np.zeros(len(logp))
    for k in range(0, len(t), 1 << 16):
        total += logp[:, t[k : k + (1 << 16)]].sum(axis=1)
    total *= min(1.0, EVIDENCE / len(t))
    return total - total.max()


def declared_of(page: Column) -> Column:
    """Primary language tag of the page's root element; empty if none."""
    return F.coalesce(F.lower(F.regexp_extract(page, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """The host's last label and, where a path begins with a two-letter part, that part."""
    return F.concat_ws("/", F.element_at(F.split(host_of(url), r"\."), -1), F.nullif(F.lower(F.regexp_extract(path_of(url), r"^/([A-Za-z]{2})(?:[/.]|$)", 1)), F.lit("")))


def score(pages: DataFrame, langs: list[str], logp: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(logp)

    def run(cols):
        return {"__ll": [likelihood(text_of(p), shared.value) for p in cols["__page"]]}

    rows = pages.select(id_col, F.col(html_col).alias("__page"), host_of(F.col(url_col)).alias("__host"), suffix_of(F.col(url_col)).alias("__suffix"), declared_of(F.col(html_col)).alias("__declared"))
    return arrow_map(rows, run, "__ll array<double>", (id_col, "__host", "__suffix", "__declared"))


def _normal(v: Column) -> Column:
    """An array of non-negative numbers divided by its sum."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.transform(v, lambda x: x / total)


def _sums(df: DataFrame, key: list[str], n: int) -> DataFrame:
    agg = df.groupBy(*key).agg(*[F.sum(F.get("__p", F.lit(i))).alias(f"s{i}") for i in range(n)])
    return agg.select(*key, F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) for i in range(n)]).alias("sums"))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_rows: int = 4_000) -> DataFrame:
    """``(id_col, host, suffix, declared, text_lang, lang, posterior)`` for each row."""
    langs, logp = fit(docs, max_rows=max_rows)
    n = len(langs)
    scored = score(pages, langs, logp, id_col, url_col, html_col)
    names = F.array(*[F.lit(x) for x in langs]).cast("array<string>")

    def best(v: Column) -> Column:
        return F.get(names, (F.array_position(v, F.array_max(v)) - 1).cast("int"))

    plain = [F.col(id_col), F.col("__host").alias("host"), F.col("__suffix").alias("suffix"), F.col("__declared").alias("declared")]
    if not n:
        return scored.select(*plain, F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    scored = materialize(scored.withColumn("__p", _normal(F.transform("__ll", lambda x: F.exp(x)))))
    # sums by declaration and by (host, suffix) are taken before the shuffle, so a hot host costs a row for each task
    every = _sums(scored, [], n).select(_normal(F.transform("sums", lambda x: x + 1.0)).alias("prior_all"))
    by_suffix = _sums(scored, ["__suffix"], n).crossJoin(F.broadcast(every)).select("__suffix", _normal(F.zip_with("sums", "prior_all", lambda s, p: s + KAPPA * p)).alias("prior_suffix"))
    by_host = _sums(scored, ["__host", "__suffix"], n)
    own = by_host.groupBy("__host").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"h{i}") for i in range(n)]).select("__host", F.array(*[f"h{i}" for i in range(n)]).alias("host_sums"))
    prior = by_host.select("__host", "__suffix").join(own, "__host").join(by_suffix, "__suffix")
    prior = materialize(prior.select("__host", "__suffix", _normal(F.zip_with("host_sums", "prior_suffix", lambda s, p: s + KAPPA * p)).alias("prior")))
    # the likelihood of each declaration and suffix under each language
    declared = _likelihood(scored, "__declared", "like_declared", n)
    suffix = _likelihood(scored, "__suffix", "like_suffix", n)
    out = scored.join(prior, ["__host", "__suffix"], "left").join(declared, "__declared", "left").join(suffix, "__suffix", "left")
    logs = F.zip_with(
        F.zip_with("__ll", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b),
        F.zip_with(F.transform("like_declared", lambda x: F.log(x)), F.transform("like_suffix", lambda x: F.log(x)), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    out = out.withColumn("__log", logs).withColumn("__post", _normal(F.transform("__log", lambda x: F.exp(x - F.array_max("__log")))))
    return out.select(*plain, best(F.col("__ll")).alias("text_lang"), best(F.col("__post")).alias("lang"), F.array_max("__post").alias("posterior"))


def _likelihood(scored: DataFrame, key: str, name: str, n: int) -> DataFrame:
    """P(value | language), smoothed by one page for each value and language."""
    sums = _sums(scored, [key], n)
    totals = sums.agg(F.count(F.lit(1)).alias("values"), *[F.sum(F.get("sums", F.lit(i))).alias(f"t{i}") for i in range(n)])
    total = F.array(*[F.col(f"t{i}") + F.col("values") for i in range(n)])
    return materialize(sums.crossJoin(F.broadcast(totals)).select(key, F.zip_with("sums", total, lambda s, t: (s + 1.0) / t).alias(name)))
