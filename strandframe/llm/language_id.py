"""Operator 10: language identification by Bayesian evidence fusion.

Evidence: character-trigram likelihoods of the visible text (models fitted on about `max_rows` labelled documents
per language), the declared markup language, the address (host suffix and a language code in the path), and host
priors smoothed from the suffix and the whole corpus, made by grouped sums of text posteriors over all pages. Null
html or url counts as empty; pages without any evidence get the corpus prior; repeated rows give equal rows; a
language set that is empty gives null.
"""
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize, table
from .html_text import main_text

MAX_ROWS = 1000
BUCKETS = 1 << 16
_TAG = re.compile(r"<html[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]+)", re.I)
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "nl": "nl"}


def grams(text: str, most: int = 1 << 20):
    """Buckets of the text's byte trigrams, `most` at a time."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    for a in range(0, len(b) - 2, most):
        x = b[a : a + most + 2].astype(np.uint32)
        yield ((x[:-2] * 65599 * 65599 + x[1:-1] * 65599 + x[2:]) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)


def train(documents: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list, np.ndarray]:
    """Languages and smoothed log probabilities (language, bucket), from about max_rows rows of each language, chosen by a hash; tasks count, the driver gets the sums."""
    rows = documents.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, max_rows / sizes[k]) * (1 << 30)))])

    def run(batches):
        counts: dict = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                for g in grams(t.as_py()):
                    counts[lang] += np.bincount(g, minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    few = rows.filter(F.pmod("h", F.lit(1 << 30)) <= share[F.col("lang")]).select("lang", "text")
    counts = np.full((len(langs), BUCKETS), 0.5)
    for r in few.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[langs.index(r["lang"]), r["bucket"]] += r["n"]
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def evidence(n: int, cap: float) -> float:
    """Trigrams that n of them count as: each up to cap, a third of each beyond, as three trigrams share a byte; no bound."""
    return n if n <= cap else cap + (n - cap) / 3


def identify(pages: DataFrame, model: tuple, declared_weight: float = 0.9, smoothing: float = 5.0, text_cap: float = 40.0) -> DataFrame:
    """page_id, host, text_lang, declared, lang, p_lang; one row per page."""
    langs, logp = model
    shared = pages.sparkSession.sparkContext.broadcast((langs, logp))

    def run(batches):
        langs, logp = shared.value
        for b in batches:
            ids, urls, htmls = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            host, suffix, path, said, text = [], [], [], [], []
            for u, h in zip(urls, htmls, strict=True):
                m = re.match(r"[a-z]+://([^/:?#]+)(?:/([a-z]{2})(?=[/?#]|$))?", u or "", re.I)
                host.append(m[1].lower() if m else "")
                suffix.append(host[-1].rpartition(".")[2])
                path.append((m[2] or "").lower() if m else "")
                d = _TAG.search(h or "")
                said.append(d[1].lower()[:2] if d else "")
                s, n = np.zeros(len(langs)), 0
                for g in grams(main_text(h), 1 << 14):
                    s, n = s + logp[:, g].sum(1), n + len(g)
                s = s / max(1, n) * evidence(n, text_cap)
                text.append((s - s.max()).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(host), pa.array(suffix), pa.array(path), pa.array(said), pa.array(text, pa.list_(pa.float64()))], names=["page_id", "host", "suffix", "path", "said", "loglik"])

    seen = materialize(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, host string, suffix string, path string, said string, loglik array<double>"), "lang-evidence")
    n = len(langs)
    total = F.aggregate(F.transform("loglik", F.exp), F.lit(0.0), lambda a, x: a + x)
    post = [F.exp(F.element_at("loglik", k + 1)) / total for k in range(n)]
    sums = lambda by: seen.groupBy(*by).agg(*[F.sum(p).alias(f"{(by or ['all'])[0]}_{k}") for k, p in enumerate(post)], F.count("*").alias(f"{(by or ['all'])[0]}_n"))
    if not n:
        return seen.select("page_id", "host", F.lit(None).cast("string").alias("text_lang"), F.col("said").alias("declared"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("p_lang"))
    hosts = materialize(sums(["host"]), "lang-hosts")  # so that the join is on shuffles of its own, whose hot hosts are split
    d = seen.join(hosts, "host").join(sums(["suffix"]), "suffix").join(F.broadcast(sums([])), how="inner")
    prior = [F.lit(1.0 / n)] * n
    for level in ("all", "suffix", "host"):  # each level leans on the one above
        prior = [(F.col(f"{level}_{k}") + smoothing * prior[k]) / (F.col(f"{level}_n") + smoothing) for k in range(n)]
    miss = (1 - declared_weight) / max(1, n - 1)
    code = lambda c, lang, right: F.when(c.isin(*langs), F.when(c == lang, right).otherwise((1 - right) / max(1, n - 1))).otherwise(1.0)
    tld = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    logs = [F.element_at("loglik", k + 1) + F.log(prior[k]) + F.log(code(F.col("said"), lang, 1 - miss * (n - 1))) + F.log(code(F.col("path"), lang, 0.8)) + F.log(code(F.coalesce(F.try_element_at(tld, F.col("suffix")), F.lit("")), lang, 0.7)) for k, lang in enumerate(langs)]
    d = d.withColumn("logs", F.array(*logs))
    d = d.withColumn("top", F.array_max("logs")).withColumn("p_lang", 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    names = F.array(*map(F.lit, langs))
    best = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return d.select("page_id", "host", best(F.col("loglik")).alias("text_lang"), F.col("said").alias("declared"), best(F.col("logs")).alias("lang"), "p_lang")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), train(table(spark, sf_dir, "documents")))
