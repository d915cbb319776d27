"""Quality classifier by hierarchical empirical Bayes.

A document's evidence comes from two linear models over its whole text: whether it is good prose, and whether it is
toxic.  They are fitted on a bounded sample of labelled rows (``SAMPLE``): a few shape features with a logistic
regression, and for toxicity the words whose presence tells the classes apart, at most ``LEXICON``.  Every document is
scored.  Grouped sums over all documents then give each site (host) and each path of a site its posterior: the mean
of its documents' probabilities, shrunk toward the level above by a strength that the variance between groups sets.
A document's final log odds are its evidence plus the shift of its path's posterior from the global prior.

Defined results: a null or empty text has neutral evidence and takes its path's posterior; a null site or path is a
group of its own; repeated rows are scored each; with an empty table, or labels of one class, all evidence is neutral.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_slices, joined_back, no_cycles, written

#: Labelled rows that the models are fitted on, words in the lexicon, and strength of shrinkage at most.
SAMPLE, LEXICON, STRONGEST = 4000, 200, 1e6
#: Rounding within which a probability is at a limit; what is at one stays, so neutral evidence rejects nothing.
EVEN = 1e-9
MARKS = b"&#$%*|!=+~^<>@_{}[]\\"


def features(text: str) -> list[float]:
    """Shape of a whole text, independent of its language."""
    raw = text.encode()
    words = raw.split()
    n = max(1, len(words))
    counts = Counter(words)
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256)
    size = max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower = codes[65:91].sum(), codes[97:123].sum()
    return [
        math.log1p(n), math.log1p(len(counts)) / math.log1p(n + 1), max(counts.values(), default=0) / n,
        sum(codes[c] for c in MARKS) / size * 10, upper / max(1, upper + lower), codes[48:58].sum() / size * 10,
        len(set(lines)) / max(1, len(lines)), size / n / 10, math.log1p(len(lines)) / 5,
        (codes[46] + codes[44]) / n, float(sum(c == 1 for c in counts.values())) / n,
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the intercept) by Newton steps with a ridge."""
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.clip((x - mean) / scale, -6, 6), np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def bare_words(text: str) -> set[bytes]:
    """Lower-cased words without marks around them."""
    return {w.strip(b".,;:!?&#$%*|\"'()") for w in text.lower().encode().split()}


def fit_lexicon(texts: list[str], toxic: np.ndarray) -> dict[bytes, float]:
    """Words whose presence is at least four times likelier in toxic texts, with their log likelihood ratio."""
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic):
        seen[int(y)].update(bare_words(text))
    n1, n0 = max(1, int(toxic.sum())), max(1, int(len(toxic) - toxic.sum()))
    found = {}
    for word, a in seen[1].items():
        b = seen[0][word]
        ratio = math.log((a + 0.1) / (n1 + 0.2)) - math.log((b + 0.1) / (n0 + 0.2))
        if a >= 5 and ratio > math.log(4):
            found[word] = (a, min(ratio, 6.0))
    best = sorted(found, key=lambda w: (-found[w][0] * found[w][1], w))[:LEXICON]
    return {w: found[w][1] for w in best}


class Model:
    """Both linear models; its size doesn't depend on the data."""

    def __init__(self, rows: list[tuple[str | None, int, int]]):
        rows = [r for r in rows if r[0] and r[1] is not None and r[2] is not None]
        good, toxic = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        texts = [r[0] for r in rows]
        x = np.array([features(t) for t in texts]).reshape(len(texts), -1) if texts else np.zeros((0, 11))
        self.shape = fit_logistic(x, good)
        self.lexicon = fit_lexicon(texts, toxic) if len(texts) else {}
        hits = np.array([self._hits(t) for t in texts]).reshape(-1, 2)
        self.tone = fit_logistic(hits, toxic)

    def _hits(self, text: str) -> list[float]:
        found = bare_words(text) & self.lexicon.keys()
        return [float(len(found) > 0) * 3, sum(self.lexicon[w] for w in found)]

    def score(self, text: str | None) -> tuple[float, float]:
        """Log odds of good and of toxic."""
        if not text:
            return 0.0, 0.0
        return self._apply(self.shape, features(text)), self._apply(self.tone, self._hits(text))

    @staticmethod
    def _apply(fitted, x) -> float:
        mean, scale, w = fitted
        return float(np.clip(np.dot(np.clip((np.array(x) - mean) / scale, -6, 6), w[:-1]) + w[-1], -12, 12))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on the ``sample`` labelled rows that come first in order of a hash of doc_id."""
    chosen = labels.select("doc_id", "quality", "toxic").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return Model([(r.text, r.quality, r.toxic) for r in rows.select("text", "quality", "toxic").toLocalIterator()])


def evidence(docs: DataFrame, model: Model, site: Column, path: Column, key: str | None = None) -> DataFrame:
    """doc_id, site, path, good and toxic (log odds) of each row of ``docs``, and its column ``key``, a long."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("site", pa.string()), ("path", pa.string()), ("good", pa.float64()), ("toxic", pa.float64()), *([(key, pa.int64())] if key else [])])

    @no_cycles
    def run(batches):
        model = shipped.value
        for batch in batches:
            for part in doc_slices(batch):
                scores = [model.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("site"), part.column("path"), *(pa.array(s, pa.float64()) for s in zip(*scores)), *([part.column(key)] if key else [])], schema=schema)

    return docs.select("doc_id", site.cast("string").alias("site"), path.cast("string").alias("path"), "text", *([key] if key else [])).mapInArrow(run, "doc_id long, site string, path string, good double, toxic double" + (f", {key} long" if key else ""))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, above: str) -> float:
    """Pseudo-counts of the level above: within variance over variance between groups, by moments."""
    g = groups.select("n", (F.col("s") / F.col("n")).alias("m"), F.col(above).alias("a"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n"))).alias("w"))
    r = g.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.col("n") * (F.col("m") - F.col("a")) * (F.col("m") - F.col("a"))).alias("b"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["n"] <= r["k"] or r["k"] < 2:
        return STRONGEST
    within = r["w"] / (r["n"] - r["k"])
    spread = r["n"] - r["nn"] / r["n"]
    between = max(0.0, (r["b"] - (r["k"] - 1) * within) / spread) if spread > 0 else 0.0
    return min(STRONGEST, within / between) if between > 0 else STRONGEST


def combine(scored: DataFrame, of: str) -> DataFrame:
    """site, path, n, <of>_shift: log-odds shift of each path's posterior from the global prior.

    Groups are summed before the shuffle, so a site with a third of all rows is a handful of sums.
    """
    p = sigmoid(F.col(of))
    paths = written(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")), scored.sparkSession)
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = (total["s"] or 0.0) / (total["n"] or 1)
    sites = paths.groupBy("site").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).withColumn("above", F.lit(prior))
    k1 = _strength(sites, "above")
    sites = sites.select(F.col("site").alias("_site"), ((F.col("s") + k1 * prior) / (F.col("n") + k1)).alias("above"))
    paths = paths.join(sites, F.col("site").eqNullSafe(F.col("_site"))).drop("_site")
    k2 = _strength(paths, "above")
    posterior = (F.col("s") + k2 * F.col("above")) / (F.col("n") + k2)
    return paths.select("site", "path", "n", (logit(posterior) - logit(F.lit(prior))).alias(f"{of}_shift"))


def classify(docs: DataFrame, labels: DataFrame, site: Column, path: Column, keep_at: float = 0.5, toxic_at: float = 0.5, sample: int = SAMPLE, key: str | None = None) -> DataFrame:
    """doc_id, site, path, p_good, p_toxic, kept (good enough and not toxic) and ``key`` of each row of ``docs``."""
    scored = written(evidence(docs, fit(docs, labels, sample), site, path, key), docs.sparkSession)
    for of in ("good", "toxic"):
        shifts = written(combine(scored.select("site", "path", of), of), docs.sparkSession)
        scored = joined_back(scored, shifts, ["site", "path"], "n").drop("n")
    out = scored.select("doc_id", "site", "path", *([key] if key else []), sigmoid(F.col("good") + F.col("good_shift")).alias("p_good"), sigmoid(F.col("toxic") + F.col("toxic_shift")).alias("p_toxic"))
    return out.withColumn("kept", (F.col("p_good") >= keep_at - EVEN) & (F.col("p_toxic") <= toxic_at + EVEN))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source) that aren't rejected, with all their columns.

    Each row is judged by itself, those that share a doc_id or have none too.
    """
    key = "__key"
    out = docs.withColumn(key, F.xxhash64("text", "source", "lang"))
    judged = classify(out, labels, F.col("source"), F.col("lang"), key=key, **options)
    rejected = judged.where("NOT kept").select(F.col("doc_id").alias("_doc"), F.col(key).alias("_key")).distinct()
    return out.join(rejected, out["doc_id"].eqNullSafe(F.col("_doc")) & (out[key] == F.col("_key")), "left_anti").drop(key)
