"""Mixing sources to target weights: soft domain membership and nonnegative document rates.

A softmax classifier over hashed terms and character trigrams, fitted on a bounded sample of documents that a labelled table
gives a domain, predicts each document's domain posterior p (the given domain of other rows is not used). Rates w >= 0
minimise

    sum_k ((sum_i w_i t_i p_ik - T_k) / T)^2 * N / 2  +  ridge * sum_i s_i (w_i - 1)^2 / 2

with t_i a document's words, T the total, N = the number of domains' scale and s_i = t_i / T, by projected gradient: w_i moves against
p_i . r + ridge * (w_i - 1), where r is the residual by domain, and is cut at 0. The residual alone (one number a domain) couples
the documents, so one step is one scan that adds up K numbers; a rate is a function of p_i and of the residuals so far, and
is recomputed from them. No rates are stored or collected during the fit.

Where a domain's residual is above TOLERANCE of its target after STEPS steps (rare domains: their curvature is their share), the
objective is solved exactly instead, with each domain's term divided by its natural share, so that the ridge pulls no domain
away by more than about the ridge itself. Its minimum is w_i = max(0, 1 + p_i . pull), and the K numbers pull are the minimum of a
convex function, which Newton's method finds in a few scans that add up K * K numbers for each of a few step lengths. A domain that no rates reach
(no documents look like it) would ruin the others: it keeps pull 0, the others are met, and a warning names it.

Copies: a document is taken floor(w) times, and once more if the hash of its id and text falls below the fraction; expected totals are
then those of the rates. Null and empty texts have no words: they keep the rate that their posterior gives and don't weigh in. A table
without labelled rows keeps rate 1, with even posteriors. Repeated rows have equal rates and copies; rows without id are told apart by their text.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, add_column, blocks, hash_spans, lean, plain_names, read, words
from .models import SoftmaxRegression
from .terms import fold

BITS = 8
SAMPLE_PER_DOMAIN = 500  # labelled rows of each domain that the classifier is fitted on, at most
RIDGE = 0.005
STEPS = 24
TOLERANCE = 0.02  # of a domain's target: the largest residual that the steps may leave
NEWTON_STEPS = 30  # at most; a handful are needed
HALVINGS = 8  # step lengths 1, 1/2, ... that a scan tries at once
#: Target shares of words by domain.
TARGETS = {"en": 0.50, "de": 0.20, "fr": 0.17, "es": 0.13}


def vectors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each row: shares of hashed words and of byte trigrams, square roots taken, and the count of words."""
    n, size = len(off) - 1, 1 << BITS
    text = fold(data)
    starts, ends, rows = words(text, off)
    count = np.bincount(rows, minlength=n)
    w = (hash_spans(text, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    x = np.bincount(rows * 2 * size + w, minlength=n * 2 * size)
    if len(text) > 2:
        t = text.astype(np.uint64)
        tri = ((t[:-2] << np.uint64(16)) | (t[1:-1] << np.uint64(8)) | t[2:]) * np.uint64(0x9E3779B97F4A7C15)
        row = np.repeat(np.arange(n), np.diff(off))
        inside = row[:-2] == row[2:]
        x = x + np.bincount(row[:-2][inside] * 2 * size + size + (tri[inside] >> np.uint64(64 - BITS)).astype(np.int64), minlength=n * 2 * size)
    x = x.reshape(n, 2, size)
    x = np.sqrt(x / np.maximum(x.sum(2, keepdims=True), 1)).reshape(n, 2 * size)
    return x.astype(np.float32), count


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", per_domain: int = SAMPLE_PER_DOMAIN) -> SoftmaxRegression | None:
    """labelled: (id, domain). Its rows are chosen by a hash of the id."""
    chosen: DataFrame | None = None
    good = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")).where(F.col("id").isNotNull())
    for k, d in enumerate(domains):
        top = good.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_domain).select("id", F.lit(k).alias("k"))
        chosen = top if chosen is None else chosen.unionByName(top)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.dropDuplicates()), "id")

    def run(batches):
        for b in batches:
            out = []
            for lo, hi, data, off in blocks(b.column("text"), 1 << 18):
                for a in range(0, hi - lo, 2048):  # short rows: bounded feature matrices
                    z = min(a + 2048, hi - lo)
                    out += [v.astype("<f4").tobytes() for v in vectors(data[off[a] : off[z]], off[a : z + 1] - off[a])[0]]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("k"), pa.array(out, pa.binary())], ["id", "k", "x"])

    found = texts.mapInArrow(lean(run), texts.select("id", "k", F.lit(b"").alias("x")).schema)
    # Ids may repeat: so many rows of each domain at most, each task keeping only such a top list.
    top = [found.where(F.col("k") == k).orderBy(F.xxhash64("id"), "id", "x").limit(per_domain) for k in range(len(domains))]
    rows = reduce(DataFrame.unionByName, top).toArrow().sort_by([("id", "ascending"), ("k", "ascending"), ("x", "ascending")])
    if not rows.num_rows:
        return None
    x = np.stack([np.frombuffer(v, "<f4") for v in rows.column("x").to_pylist()])
    return SoftmaxRegression(x.shape[1], len(domains)).fit(x, np.array(rows.column("k").to_pylist()), steps=80, rate=2.0)


def posteriors(docs: DataFrame, model: SoftmaxRegression, text_col: str = "text", out_col: str = "soft") -> DataFrame:
    """The input's columns and out_col, a struct of n_words and p (the array of posteriors). Each text is read once."""
    handle = docs.sparkSession.sparkContext.broadcast((model.w.astype(np.float32), model.b))

    def run(text):
        w, bias = handle.value
        model = SoftmaxRegression(*w.shape)
        model.w, model.b = w, bias
        ps, counts = [np.zeros((0, w.shape[1]))], [np.zeros(0, np.int64)]
        for lo, hi, data, off in blocks(text, 1 << 18):
            for a in range(0, hi - lo, 2048):  # short rows: bounded feature matrices
                z = min(a + 2048, hi - lo)
                x, n = vectors(data[off[a] : off[z]], off[a : z + 1] - off[a])
                ps.append(model.predict(x))
                counts.append(n)
        p = np.concatenate(ps)
        listed = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], p.ravel())
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts).astype(np.int64)), listed], ["n_words", "p"])

    return add_column(docs, out_col, "struct<n_words:bigint,p:array<double>>", run, text_col)


def rates_of(p: np.ndarray, residuals: np.ndarray, step: float, ridge: float, pull: np.ndarray | None = None) -> np.ndarray:
    """The rates that the steps so far give to posteriors p (a row each), or those of the exact solution if there is one."""
    if pull is not None:
        return np.maximum(1 + p @ pull, 0)
    w = np.ones(len(p))
    for r in residuals:
        w = np.maximum(w - step * (p @ r + ridge * (w - 1)), 0)
    return w


def rate(p: Column, k: int, residuals: np.ndarray, step: float, ridge: float, pull: np.ndarray | None = None) -> Column:
    """rates_of, as a column over an array of k posteriors."""
    along = lambda x: reduce(lambda a, b: a + b, (F.get(p, i) * F.lit(float(v)) for i, v in enumerate(x)))
    if pull is not None:
        return F.greatest(F.lit(0.0), 1 + along(pull))
    moves = F.array(*(along(r) for r in residuals)) if len(residuals) else F.array().cast("array<double>")
    return F.aggregate(moves, F.lit(1.0), lambda w, m: F.greatest(F.lit(0.0), w - step * (m + ridge * (w - 1))))


def add_up(soft: DataFrame, k: int, size: int, part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """part(p, words), `size` numbers, added up over all rows of soft in one scan."""

    def run(batches):
        out = np.zeros(size)
        for b in batches:
            if b.num_rows:
                out += part(np.asarray(b.column("p").flatten()).reshape(-1, k), np.asarray(b.column("n_words")).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(out)], ["k", "v"])

    sums = np.zeros(size)
    for r in soft.select("n_words", "p").mapInArrow(lean(run), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        sums[r["k"]] = r["v"]
    return sums


def fit_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, ridge: float = RIDGE) -> tuple[np.ndarray, float, np.ndarray | None]:
    """(residuals of all steps, step size, pull or None if the steps do). soft: (n_words, p), read once a step; each task returns a fixed count of numbers."""
    k = len(targets)
    want = np.array(targets) / np.sum(targets)
    scale = np.where(want > 0, want, 1.0)
    step = 1.2 / (1.0 + ridge)  # below 2 over the largest curvature, which is at most 1 + ridge
    residuals = np.zeros((0, k))
    for i in range(steps + 1):
        done = residuals
        sums = add_up(soft, k, k + 1, lambda p, t, done=done: np.append((rates_of(p, done, step, ridge) * t) @ p, t.sum()))
        left = sums[:k] / max(float(sums[k]), 1.0) - want
        if i < steps:
            residuals = np.concatenate([residuals, [left]])
    if not sums[k] or np.abs(left / scale).max() <= TOLERANCE:
        return residuals, step, None
    free = np.ones(k, bool)
    while free.any():
        pull, left = solve(soft, want, free, ridge)
        if np.abs(left / scale)[free].max() <= TOLERANCE:
            break
        free[np.where(free, pull, -np.inf).argmax()] = False  # pulled most, and in vain
    else:
        pull = np.zeros(k)
    if not free.all():
        warnings.warn(f"no rates reach the targets of domains {np.flatnonzero(~free).tolist()} (in the order of names); they are left alone", stacklevel=2)
    return residuals, step, pull


def solve(soft: DataFrame, want: np.ndarray, free: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """(pull, residual by domain) of the exact solution in which only the free domains pull."""
    k = len(want)
    size = 1 + k + k * k  # of each length: sum of w^2, shares, curvature
    pull, move, pen = np.zeros(k), np.zeros(k), None
    for _ in range(NEWTON_STEPS):
        lengths = 0.5 ** np.arange(HALVINGS if move.any() else 1)
        tried = pull + lengths[:, None] * move

        def part(p, t, tried=tried):
            out = []
            for x in tried:
                w = rates_of(p, None, 0, 0, x)
                q = p[w > 0]
                out += [[(t * w * w).sum()], (t * w) @ p, ((q * t[w > 0, None]).T @ q).ravel()]
            return np.concatenate([*out, [t.sum()]])

        sums = add_up(soft, k, size * len(lengths) + 1, part)
        got = sums[:-1].reshape(-1, size) / sums[-1]
        if pen is None:
            pen = ridge * np.maximum(got[0, 1 : 1 + k], 1e-12)  # the ridge by domain: all rates are 1 here
        best = int((got[:, 0] / 2 - tried @ want + (tried**2 @ pen) / 2).argmin())
        pull, left = tried[best], got[best, 1 : 1 + k] - want
        slope = left + pen * pull
        if np.abs(slope / np.where(want > 0, want, 1.0))[free].max() <= TOLERANCE / 100:
            break
        curve = got[best, 1 + k :].reshape(k, k) + np.diag(pen)
        move = np.zeros(k)
        move[free] = -np.linalg.solve(curve[np.ix_(free, free)], slope[free])
    return pull, left


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """id_col, n_words, p, rate, copies: a row for each document."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain"))
    # The text isn't kept: its place is taken by its hash.
    marked = plain.select("id", F.xxhash64("id", "text").alias("mark"), "text")
    domains, scratch = sorted(targets), Scratch(docs.sparkSession, "mix")
    model = fit_domains(marked, known, domains, "id", "text")
    soft = posteriors(marked, model or SoftmaxRegression(2 << BITS, len(domains)), "text", "text").withColumnRenamed("text", "soft")
    soft = scratch.table(soft, "soft")
    one = F.lit(1.0)
    if model is not None:
        fitted = fit_rates(soft.select("soft.n_words", "soft.p"), [targets[d] for d in domains])
        one = rate(F.col("soft.p"), len(domains), fitted[0], fitted[1], RIDGE, fitted[2])
    out = soft.withColumn("rate", one)
    return out.select(F.col("id").alias(id_col), F.col("soft.n_words").alias("n_words"), F.col("soft.p").alias("p"), "rate", copies(F.col("rate"), F.col("mark")).alias("copies"))


def copies(rate: Column, mark: Column) -> Column:
    """How often a document is taken: the rate, rounded up with the probability of its fraction, by a hash."""
    u = F.pmod(F.xxhash64(mark, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def resample(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain") -> DataFrame:
    """The documents, each as often as its rate says, with the input's columns.

    Rows are written once with their posteriors, so that texts are read once; the fit reads the numbers alone, and no join brings the rates back.
    """
    plain, back = plain_names(docs)
    place = dict(zip(reversed(docs.columns), reversed(plain.columns), strict=True))
    domains, scratch = sorted(targets), Scratch(docs.sparkSession, "resample")
    named = plain.select(F.col(place[id_col]).alias("id"), F.col(place[text_col]).alias("text"))
    model = fit_domains(named, labelled.select(F.col(id_col).alias("id"), F.col(domain_col).alias("domain")), domains, "id", "text")
    if model is None:
        return docs
    soft = scratch.table(posteriors(plain, model, place[text_col]), "soft")
    fitted = fit_rates(soft.select("soft.n_words", "soft.p"), [targets[d] for d in domains])
    taken = copies(rate(F.col("soft.p"), len(domains), fitted[0], fitted[1], RIDGE, fitted[2]), F.xxhash64(place[id_col], place[text_col]))
    return soft.select(*plain.columns, F.explode(F.array_repeat(F.lit(1), taken)).alias("copy")).select(*back)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels are the labelled table; their language is the domain."""
    docs = read(spark, sf_dir, "documents")
    ids = read(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id")
    out = mix(docs.select("doc_id", "text"), labelled)
    p = [F.get("p", i).alias(f"p_{d}") for i, d in enumerate(sorted(TARGETS))]
    return out.select("doc_id", "n_words", *p, "rate", F.col("copies").cast("long").alias("copies"))
