"""Mixing documents to target weights of domains that a classifier assigns softly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, least_hash_sample, ship
from .tokens import tokenizer

FEATURE_BITS = 15


def word_features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed words, their damped counts scaled to length one, and the number of words (ASCII white space separates them)."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    hashed = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & np.uint32((1 << FEATURE_BITS) - 1)
    names, n = np.unique(hashed, return_counts=True)
    x = np.log1p(n).astype(np.float32)
    return names.astype(np.int32), x / max(1e-9, float(np.sqrt(x @ x))), len(words)


class DomainModel:
    """Multinomial logistic regression over hashed words."""

    def __init__(self, domains: list[str]):
        self.domains = domains
        self.weights = np.zeros((1 << FEATURE_BITS, len(domains)), dtype=np.float32)
        self.bias = np.zeros(len(domains), dtype=np.float32)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, prior: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, seed: int = 3) -> None:
        """Adam on balanced labels; the bias then takes the labels' own shares."""
        rng = np.random.default_rng(seed)
        per = np.bincount(y, minlength=len(self.domains))
        m, v, t = np.zeros_like(self.weights), np.zeros_like(self.weights), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                own, t = order[i : i + batch], t + 1
                x = np.zeros((len(own), 1 << FEATURE_BITS), dtype=np.float32)
                for k, j in enumerate(own):
                    x[k, rows[j][0]] = rows[j][1]
                d = self._softmax(x @ self.weights)
                d[np.arange(len(own)), y[own]] -= 1
                d *= (len(rows) / (len(per) * np.maximum(per, 1)))[y[own]][:, None]
                g = x.T @ (d / len(own)).astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                self.weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        self.bias = np.log(np.maximum(prior, 1e-9)).astype(np.float32)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, text: str | None) -> tuple[np.ndarray, int]:
        names, x, n = word_features(text)
        return self._softmax((x @ self.weights[names] + self.bias)[None, :].astype(np.float64))[0], n


def train(docs: DataFrame, labels: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", texts_per_domain: int = 1500) -> DomainModel:
    """Fit on a bounded sample: at most ``texts_per_domain`` labelled texts of each domain, by least hash of the id.

    Rows whose id or domain is null or unknown teach nothing; a domain without rows gets a posterior near zero.
    """
    ship(docs.sparkSession)
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(domain_col).isin(domains)).select(F.col(id_col).alias("_id"), F.col(domain_col).alias("domain"))
    total = {r["domain"]: r["count"] for r in ids.groupBy("domain").count().collect()}
    picked = cut(least_hash_sample(ids, "domain", total, texts_per_domain).dropDuplicates(["_id"]), "domain-sample")  # bounded, so the texts are filtered where they are read
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("_id")).select("id", "text", "domain")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [word_features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "domain": batch.column(2), "names": pa.array([g[0].tobytes() for g in got], pa.binary()), "x": pa.array([g[1].tobytes() for g in got], pa.binary())})

    got = sorted(sample.mapInArrow(measure, "id long, domain string, names binary, x binary").collect())
    model = DomainModel(domains)
    if got:
        y = np.array([domains.index(r["domain"]) for r in got])
        share = np.array([total.get(d, 0) for d in domains], dtype=float)
        model.fit([(np.frombuffer(r["names"], np.int32), np.frombuffer(r["x"], np.float32)) for r in got], y, share / share.sum())
    return model


def posteriors(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """(id, n_tokens, p) of every row: tokens of the whole text and the posterior of each domain in the model's order.

    Tokens are the ids of ``tokenizer_path``, or words between ASCII white space if none is given.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^15 weights a domain, whatever the input

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path, 50_000) if tokenizer_path else None
        for batch in batches:
            got = [shared.value.posterior(t.as_py()) for t in batch.column(1)]
            n = [len(tok.ids32(t.as_py())) for t in batch.column(1)] if tok else [g[1] for g in got]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "p": pa.array([g[0].tolist() for g in got], pa.list_(pa.float64()))})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(judge, "id long, n_tokens long, p array<double>")


def rate_of(p: Column, steps: list[np.ndarray]) -> Column:
    """The rate that the steps of ``fit_rates`` give to a posterior."""
    r = F.lit(1.0)
    for s in steps:
        r = F.greatest(F.lit(0.0), sum((F.lit(float(x)) * F.get(p, F.lit(k)) for k, x in enumerate(s)), r))
    return r


def fit_rates(table: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-6, total: float | None = None) -> list[np.ndarray]:
    """Steps whose ``rate_of`` >= 0 for rows with ``n_tokens`` and ``p`` brings sum(rate * n_tokens * p_d) to ``total`` * targets_d.

    Projected gradient on the squared distance of the domain totals from their targets, from a rate of 1
    everywhere. A document's gradient is its posterior times the distances; the step is scaled by the
    second moments of the posteriors of documents that have a rate (a few numbers), then cut at zero.
    Where that step does not come closer, a plain gradient step does. Each round is one distributed sum of a few numbers,
    and a rate is a function of the rounds' steps, so nothing else is kept. Targets that no rates
    reach are approached. ``total`` is the tokens of all rows by default.
    """
    d = len(targets)
    goal = np.array(targets, dtype=float) / max(1e-12, sum(targets))
    p = [F.get("p", F.lit(k)) for k in range(d)]
    n = table.agg(F.sum("n_tokens")).first()[0] or 0
    if not n:
        return []
    share = F.col("n_tokens") / F.lit(float(n))
    scale = float(total) / n if total else 1.0

    def state(steps):
        r = rate_of(F.col("p"), steps)
        rows = table.select(share.alias("a"), r.alias("r"), *[p[k].alias(f"p{k}") for k in range(d)])
        sums = [F.sum(F.col("a") * F.col("r") * F.col(f"p{k}")) for k in range(d)]
        moments = [F.sum(F.when(F.col("r") > 0, F.col("a") * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)) for i in range(d) for j in range(i, d)]
        got = list(rows.agg(*[c.alias(f"c{k}") for k, c in enumerate(sums + moments)]).first())
        m = np.zeros((d, d))
        m[np.triu_indices(d)] = got[d:]
        return np.array(got[:d]) - goal * scale, np.maximum(m, m.T)

    steps: list[np.ndarray] = []
    off, moment = state(steps)
    plain = 1 / max(1e-12, float(np.linalg.eigvalsh(moment).max()))  # a step that always comes closer, if slowly
    damp = 1.0
    for _ in range(rounds):
        if np.abs(off).max() <= tolerance:
            break
        step = -damp * np.linalg.solve(moment + 1e-9 * np.eye(d), off)
        tried = state([*steps, step])
        damp = min(1.0, 2 * damp)
        if np.linalg.norm(tried[0]) >= np.linalg.norm(off) * (1 - 1e-3):
            step, damp = -plain * off, max(1 / 64, damp / 4)
            tried = state([*steps, step])
            if np.linalg.norm(tried[0]) >= np.linalg.norm(off) * (1 - 1e-5):
                break
        steps.append(step)
        off, moment = tried
    return steps


def achieved(table: DataFrame, steps: list[np.ndarray], domains: int) -> list[float]:
    """The expected share of tokens of each domain under the rates, one pass; zeros if nothing has a rate."""
    r = rate_of(F.col("p"), steps) * F.col("n_tokens")
    got = table.agg(*[F.sum(r * F.get("p", F.lit(k))).alias(f"s{k}") for k in range(domains)]).first()
    total = sum(x or 0.0 for x in got)
    return [(x or 0.0) / total if total else 0.0 for x in got]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", tokenizer_path: str | None = None, **training) -> DataFrame:
    """id_col, n_tokens, p_<domain> for each target, rate, and share_<domain>: one row per row of ``docs``.

    ``share_<domain>`` is the same in every row: the expected share of tokens that the rates reach, to be
    held against the target. ``labels`` has id and domain; repeated ids teach once. Null and empty texts
    have no tokens, the posteriors of the bias, and a rate that changes no total. Null ids and repeated
    rows are kept; equal texts have equal rates; other columns are not carried. An empty table gives an
    empty result.
    """
    domains = sorted(targets)
    model = train(docs, labels, domains, id_col, text_col, domain_col, **training)
    table = cut(posteriors(docs, model, id_col, text_col, tokenizer_path), "posteriors")
    steps = fit_rates(table, [targets[d] for d in domains])
    shares = achieved(table, steps, len(domains))
    named = [c for k, d in enumerate(domains) for c in (F.get("p", F.lit(k)).alias(f"p_{d}"), F.lit(shares[k]).alias(f"share_{d}"))]
    return table.select(F.col("id").alias(id_col), "n_tokens", rate_of(F.col("p"), steps).alias("rate"), *named)


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", tokenizer_path: str | None = None, **training) -> DataFrame:
    """The rows of ``docs`` as often as their rates say: the whole part always, the rest by a hash of the id.

    Once the steps are fitted a rate depends on the text alone, so texts are judged again where they
    are read and never joined or shuffled. Null ids draw like one id, and so do rows that share one;
    null and empty texts have the rate of the bias. Columns stay as they are, whatever their names.
    """
    domains = sorted(targets)
    model = train(docs, labels, domains, id_col, text_col, domain_col, **training)
    table = cut(posteriors(docs, model, id_col, text_col, tokenizer_path).select("n_tokens", "p"), "posteriors")
    steps = fit_rates(table, [targets[d] for d in domains])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def judge(text: pa.Array) -> pa.Array:
        return pa.array([shared.value.posterior(t.as_py())[0].tolist() for t in text], pa.list_(pa.float64()))

    p, times, copy = (free_name(docs, x) for x in ("posterior", "times", "copy"))
    judged = docs.withColumn(p, judge(F.col(text_col).cast("string")))
    timed = judged.withColumn(times, F.floor(rate_of(F.col(p), steps) + F.coalesce(draw_of(id_col), F.lit(0.5))).cast("int"))
    return timed.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))).drop(p, times, copy)


def draw_of(id_col: str):
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
