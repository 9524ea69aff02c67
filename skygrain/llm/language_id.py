"""Language of whole texts by a byte convolutional network, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, least_hash_sample, ship

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
STRIDE = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


def windows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the UTF-8 bytes (n, WINDOW), the last one padded with zeros, and how many new bytes each brings."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, -(-(len(raw) - WINDOW + STRIDE) // STRIDE)) if len(raw) > WINDOW else 1
    padded = np.zeros(STRIDE * (n - 1) + WINDOW, dtype=np.uint8)
    padded[: len(raw)] = raw
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    weight = np.full(n, float(STRIDE))
    weight[-1] = max(1, len(raw) - STRIDE * (n - 1))
    return view, weight


class ByteConvNet:
    """Filters of several widths over one-hot bytes, max pooling over the window, a softmax layer.

    A filter over one-hot bytes is a table (width, 256): its response is a sum of looked-up rows.
    """

    def __init__(self, labels: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [(0.3 * rng.standard_normal((w, 256, FILTERS))).astype(np.float32) for w in WIDTHS]
        self.weights = (0.1 * rng.standard_normal((len(WIDTHS) * FILTERS, max(1, len(labels))))).astype(np.float32)
        self.bias = np.zeros(max(1, len(labels)), dtype=np.float32)

    def pool(self, x: np.ndarray, places: bool = False):
        """Largest response of every filter in each window and, if asked for, where it is."""
        top, at = [], []
        for w, table in zip(WIDTHS, self.tables):
            length = WINDOW - w + 1
            sums = table[0].take(x[:, :length], axis=0)
            for k in range(1, w):
                sums += table[k].take(x[:, k : k + length], axis=0)
            if places:
                at.append(sums.argmax(axis=1))
            top.append(sums.max(axis=1))
        return (np.concatenate(top, axis=1), at) if places else np.concatenate(top, axis=1)

    def posterior(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        pooled = np.concatenate([self.pool(x[i : i + chunk]) for i in range(0, len(x), chunk)])
        # In double precision, so that a probability hardly depends on the windows it is computed with.
        return _softmax(np.maximum(pooled, 0).astype(float) @ self.weights.astype(float) + self.bias)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 6, least_steps: int = 200) -> None:
        """Adam on the cross-entropy; small samples are gone over more often, for ``least_steps`` steps at least."""
        epochs = max(epochs, -(-least_steps * batch // max(1, len(x))))
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.weights, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                xb, t = x[own], t + 1
                pooled, at = self.pool(xb, places=True)
                shown = np.maximum(pooled, 0)
                d = _softmax(shown @ self.weights + self.bias)
                d[np.arange(len(own)), y[own]] -= 1
                d /= len(own)
                back = (d @ self.weights.T) * (pooled > 0)
                grads = []
                for j, w in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.tables[j]), back[:, j * FILTERS : (j + 1) * FILTERS]
                    rows, cols = np.arange(len(own))[:, None], np.broadcast_to(np.arange(FILTERS), part.shape)
                    for k in range(w):
                        np.add.at(g[k], (xb[rows, at[j] + k], cols), part)
                    grads.append(g)
                grads += [shown.T @ d, d.sum(axis=0)]
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def predict(self, texts: list[str | None], held: int = 2048) -> list[tuple[str, float]]:
        """The likeliest label of each text over all its windows, weighted by their bytes, and its mean probability.

        Windows of many texts go through the network together, ``held`` at a time; a text of any length
        adds to its own sums part by part.
        """
        sums, weights = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        x, w, owner, n = [], [], [], 0

        def flush() -> None:
            nonlocal n
            if n:
                np.add.at(sums, np.concatenate(owner), np.concatenate(w)[:, None] * self.posterior(np.concatenate(x)))
                x.clear(), w.clear(), owner.clear()
                n = 0

        for k, text in enumerate(texts):
            if not self.labels or not text or next(filter(str.isalpha, text), None) is None:
                continue
            own, weight = windows(text)
            weights[k] = weight.sum()
            for i in range(0, len(own), held):
                x.append(own[i : i + held])
                w.append(weight[i : i + held])
                owner.append(np.full(len(x[-1]), k))
                n += len(x[-1])
                if n >= held:
                    flush()
        flush()
        best = sums.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        return [(self.labels[b], float(min(1.0, sums[k, b] / weights[k]))) if weights[k] else (UNKNOWN, 0.0) for k, b in enumerate(best)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds))


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts_per_label: int = 400, windows_per_text: int = 6, max_texts: int = 80_000) -> ByteConvNet:
    """Fit on a bounded sample: at most ``texts_per_label`` texts (least hash of the id) of every label, ``windows_per_text`` windows of each.

    Many labels share ``max_texts``, each with one text at least; more labels than that are an error, so
    no label is left out unsaid. Rows with a null id, text or label are not learned from, and a label
    whose sampled texts have no letter is not known. Without any labelled row the net knows no label.
    """
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    ids = rows.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    common = {r["_lang"]: r["count"] for r in ids.groupBy("_lang").count().limit(max_texts + 1).collect()}
    if len(common) > max_texts:
        raise ValueError(f"more than {max_texts} labels")
    texts_per_label = max(1, min(texts_per_label, max_texts // max(1, len(common))))
    picked = cut(least_hash_sample(ids, "_lang", common, texts_per_label).select("_id").distinct(), "lang-sample")
    sample = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(picked), F.col("id") == F.col("_id"), "left_semi")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if next(filter(str.isalpha, text), None) is not None:
                    x = windows(text)[0]
                    own = np.unique(np.linspace(0, len(x) - 1, min(windows_per_text, len(x))).astype(int))
                    yield pa.RecordBatch.from_pydict({"id": pa.array([key] * len(own), pa.int64()), "lang": [lang] * len(own), "window": pa.array([x[i].tobytes() for i in own], pa.binary())})

    got = sample.mapInArrow(cut_windows, "id long, lang string, window binary").toPandas().sort_values(["id", "lang", "window"])
    labels = sorted(set(got["lang"]))
    net = ByteConvNet(labels)
    if labels:
        x = np.frombuffer(b"".join(got["window"]), dtype=np.uint8).reshape(-1, WINDOW)
        net.fit(x, np.array([labels.index(v) for v in got["lang"]]))
    return net


def predict(docs: DataFrame, net: ByteConvNet, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row.

    Whole texts are read in fixed windows that overlap by the widest filter less one. Text that is null
    or has no letter gets ``und`` and 0. Ties go to the first label in order. Repeated rows and null ids
    stay; other columns stay, those named ``lang_pred`` and ``score`` are replaced. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # a few hundred kB, whatever the input

    @F.arrow_udf("struct<lang:string,score:double>")
    def guess(text: pa.Array) -> pa.Array:
        got = []
        for i in range(0, len(text), 256):
            got += shared.value.predict(text.slice(i, 256).to_pylist())
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    name = free_name(docs, "guess")
    out = docs.withColumn(name, guess(F.col(text_col).cast("string")))
    return out.withColumns({"lang_pred": F.col(f"{name}.lang"), "score": F.col(f"{name}.score")}).drop(name)
