"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's maximum over a window goes
through a softmax layer, and a document's prediction is the mean of its windows' log probabilities, weighted by their
letters. Training uses whole texts of a bounded sample of labelled rows, spread evenly over all labels (each has one row at
least), and draws a fixed number of batches from all of their windows; application covers every window of every text.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without any labelled row every text is
``und``; a null doc_id is neither held out nor learned from; repeated rows each get a row; an empty table gives an empty
result. Of labels equally likely the least name counts. Other columns are passed through; columns of the input named
lang_pred and score are replaced by the prediction. Long texts are read whole, in batches of bounded size.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column_or_null

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED = 6
FILTERS = 12
#: Bound of the training sample, in rows, and steps of training with windows of each.
TRAIN_ROWS = 1000
STEPS, BATCH = 900, 64
UND = "und"


@dataclass
class ByteConv:
    """labels, the byte embedding (256 x EMBED), one matrix that holds the filters of all widths, and the softmax layer."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def mask() -> np.ndarray:
        """Filters narrower than the widest see only its first bytes."""
        mask = np.zeros((max(WIDTHS) * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, width in enumerate(WIDTHS):
            mask[: width * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        return mask

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each window (n x WINDOW bytes), and where."""
        n = len(windows)
        wide = np.concatenate([windows, np.zeros((n, max(WIDTHS) - 1), np.uint8)], axis=1)
        x = self.embed[wide].reshape(n, -1)
        view = np.lib.stride_tricks.sliding_window_view(x, max(WIDTHS) * EMBED, axis=1)[:, ::EMBED]
        response = view.reshape(-1, max(WIDTHS) * EMBED) @ self.filters
        response = response.reshape(n, -1, response.shape[1])
        return response.max(axis=1) + self.bias, response

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(windows)[0], 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(text: bytes) -> np.ndarray:
    """All of the text in rows of WINDOW bytes, the last one padded with zeros."""
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([data, np.zeros(-len(data) % WINDOW, np.uint8)]).reshape(-1, WINDOW)


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 3) -> ByteConv:
    """Adam on cross entropy over the windows of the texts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    parts = [windows_of(t.encode()) for t in texts]
    x = np.concatenate(parts)
    y = np.repeat([names.index(v) for v in labels], [len(p) for p in parts])
    k, width = len(names), max(WIDTHS) * EMBED
    mask = ByteConv.mask()
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask, "bias": np.zeros(mask.shape[1], np.float32),
        "out": rng.normal(0, 0.2, (mask.shape[1], k)).astype(np.float32), "out_bias": np.zeros(k, np.float32),
    }
    p["embed"][0] = 0
    moment = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in p.items()}
    rows_of = Counter(labels)
    weight = np.array([len(labels) / (k * rows_of[name]) for name in names], np.float32)
    # Each row's windows are as likely as another row's, whatever its length.
    chance = np.concatenate([np.full(len(q), 1 / len(q)) for q in parts])
    chance /= chance.sum()
    for step in range(1, steps + 1):
        rows = rng.choice(len(x), BATCH, p=chance)
        model = ByteConv(names, **p)
        pooled, response = model.pooled(x[rows])
        where = response.argmax(axis=1)
        hidden = np.maximum(pooled, 0)
        z = hidden @ p["out"] + p["out_bias"]
        z -= z.max(axis=1, keepdims=True)
        prob = np.exp(z)
        prob /= prob.sum(axis=1, keepdims=True)
        dz = prob
        dz[np.arange(len(rows)), y[rows]] -= 1
        dz *= (weight[y[rows]] / len(rows))[:, None]
        dh = (dz @ p["out"].T) * (pooled > 0)
        # Only the winning place of each filter carries gradient.
        n, f = dh.shape
        padded = np.concatenate([x[rows], np.zeros((n, max(WIDTHS) - 1), np.uint8)], axis=1)
        spots = where[:, :, None] + np.arange(max(WIDTHS))
        seen = padded[np.arange(n)[:, None, None], spots]
        patches = p["embed"][seen].reshape(n, f, width)
        grad = {"out": hidden.T @ dz, "out_bias": dz.sum(axis=0), "bias": dh.sum(axis=0), "filters": np.einsum("nfw,nf->wf", patches, dh) * mask, "embed": np.zeros_like(p["embed"])}
        back = (dh[:, :, None] * p["filters"].T[None]).reshape(n, f, max(WIDTHS), EMBED)
        np.add.at(grad["embed"], seen.ravel(), back.reshape(-1, EMBED))
        grad["embed"][0] = 0
        for name, g in grad.items():
            m, v = moment[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[name] -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteConv(names, **p)


def fit(rows: DataFrame, label: str = "lang", train_rows: int = TRAIN_ROWS, seed: int = 3) -> ByteConv | None:
    """Train on ``rows(doc_id, text, label)``: at most ``train_rows`` rows, as many of each label, or one of each label if
    there are more labels than that."""
    known = rows.filter(F.col(label).isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    known = known.select(F.col(label).alias("label"), "text", F.xxhash64("doc_id", F.lit(seed)).alias("_at"), "doc_id", F.xxhash64("text").alias("_text"))
    n_labels = known.agg(F.count_distinct("label")).first()[0]
    if not n_labels:
        return None
    # The least hashes of each label, so reruns agree. Ranks are limited in each task before the shuffle, and without texts;
    # only rows that come as early as a label's last one are read with theirs.
    each = max(1, train_rows // n_labels)
    first = Window.partitionBy("label").orderBy("_at", "doc_id", "_text")
    ranked = lambda df: df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= each)
    last = ranked(known.drop("text")).groupBy("label").agg(F.max("_at").alias("_last"))
    chosen = ranked(known.join(last, "label").filter(F.col("_at") <= F.col("_last")))
    sample = sorted(chosen.select("label", "text").collect())
    return train([r["text"] for r in sample], [r["label"] for r in sample], seed=seed)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(256, np.float32)
    table[ord("a") : ord("z") + 1] = table[ord("A") : ord("Z") + 1] = 1
    table[0x80:] = 0.5
    return table


def predict(model: ByteConv, texts: list[bytes], step: int = 64) -> list[tuple[str, float]]:
    """(label, score) of each text, over all of its windows, in batches of ``step`` windows."""
    total = np.zeros((len(texts), len(model.labels)))
    weight = np.zeros(len(texts))
    pending: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal held
        x, o = np.concatenate(pending), np.concatenate(owner)
        for at in range(0, len(x), step):
            w = _letters()[x[at : at + step]].sum(axis=1) + 1e-3
            np.add.at(total, o[at : at + step], model.log_probabilities(x[at : at + step]) * w[:, None])
            np.add.at(weight, o[at : at + step], w)
        pending.clear()
        owner.clear()
        held = 0

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), 1 << 20):
            rows = windows_of(text[at : at + (1 << 20)])
            pending.append(rows)
            owner.append(np.full(len(rows), i))
            held += len(rows)
            if held >= 4096:
                flush()
    if pending:
        flush()
    mean = total / np.maximum(weight, 1e-9)[:, None]
    mean = np.exp(mean - mean.max(axis=1, keepdims=True, initial=-1e9))
    mean /= mean.sum(axis=1, keepdims=True)
    return [(model.labels[k], float(min(1.0, mean[i, k]))) for i, k in enumerate(mean.argmax(axis=1))]


def identify(rows: DataFrame, model: ByteConv | None) -> DataFrame:
    """``rows`` with lang_pred and score; only the text is looked at."""
    names = [c for c in rows.columns if c not in ("lang_pred", "score", "_letters")]
    rows = rows.select(*[f"`{c}`" for c in names], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = rows.drop("_letters").schema.add("lang_pred", "string").add("score", "double")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            pred, score = [UND] * len(has), [0.0] * len(has)
            if model is not None and has.any():
                texts = batch.column(at).filter(batch.column(len(names))).cast(pa.binary()).to_pylist()
                for i, (label, s) in zip(np.flatnonzero(has).tolist(), predict(model, texts)):
                    pred[i], score[i] = label, s
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def keep_identified(rows: DataFrame, least: float = 0.3, label: str = "lang") -> DataFrame:
    """``rows`` whose text has an identifiable language: not ``und``, and a score of ``least`` or more.

    The model learns from the labelled rows themselves; without any, every text that has a letter stays.
    """
    model = fit(rows.select(column_or_null(rows, "doc_id", "long").alias("doc_id"), "text", F.col(label).alias("lang")))
    if model is None:
        return rows.filter(F.col("text").rlike(r"\p{L}"))
    # The row travels beside its text, so its columns keep their values whatever their names.
    held = rows.select("text", F.struct(*[f"`{c}`" for c in rows.columns if c != "text"]).alias("row"))
    kept = identify(held, model).filter((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in rows.columns])


def held_out(doc_id: Column) -> Column:
    """Fold 1 of 3 by the CRC-32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select(column_or_null(docs, "doc_id", "long").alias("doc_id"), column_or_null(docs, "text", "string").alias("text"), column_or_null(docs, "lang", "string").alias("lang"))
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
