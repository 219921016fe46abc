"""Language identification by a convolutional network over bytes.

Bytes (A to Z as a to z) are embedded; filters of several widths run over fixed-length windows; each filter's largest
response in a window feeds a softmax over the languages. The network is trained in numpy with Adam on a bounded sample of
labelled rows. A text is cut into windows over its whole length, and its probabilities are the windows' means by length.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import batches, ddl, documents, slices

WIDTHS, FILTERS, EMBEDDED, WINDOW = (2, 3, 4), 12, 6, 256
WIDEST = max(WIDTHS)
#: The sample that is learned from: labelled rows of a language, characters of a row, and characters in all; with many languages
#: each gets fewer rows, then shorter ones, but never less than a row of LEAST_CHARS, as the network itself grows with their number.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TOTAL, LEAST_CHARS = 500, 2048, 16 << 20, 64
#: Training steps at least, and windows that each language is seen in about.
STEPS, BATCH, SEEN = 400, 128, 2000
ALPHANUMERIC = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"
LOWER = bytes(range(256)).lower()


class Net:
    """`languages` in order, and the arrays `table` (bytes by EMBEDDED), `conv`, `bias`, `out`, `out_bias`."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        n, self.languages = FILTERS * len(WIDTHS), languages
        shape = {"table": (256, EMBEDDED), "conv": (WIDEST * EMBEDDED, n), "bias": (n,), "out": (n, len(languages)), "out_bias": (len(languages),)}
        self.weights = {k: (rng.standard_normal(s) * (0.5 if k == "table" else 0.25) * (len(s) > 1)).astype(np.float32) for k, s in shape.items()}
        #: A narrow filter is a wide one whose later rows are zero.
        self.mask = np.concatenate([np.repeat(np.arange(WIDEST) < w, EMBEDDED)[:, None] * np.ones((1, FILTERS)) for w in WIDTHS], axis=1).astype(np.float32)
        self.weights["conv"] *= self.mask

    def unfold(self, windows: np.ndarray) -> np.ndarray:
        """(windows, places, WIDEST * EMBEDDED): the embedded bytes under the filters at each place."""
        embedded = self.weights["table"][windows]
        places = windows.shape[1] - WIDEST + 1
        return np.concatenate([embedded[:, i : i + places] for i in range(WIDEST)], axis=2)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        under = self.unfold(windows)
        response = (under.reshape(-1, under.shape[2]) @ self.weights["conv"]).reshape(*under.shape[:2], -1)
        return under, response, np.maximum(response.max(axis=1) + self.weights["bias"], 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        score = self.pooled(windows)[2] @ self.weights["out"] + self.weights["out_bias"]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        w, rows = self.weights, np.arange(len(labels))
        under, response, pooled = self.pooled(windows)
        score = pooled @ w["out"] + w["out_bias"]
        score = np.exp(score - score.max(axis=1, keepdims=True))
        error = score / score.sum(axis=1, keepdims=True)
        error[rows, labels] -= 1
        error /= len(labels)
        back = (error @ w["out"].T) * (pooled > 0)
        at = response.argmax(axis=1)  # only a filter's strongest place learns
        chosen = under[rows[:, None], at]  # (windows, filters, WIDEST * EMBEDDED)
        to_bytes = (back[:, :, None] * w["conv"].T[None]).reshape(len(rows), -1, WIDEST, EMBEDDED)
        table = np.zeros_like(w["table"])
        np.add.at(table, windows[rows[:, None, None], at[:, :, None] + np.arange(WIDEST)], to_bytes)
        return {"out": pooled.T @ error, "out_bias": error.sum(axis=0), "bias": back.sum(axis=0), "conv": np.einsum("bf,bfk->kf", back, chosen) * self.mask, "table": table}


def prepared(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace").translate(LOWER), np.uint8)


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over whole texts (the last filled with zeros), the text of each, and its bytes. Windows overlap by WIDEST - 1, so no place is missed."""
    data = [prepared(t) for t in texts]
    step = WINDOW - WIDEST + 1
    counts = np.array([max(1, -(-(len(d) - WIDEST + 1) // step)) for d in data], np.int64)
    out, sizes, at = np.zeros((int(counts.sum()), WINDOW), np.uint8), [], 0
    for d, n in zip(data, counts.tolist(), strict=True):
        flat = np.zeros((n - 1) * step + WINDOW, np.uint8)
        flat[: len(d)] = d
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::step]
        sizes.append(np.clip(len(d) - np.arange(n) * step, 1, WINDOW))
        at += n
    return out, np.repeat(np.arange(len(data)), counts), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def train(rows: list[tuple[str, str]], steps: int | None = None, seed: int = 0) -> Net:
    """A network for (text, language) rows. Each step takes as many windows of each language, from random places."""
    languages = sorted({lang for _, lang in rows})
    steps = steps or max(STEPS, len(languages) * SEEN // BATCH)
    net, rng = Net(languages, seed), np.random.default_rng(seed)
    if len(languages) < 2:
        return net
    by_language = [[d for t, lang in rows if lang == own and len(d := prepared(t))] or [np.zeros(1, np.uint8)] for own in languages]
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=BATCH)
        windows = np.zeros((BATCH, WINDOW), np.uint8)
        for i, label in enumerate(labels):
            d = by_language[label][rng.integers(len(by_language[label]))]
            size = int(rng.integers(24, WINDOW + 1))  # short ones too, as short texts have nothing else
            start = int(rng.integers(max(1, len(d) - size + 1)))
            piece = d[start : start + size]
            windows[i, : len(piece)] = piece
        rate = 0.02 * (1 - step / (steps + 1))
        for k, g in net.gradients(windows, labels).items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    """Whether any character is a letter (of a category L); letter-like numbers, such as ² and Ⅷ, are not."""
    return any(m.group().isalpha() for m in ALPHANUMERIC.finditer(text))


def predict(net: Net, texts: list[str | None], at_once: int = 512) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text; UNDETERMINED and 0.0 for null, for a text without a letter, and where nothing was learned."""
    found = [(UNDETERMINED, 0.0)] * len(texts)
    able = [i for i, t in enumerate(texts) if t and has_letter(t)] if net.languages else []
    if able:
        windows, owner, sizes = windows_of([texts[i] for i in able])
        total, weight = np.zeros((len(able), len(net.languages))), np.bincount(owner, sizes, len(able))
        for first in range(0, len(windows), at_once):
            part = slice(first, first + at_once)
            np.add.at(total, owner[part], net.probabilities(windows[part]) * sizes[part, None])
        mean = total / weight[:, None]
        for i, row in zip(able, mean, strict=True):
            best = int(row.argmax())
            found[i] = (net.languages[best], min(1.0, round(float(row[best]), 6)))
    return [x[0] for x in found], [x[1] for x in found]


def held_out() -> F.Column:
    """Whether a row's label may not be learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def sample_size(languages: int, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> tuple[int, int]:
    """(rows of each language, characters of each row) that keep a sample within `total` characters."""
    chars = max(LEAST_CHARS, min(chars, total // max(1, languages)))
    return max(1, min(rows, total // (max(1, languages) * chars))), chars


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL) -> Net:
    """A network for every language of the rows that may be learned from.

    It learns from a bounded sample: see sample_size. Of each language those rows are taken whose hash of doc_id and text is
    least, so neither the order of rows nor scheduling plays a part, and rows that are repeated count once. Rows with a null
    doc_id, text or lang are not learned from; where there are no others, and for an empty table, the network knows no language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Net([])
    rows, chars = sample_size(len(counts), rows, chars, total)
    # twice as many are drawn as are wanted, for a share of the hashes only tells about how many that is
    share = F.from_json(F.lit(json.dumps({lang: min(1.0, 2 * rows / n) for lang, n in counts})), "map<string, double>")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 40))
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - chars)).cast("int") + 1
    drawn = known.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 40)).select("lang", "draw", F.col("text").substr(place, F.lit(chars)).alias("piece"))
    once = drawn.groupBy("lang", "draw").agg(F.min("piece").alias("piece"))
    first = once.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("nth") <= rows)
    return train(sorted(map(tuple, first.select("piece", "lang").collect())))


def identify(docs: DataFrame, net: Net, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of `docs`, and the columns `keep` as they are; others are ignored.

    A null or empty text, or one without a letter, is UNDETERMINED with score 0. Texts are read whole, however long. Repeated
    rows have a row each; a null doc_id is not held out. Of languages that are equally probable the first in order is taken.
    An empty table gives none."""
    names = ["doc_id", "held_out", "lang_pred", "score", *keep]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                lang, score = predict(net, batch.column(2).to_pylist())
                yield pa.record_batch([*batch.columns[:2], pa.array(lang, pa.string()), pa.array(score, pa.float64()), *batch.columns[3:]], names=names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("__text"), *keep)
    return batches(read, rows, "doc_id long, held_out boolean, lang_pred string, score double" + ddl(docs, list(keep)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the language of every document."""
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))


QUERIES = {"op6_byte_cnn": query}
