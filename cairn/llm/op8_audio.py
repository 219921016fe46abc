"""Audio features: polyphase resampling, overlapped log-mel filterbanks, and segmentation by energy with hysteresis.

A recording is 8-bit mono PCM in a WAV file. Samples are resampled from RATE by UP / DOWN, so a block of 192 samples becomes
a hop of 128; a frame is two hops under a Hann window, a hop apart. Frames are stored as Arrow tensors of a fixed shape (FRAMES, BANDS),
the last one filled up with silence, each with the time span that it covers, beside the spans that are active: a table of
them is written, and what is asked of features is read from it. Everything is computed a recording at a time and in pieces of a fixed number of frames, so equal recordings give equal bytes whatever
shares their batch, and a very long one takes no more memory than its bytes and features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import batches, documents, kept, slices, texts

RATE, UP, DOWN = 12_000, 2, 3
BLOCK, HOP = 192, 128
BANDS, FRAMES = 24, 32
#: Taps of the low-pass filter for each output phase; its middle as a share of the input's half rate, and its window's shape: what
#: lies above the output's half rate is let through at -55 dB or less, what lies below three quarters of that within 0.1 dB.
TAPS, MIDDLE, BETA = 48, 0.59, 5.65
#: Frames that are computed at a time.
AT_ONCE = 2048
WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def low_pass() -> np.ndarray:
    """The windowed-sinc filter (Kaiser's window) by output phase: (TAPS, UP), for input samples from DOWN * k - TAPS // 2 on."""
    places = np.arange(TAPS)[:, None] - TAPS // 2 - np.arange(UP)[None, :] * DOWN / UP
    window = np.i0(BETA * np.sqrt(np.maximum(0, 1 - (places / (TAPS / 2 + DOWN / 2)) ** 2)))
    taps = np.sinc(MIDDLE * places) * window
    return (taps / taps.sum(axis=0)).astype(np.float32)


def mel_bank(size: int = 2 * HOP, rate: float = RATE * UP / DOWN) -> np.ndarray:
    """Triangular filters, evenly spaced in mel: (size // 2 + 1, BANDS)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(size, 1 / rate)[:, None]
    left, centre, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - left) / (centre - left), (right - bins) / (right - centre))).astype(np.float32)


FILTER, MEL, HANN = low_pass(), mel_bank(), np.hanning(2 * HOP + 1)[:-1].astype(np.float32)


def to_wav(samples: bytes) -> bytes:
    """A WAV file of 8-bit mono samples (an even number of them)."""
    return WAV.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    """The samples of what to_wav made."""
    head = WAV.unpack_from(media)
    if (head[0], head[2], head[3], head[11]) != (b"RIFF", b"WAVE", b"fmt ", b"data") or head[5:7] != (1, 1) or head[10] != 8 or head[12] != len(media) - WAV.size:
        raise ValueError("not an 8-bit mono WAV file")
    return media[WAV.size :]


def resample(samples: np.ndarray) -> np.ndarray:
    """UP output samples for each DOWN of `samples`, which has TAPS // 2 more before them and TAPS after."""
    windows = np.lib.stride_tricks.sliding_window_view(samples, TAPS)[: len(samples) - TAPS - TAPS // 2 : DOWN]
    return (np.ascontiguousarray(windows) @ FILTER).reshape(-1)


def log_mel(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, BANDS) log-mel values in hundredths of a decibel as int16, and the frames' energies.

    Frame k covers blocks k - 1 and k; there is silence before the first and after the last, so each block is in two frames."""
    raw = np.frombuffer(payload, np.uint8)
    count = -(-len(raw) // BLOCK) + 1
    whole = np.full(TAPS // 2 + (count + 2) * BLOCK + TAPS, 128, np.uint8)
    whole[TAPS // 2 + BLOCK : TAPS // 2 + BLOCK + len(raw)] = raw
    values, energies = [], []
    for first in range(0, count, AT_ONCE):
        n = min(AT_ONCE, count - first)
        part = whole[first * BLOCK : (first + n + 1) * BLOCK + TAPS + TAPS // 2].astype(np.float32)
        sound = resample((part - 128) / 128)
        frames = np.lib.stride_tricks.sliding_window_view(sound, 2 * HOP)[::HOP][:n] * HANN
        spectrum = np.fft.rfft(frames.astype(np.float64), axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ MEL
        values.append(np.rint(1000 * np.log10(power.astype(np.float64) + 1e-6)).astype(np.int16))
        energies.append(10 * np.log10(power.sum(axis=1, dtype=np.float64) + 1e-6))
    return np.concatenate(values), np.concatenate(energies).round(3)


def active(energies: np.ndarray, above: float = 0.5, below: float = 0.5) -> list[tuple[int, int]]:
    """Runs of frames (end exclusive) that begin where energy passes mean + above deviations and last until it falls under mean - below deviations."""
    if not len(energies):
        return []
    mean, spread = float(energies.mean()), float(energies.std())
    loud, quiet = energies > mean + above * spread, energies < mean - below * spread
    last = np.maximum.accumulate(np.where(loud | quiet, np.arange(len(energies)), -1))
    on = np.where(last >= 0, loud[last], False).astype(np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SECOND = RATE / BLOCK  # frames


def tensors(values: np.ndarray) -> pa.RecordBatch:
    """Values as fixed-shape tensors (FRAMES, BANDS), each with its time span in seconds (from its first frame's middle to
    that of the frame after its last) and how many of its frames are real."""
    n = -(-len(values) // FRAMES)
    filled = np.full((n * FRAMES, BANDS), -6000, np.int16)
    filled[: len(values)] = values
    starts = np.arange(n) * FRAMES
    stops = np.minimum(starts + FRAMES, len(values))
    return pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(filled.reshape(n, FRAMES, BANDS)) if n else pa.array([], pa.fixed_shape_tensor(pa.int16(), [FRAMES, BANDS]).storage_type), pa.array(starts / SECOND), pa.array(stops / SECOND), pa.array(stops - starts)], names=["log_mel", "start_s", "end_s", "frames"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def recordings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each row's text (null: empty) as UTF-8, filled with blanks to a positive multiple of BLOCK, as a WAV file.

    Texts are kept whole; repeated rows have a row each, a null doc_id stays, other columns are ignored, an empty table gives none."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                raw = batch.column(1).cast(pa.binary()).to_pylist()
                media = [to_wav(x.ljust(max(1, -(-len(x) // BLOCK)) * BLOCK)) for x in raw]
                yield pa.record_batch([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return batches(texts(docs), rows, "doc_id long, n_bytes long, media binary")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary, spans array<struct<start_s: double, end_s: double>>"


def featured(stored: DataFrame) -> DataFrame:
    """`stored` (doc_id, n_bytes, media) with payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, the
    features as an Arrow stream of tensors, and the active spans in seconds. A row for each row, repeated ones included; a
    null doc_id stays, other columns are ignored, an empty table gives none."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in slices(whole):
                out = []
                for media in batch.column(2).to_pylist():
                    payload = from_wav(media)
                    values, energies = log_mel(payload)
                    spans = [{"start_s": a / SECOND, "end_s": b / SECOND} for a, b in active(energies)]
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), to_ipc(tensors(values)), spans))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch([*batch.columns[:2], *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors", "spans"])

    return batches(stored.select("doc_id", "n_bytes", "media"), rows, STORED)


def from_ipc(data: bytes) -> pa.RecordBatch:
    """The tensors of a recording, with their time spans, as to_ipc stored them."""
    with pa.ipc.open_stream(data) as stored:
        if stored.schema.field("log_mel").type != pa.fixed_shape_tensor(pa.int16(), [FRAMES, BANDS]):
            raise ValueError(f"not tensors of shape {FRAMES} x {BANDS}")
        return next(iter(stored))


def digest(stored: bytes, spans: list[dict]) -> str:
    """What stored features hold, as text: the number of frames and of active spans, the mean of each quarter of the bands in
    decibels, and a sha256 of all values and spans, in that order."""
    batch = from_ipc(stored)
    frames = batch.column("frames").to_numpy()
    values = batch.column("log_mel").to_numpy_ndarray()
    real = values.reshape(-1, BANDS)[: int(frames.sum())]
    sums = real.reshape(len(real), 4, -1).astype(np.int64).sum(axis=(0, 2)) / (max(1, len(real)) * BANDS // 4 * 100)
    sha = hashlib.sha256(values.tobytes() + batch.column("start_s").to_numpy().tobytes() + batch.column("end_s").to_numpy().tobytes() + frames.tobytes())
    sha.update(np.array([(s["start_s"], s["end_s"]) for s in spans], np.float64).tobytes())
    return ":".join([str(len(real)), str(len(spans)), *(f"{x:.2f}" for x in sums), sha.hexdigest()])


def described(features: DataFrame) -> DataFrame:
    """The rows of `features`, as featured() makes them and a store gave them back, with `feature` (see digest) for tensors and spans."""
    names = [*features.columns[:7], "feature"]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [digest(t, s) for t, s in zip(batch.column(7).to_pylist(), batch.column(8).to_pylist(), strict=True)]
            yield pa.record_batch([*batch.columns[:7], pa.array(found, pa.string())], names=names)

    return batches(features, rows, STORED.partition(", tensors")[0] + ", feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every text as a stored recording, read back; its features stored as tensors with time spans, read back as well."""
    media = kept(recordings(documents(spark, sf_dir)), "media", compression="zstd")
    return described(kept(featured(media), "features", compression="zstd"))


QUERIES = {"op8_audio": query}
