"""Media columns: 8-bit audio and its features.

``store`` lays payloads down losslessly as 8-bit mono WAV in a Parquet media table; ``features`` reads
the stored bytes back and computes, a row a clip: a polyphase resampling (16 000 to 6 000 Hz), log-mel
filterbanks of overlapping frames cut into tensors of the fixed shape ``TENSOR``, their time spans, and
the active segments of a hysteresis on the frame energy. A clip's tensors and spans are one Arrow stream, with the
tensors in Arrow's fixed-shape tensor type in 16-bit floats, so that they can be read anywhere without this
module; ``stored_features`` keeps these streams in a Parquet table and opens it again, ``tensors_of_clip`` reads one.

Defined cases: null or empty text is 64 zero bytes; a clip shorter than a frame has one padded frame; a
constant clip has no active segment; equal clips give equal values, as each clip is computed alone; long
clips are computed in blocks; an empty table gives an empty result; further columns are passed by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import written

RATE_IN, RATE = 16_000, 6_000
UP, DOWN = 3, 8
#: Filter taps a phase, frame and hop in samples, FFT size, mel bands; frames a tensor.
TAPS, FRAME, HOP, FFT, MELS = 24, 150, 60, 256, 20
TENSOR = (64, MELS)
#: An Arrow stream of a clip: a tensor and its time span a row.
CLIP = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float16(), TENSOR)), ("start", pa.float64()), ("end", pa.float64())])
#: Frames computed at once.
BLOCK = 16_384
UNIT = 64

FEATURES = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, "
    "n_tensors long, tensors binary, segments array<struct<start:double,end:double>>"
)


def to_wav(samples: bytes, rate: int = RATE_IN) -> bytes:
    """``samples`` (unsigned 8 bit, mono) with a RIFF header."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def _low_pass() -> np.ndarray:
    """(phase, tap): a Hann-windowed sinc at the lower of both Nyquist rates, split into phases."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * UP).reshape(TAPS, UP).T[:, ::-1].astype(np.float32).copy()


def _mel_bank() -> np.ndarray:
    """(bin, band): triangles evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    left, mid, right = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f[:, None] - left) / (mid - left), (right - f[:, None]) / (right - mid))).astype(np.float32)


PHASES, BANK, WINDOW = _low_pass(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """UP / DOWN times the rate: output n is the dot product of phase n * DOWN mod UP with the inputs about it."""
    n_out = -(-len(samples) * UP // DOWN)
    x = np.concatenate([np.zeros(TAPS // 2, np.float32), samples, np.zeros(TAPS + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)
    out = np.empty(n_out, np.float32)
    for first in range(min(UP, n_out)):
        at = np.arange(first, n_out, UP) * DOWN
        out[first::UP] = windows[at[0] // UP :: DOWN][: len(at)] @ PHASES[at[0] % UP]
    return out


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and log energy of each frame."""
    n = 1 + max(0, -(-(len(signal) - FRAME) // HOP))
    x = np.concatenate([signal, np.zeros((n - 1) * HOP + FRAME - len(signal), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, BLOCK):
        part = frames[a : a + BLOCK] * WINDOW
        spectrum = np.fft.rfft(part, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mels[a : a + BLOCK] = np.log(power.astype(np.float32) @ BANK + 1e-6)
        energy[a : a + BLOCK] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return mels, energy


def hysteresis(energy: np.ndarray, spread: float = 0.5) -> list[tuple[int, int]]:
    """[start, end) of the runs that rise above mean + spread * deviation, held until below mean - spread * deviation."""
    middle, deviation = float(energy.mean()), float(energy.std())
    if deviation < 1e-6:
        return []
    high, low = energy > middle + spread * deviation, energy < middle - spread * deviation
    marks = np.flatnonzero(high | low)
    state = np.repeat(high[marks], np.diff(np.append(marks, len(energy)))) if len(marks) else np.zeros(0, bool)
    active = np.concatenate([np.zeros(len(energy) - len(state), bool), state])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors_of(mels: np.ndarray) -> np.ndarray:
    """(k, *TENSOR), the last one filled up with the least value of the scale."""
    k = -(-len(mels) // TENSOR[0])
    out = np.full((k * TENSOR[0], MELS), np.float32(np.log(1e-6)), np.float32)
    out[: len(mels)] = mels
    return out.reshape(k, *TENSOR)


def clip_stream(tensors: np.ndarray, spans: np.ndarray) -> bytes:
    """The Arrow stream of (k, *TENSOR) tensors and (k, 2) spans."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.astype(np.float16).reshape(-1)), TENSOR[0] * TENSOR[1])
    columns = [pa.ExtensionArray.from_storage(CLIP.field("tensor").type, flat), pa.array(spans[:, 0]), pa.array(spans[:, 1])]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CLIP) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=CLIP))
    return sink.getvalue().to_pybytes()


def tensors_of_clip(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((k, *TENSOR) tensors, (k, 2) spans in seconds) of a stored Arrow stream."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    column = table.column("tensor").chunk(0)
    return column.to_numpy_ndarray(), np.stack([table.column("start").to_numpy(), table.column("end").to_numpy()], 1)


def describe(media: bytes) -> tuple:
    """A row of FEATURES from stored bytes."""
    payload = from_wav(media)
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(samples))
    tensors, step = tensors_of(mels), HOP / RATE
    first = np.arange(len(tensors)) * TENSOR[0]
    spans = np.stack([first, np.minimum(first + TENSOR[0], len(mels))], 1) * step
    segments = [{"start": a * step, "end": b * step} for a, b in hysteresis(energy)]
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(),
        len(mels), len(tensors), clip_stream(tensors, spans), segments,
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table (id, n_bytes, media), written to the shared folder and opened again."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                media = pa.array([to_wav(padded(t)) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), media], ["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    stored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, f"id {kind}, n_bytes long, media binary")
    return written(stored.withColumnRenamed("id", id_col), compression="zstd")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, FEATURES) of a media table."""
    kinds = dict(part.split(" ", 1) for part in FEATURES.split(", "))
    struct_type = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                columns = zip(*[describe(m.as_py()) for m in part.column("media")])
                made = [pa.array(list(c), arrow.get(kind, struct_type)) for c, kind in zip(columns, kinds.values())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *made], ["id", "n_bytes", *kinds])

    kind = media.schema[id_col].dataType.simpleString()
    out = media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(compute, f"id {kind}, n_bytes long, {FEATURES}")
    return out.withColumnRenamed("id", id_col)


def stored_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``features`` of a media table, kept in a Parquet table in the shared folder and opened again."""
    return written(features(media, id_col), compression="zstd")
