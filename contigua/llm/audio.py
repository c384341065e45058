"""Media columns: audio features of 8-bit samples.

Payload bytes are stored as the samples of a WAV file, which holds them as they are.
Features of the stored samples: polyphase resampling by a rational factor, overlapped
log-mel filterbanks pooled to a tensor of fixed shape, and segments of high energy with
two thresholds (one to start, a lower one to go on), given as spans of time. Features
are stored as Arrow record batches whose tensor column has a fixed shape, and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contigua.session import cut, scratch_path, ship

PAD, UNIT = 32, 192
RATE, UP, DOWN = 12_000, 2, 3
FRAME, HOP, MELS, BINS = 256, 128, 20, 16
TAPS = 12  # of each phase
#: Frames worked on at a time, whatever the length.
RUN = 4096


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in bytes, and the bytes filled up with spaces to a positive multiple of the unit."""
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit samples; an odd number of them gets the byte of padding that the format asks for."""
    odd = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd


def from_wav(data: bytes) -> tuple[int, bytes]:
    """Rate and samples of a mono WAV file of 8-bit samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            if rate is None or at + 8 + n > len(data):
                raise ValueError("damaged WAV file")
            return rate, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The low-pass filter of a resampler, dealt out to its ``up`` phases (rows, time reversed)."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = cutoff * np.sinc(cutoff * t) * np.hamming(n)
    h = up * h / h.sum()
    return np.array([h[p::up][::-1] for p in range(up)], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS, out: int | None = None) -> np.ndarray:
    """``x``, preceded by ``taps - 1`` samples of history, at ``up/down`` times its rate."""
    have = len(x) - taps + 1
    out = have * up // down if out is None else out
    windows, h = sliding_window_view(x, taps), phases(up, down, taps)
    y = np.empty(out, np.float32)
    for m in range(up):  # outputs m, m + up, ... share a phase
        count = -(-(out - m) // up)
        at, phase = divmod(m * down, up)
        y[m::up] = windows[at : at + (count - 1) * down + 1 : down] @ h[phase]
    return y


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles of equal width on the mel scale over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    lo, mid, hi = points[:-2, None], points[1:-1, None], points[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T.astype(np.float32)


_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)
_BANK = mel_bank(RATE * UP / DOWN)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames (n x MELS) and each frame's energy in dB, one frame for each unit of samples."""
    raw = np.frombuffer(samples, np.uint8)
    step = HOP * DOWN // UP  # samples that a hop takes
    n = -(-len(raw) // step)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, RUN):
        b = min(n, a + RUN)
        lo, hi = a * step - (TAPS - 1), b * step + (FRAME - HOP) * DOWN // UP + DOWN
        x = np.zeros(hi - lo, np.float32)
        s, e = max(lo, 0), min(hi, len(raw))
        x[s - lo : e - lo] = (raw[s:e].astype(np.float32) - 128) / 128
        y = resample(x, out=(b - a) * HOP + FRAME - HOP)
        frames = sliding_window_view(y, FRAME)[::HOP][: b - a] * _WINDOW
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        mel[a:b] = np.log(power @ _BANK + 1e-6)
        energy[a:b] = 10 * np.log10((frames * frames).mean(1) + 1e-9)
    return mel, energy


def pooled(mel: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Means of ``bins`` spans of frames: a tensor of the same shape for every length."""
    n = len(mel)
    edges = np.arange(bins + 1) * n // bins
    if n < bins:
        return mel[np.minimum(edges[:-1], n - 1)]
    return (np.add.reduceat(mel.astype(np.float64), edges[:-1], axis=0) / np.diff(edges)[:, None]).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that rise above the upper threshold and stay above the lower one."""
    mean, spread = float(energy.mean()), float(energy.std())
    state = np.where(energy >= mean + 0.5 * spread + 1e-3, 1, np.where(energy < mean, -1, 0))
    at = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    on = np.concatenate(([0], np.where(at >= 0, state[at] == 1, 0), [0])).astype(np.int8)
    return [(int(a), int(b)) for a, b in np.flatnonzero(np.diff(on)).reshape(-1, 2)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (BINS, MELS))
SPANS = pa.list_(pa.struct([("start", pa.float32()), ("end", pa.float32())]))
#: What a stored batch holds.
STORED = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()), ("tensor", TENSOR), ("spans", SPANS),
])


def as_tensors(column: pa.Array | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The ``tensor`` column of ``features`` as an Arrow array of tensors of one shape."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(column.flatten(), BINS * MELS))


def to_ipc(batch: pa.RecordBatch) -> bytes:
    """A record batch as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.Table:
    """The rows of such a stream; its tensors must have the one shape."""
    table = pa.ipc.open_stream(data).read_all()
    if table.schema.field("tensor").type != TENSOR:
        raise ValueError(f"tensors of another shape: {table.schema.field('tensor').type}")
    return table


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table (doc_id, n_bytes, media) of WAV files in the shared folder, read back from there, one row per row.

    Null and empty texts are a unit of spaces. Repeated rows and null ids stay as they
    are, other columns are ignored, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                n, payload = payload_of(text)
                sizes.append(n)
                media.append(to_wav(payload))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")
    path = scratch_path(spark, "media")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def tensor_batches(media: DataFrame) -> DataFrame:
    """Features of a table (doc_id, n_bytes, media) as a stored table (batch) of Arrow streams of ``STORED`` rows."""
    ship(media.sparkSession)

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for data in b.column(2).to_pylist():
                rate, payload = from_wav(data)
                mel, energy = log_mel(payload)
                tensor, found = pooled(mel), segments(energy)
                second = HOP * DOWN / UP / rate
                whole = np.round(tensor * 8).astype("<i2").tobytes()
                active = sum(z - a for a, z in found)
                row = (
                    len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                    f"frames={len(mel)};segments={len(found)};active={active};mel={zlib.crc32(whole):08x}", tensor.ravel(), [{"start": a * second, "end": z * second} for a, z in found],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            if not len(b):
                continue
            tensors = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(cols[6])), BINS * MELS))
            made = [b.column(0), b.column(1), *[pa.array(c, STORED.field(i + 2).type) for i, c in enumerate(cols[:6])], tensors, pa.array(cols[7], SPANS)]
            yield pa.RecordBatch.from_arrays([pa.array([to_ipc(pa.RecordBatch.from_arrays(made, schema=STORED))], pa.binary())], names=["batch"])

    return cut(media.select("doc_id", "n_bytes", "media").mapInArrow(run, "batch binary"), "tensors")


def features(media: DataFrame) -> DataFrame:
    """Features of a table (doc_id, n_bytes, media), one row per row, as read back from the stored tensors.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, tensor (BINS x MELS floats, by rows) and spans (array of start and end in
    seconds). Null text is empty and has a unit of padding; equal texts have equal
    features, as each document is computed by itself. An empty table gives no rows.
    """
    stored = tensor_batches(media)

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                t = from_ipc(data)
                at = t.schema.get_field_index("tensor")
                t = t.set_column(at, "tensor", t.column(at).combine_chunks().storage.cast(pa.list_(pa.float32())))
                yield from t.to_batches()

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor array<float>, spans array<struct<start:float,end:float>>"
    return stored.mapInArrow(run, schema)
