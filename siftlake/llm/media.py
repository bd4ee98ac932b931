"""Audio columns: texts kept as 8-bit PCM, with log-mel tensors and energy segments.

A text's bytes are the samples of a mono WAV file, stored without loss.  Features come from the samples
read back: a polyphase resampler (3:2 by default), overlapped Hann frames through a mel filterbank in
log scale, and a hysteresis gate over frame energy.  Frames are grouped into fixed-shape Arrow tensors
with their time spans.  Long files go through in blocks that overlap by what the filters need.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 192


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 12000
    up: int = 2
    down: int = 3
    taps: int = 8  # of each phase of the resampler, per input sample
    frame: int = 256
    hop: int = 128
    mels: int = 16
    frames: int = 32  # of each tensor
    open_db: float = 18.0  # above the quietest tenth's level: a segment begins
    close_db: float = 12.0  # below: it ends
    block: int = 1 << 18


def to_wav(payload: bytes, rate: int) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono PCM file, by its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (channels, bits) != (1, 8):
                raise ValueError("8-bit mono is expected")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text) -> bytes:
    raw = C.utf8(text)
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


class Features:
    def __init__(self, config: AudioConfig) -> None:
        self.c = c = config
        n = 2 * c.taps * max(c.up, c.down) + 1
        t = np.arange(n) - (n - 1) / 2
        cutoff = 1.0 / max(c.up, c.down)
        kernel = cutoff * np.sinc(cutoff * t) * np.hamming(n)
        self.kernel = (kernel * c.up / kernel.sum()).astype(np.float64)
        self.window = np.hanning(c.frame + 1)[:-1]
        self.bank = self._bank(c.rate * c.up / c.down)
        self.schema = pa.schema([("tensor", pa.fixed_shape_tensor(pa.float32(), (c.frames, c.mels))), ("begin_ms", pa.float64()), ("end_ms", pa.float64())])

    def _bank(self, rate: float) -> np.ndarray:
        c = self.c
        top = 2595 * np.log10(1 + rate / 2 / 700)
        hz = 700 * (10 ** (np.linspace(0, top, c.mels + 2) / 2595) - 1)
        f = np.fft.rfftfreq(c.frame, 1 / rate)
        up = (f[None] - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
        down = (hz[2:, None] - f[None]) / (hz[2:] - hz[1:-1])[:, None]
        return np.maximum(0, np.minimum(up, down)).T.copy()

    def resampled(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of the resampled signal: y[m] = sum_k h[m * down - k * up + half] x[k], by phases."""
        c, h = self.c, self.kernel
        half = (len(h) - 1) // 2
        total = -(-len(x) * c.up // c.down)
        reach = half // c.up + 1
        phases = []
        for r in range(c.up):
            k = np.arange(-reach, reach + 1)
            at = r - k * c.up + half
            phases.append(np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0))
        span = 2 * reach + 1
        for first in range(0, total, c.block):
            m = np.arange(first, min(total, first + c.block))
            pos = m * c.down
            base, phase = pos // c.up, pos % c.up
            low, high = base[0] - reach, base[-1] + reach + 1
            part = np.zeros(high - low)
            a, b = max(low, 0), min(high, len(x))
            part[a - low : b - low] = x[a:b]
            windows = np.lib.stride_tricks.sliding_window_view(part, span)
            y = np.empty(len(m))
            for r in range(c.up):
                own = phase == r
                y[own] = windows[base[own] - base[0]] @ phases[r]
            yield y

    def log_mel(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-mel frames and frame levels in dB."""
        c = self.c
        mels, levels = [], []
        rest = np.empty(0)
        for y in [*self.resampled(x), None]:
            signal = rest if y is None else np.concatenate([rest, y])
            if y is None:
                if mels or not len(signal):
                    break
                signal = np.pad(signal, (0, max(0, c.frame - len(signal))))
            n = (len(signal) - c.frame) // c.hop + 1
            if n <= 0:
                rest = signal
                continue
            frames = np.lib.stride_tricks.sliding_window_view(signal, c.frame)[:: c.hop][:n]
            power = np.abs(np.fft.rfft(frames * self.window, axis=1)) ** 2
            mels.append(np.log(power @ self.bank + 1e-6).astype(np.float32))
            levels.append(10 * np.log10((frames**2).mean(axis=1) + 1e-9))
            rest = signal[n * c.hop :]
        if not mels:
            return np.zeros((1, c.mels), np.float32), np.full(1, -90.0)
        return np.concatenate(mels), np.concatenate(levels)

    def segments(self, levels: np.ndarray) -> list[tuple[int, int]]:
        """Frame spans where the level rose to open_db over the floor, until it falls under close_db."""
        floor = np.quantile(levels, 0.1)
        state = np.where(levels >= floor + self.c.open_db, 1, np.where(levels < floor + self.c.close_db, -1, 0))
        known = np.flatnonzero(state)
        if not len(known):
            return []
        at = np.searchsorted(known, np.arange(len(levels)), side="right") - 1
        on = np.where(at >= 0, state[known[np.maximum(at, 0)]] == 1, False)
        edge = np.diff(np.r_[0, on.astype(np.int8), 0])
        return [*zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]

    def stored(self, tensors: np.ndarray, spans: list[list[float]]) -> bytes:
        """An Arrow stream of one batch: fixed-shape tensors with the begin and end of each in ms."""
        column = pa.FixedShapeTensorArray.from_numpy_ndarray(tensors)
        ms = np.array(spans, np.float64)
        batch = pa.record_batch([column, pa.array(ms[:, 0]), pa.array(ms[:, 1])], schema=self.schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema) as writer:
            writer.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def of(self, media: bytes) -> dict:
        c = self.c
        _, payload = from_wav(media)
        x = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0) / 128.0
        mel, levels = self.log_mel(x)
        step = c.hop * c.down * 1000.0 / (c.up * c.rate)
        n = -(-len(mel) // c.frames)
        tensor = np.full((n * c.frames, c.mels), np.float32(np.log(1e-6)), np.float32)
        tensor[: len(mel)] = mel
        spans = self.segments(levels)
        return {
            "payload": payload,
            "tensors": self.stored(tensor.reshape(n, c.frames, c.mels), [[round(i * c.frames * step, 3), round(min((i + 1) * c.frames, len(mel)) * step, 3)] for i in range(n)]),
            "n_tensors": n,
            "segment_ms": [[round(a * step, 3), round(b * step, 3)] for a, b in spans],
            "summary": [round(float(v), 2) for v in mel.mean(axis=0, dtype=np.float64)],
            "n_frames": len(mel),
        }


def encode_audio(documents: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Rows (doc_id, n_bytes, media), one per input row: the text's bytes, padded with spaces to a positive
    multiple of 192, as an 8-bit WAV file.  Null is an empty text; a null id stays null; repeated rows fare
    alike, and an empty table gives no rows.  Other columns, whatever their names, aren't read.  No shuffle."""

    def run(frames):
        for pdf in C.pieces(frames, 512, 4 << 20):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [len(C.utf8(t)) for t in pdf["text"]],
                                "media": [to_wav(padded(t), config.rate) for t in pdf["text"]]})

    return C.steady(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


FEATURES = ("doc_id long, n_bytes long, media binary, payload binary, tensors binary, n_tensors long, segment_ms array<array<double>>, "
            "summary array<double>, n_frames long")


def read_tensors(stored: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The tensors of one row (number, frames, mels), and the begin and end of each in ms."""
    table = pa.ipc.open_stream(stored).read_all().combine_chunks()
    column = table["tensor"].chunk(0)
    return column.to_numpy_ndarray(), np.stack([table["begin_ms"].to_numpy(), table["end_ms"].to_numpy()], axis=1)


def audio_features(media: DataFrame, config: AudioConfig = AudioConfig()) -> DataFrame:
    """encode_audio's rows with the samples read back, `tensors` (an Arrow stream of fixed-shape tensors of
    frames x mels with their time spans, see read_tensors), energy segments in ms, the mean log-mel spectrum and
    the number of frames.

    Every value depends on the row's media alone, so equal files give equal features; an empty table gives no
    rows.  Spark has no type for tensors, so a row's are kept as the bytes of one Arrow batch.
    """

    def run(batches):
        own = Features(config)
        for batch in batches:
            ids, sizes, media_ = (batch.column(k) for k in ("doc_id", "n_bytes", "media"))
            for at in range(0, batch.num_rows, 128):
                files = media_.slice(at, 128)
                found = [own.of(m.as_py()) for m in files]
                pairs = pa.list_(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 128), sizes.slice(at, 128), files, pa.array([f["payload"] for f in found], pa.binary()), pa.array([f["tensors"] for f in found], pa.binary()),
                     pa.array([f["n_tensors"] for f in found], pa.int64()), pa.array([f["segment_ms"] for f in found], pairs),
                     pa.array([f["summary"] for f in found], pa.list_(pa.float64())), pa.array([f["n_frames"] for f in found], pa.int64())],
                    ["doc_id", "n_bytes", "media", "payload", "tensors", "n_tensors", "segment_ms", "summary", "n_frames"])

    return media.mapInArrow(run, FEATURES)


def digests(features: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's outputs."""
    return features.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.expr("crc32(substring(payload, length(payload) - 15, 16))").alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_frames").cast("string"), F.col("n_tensors").cast("string"), F.size("segment_ms").cast("string"),
                    F.substring(F.sha2(F.to_json(F.struct("segment_ms")), 256), 1, 16),
                    F.concat_ws(",", F.transform("summary", lambda v: F.format_number(v, 2)))).alias("feature"))
