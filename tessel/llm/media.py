"""Media columns: texts as WAV files, short-time Fourier transforms, and fingerprints of spectral-peak pairs.

A payload is stored as 8-bit mono samples by the wave module and read back from the stored bytes. Of each frame's magnitude spectrum
the strongest bin of each band is a peak if it is over twice the band's mean; frames overlap by half; each peak is paired with the peaks of the next frames. A pair's
code holds both bins and the distance in frames; codes are stored with the frame they start at.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import blocks as B

UNIT, PAD = 576, 255
RATE, FRAME, HOP = 8000, 512, 256
BANDS = ((1, 16), (16, 48), (48, 128), (128, 257))
FANOUT = 3  # frames ahead that a peak is paired with
CHUNK = 2048  # frames at a time


def to_wav(data: bytes) -> tuple[bytes, int]:
    """The WAV file of data padded to a positive multiple of UNIT, and the payload's length."""
    payload = data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue(), len(payload)


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples expected")
        return f.readframes(f.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peaks(samples: np.ndarray) -> np.ndarray:
    """frames x bands: the bin of each band's peak, or -1. A frame begins every HOP samples; the last ones are filled up with silence (128)."""
    frames = -(-len(samples) // HOP)
    out = np.full((frames, len(BANDS)), -1, np.int16)
    for a in range(0, frames, CHUNK):
        n = min(CHUNK, frames - a)
        x = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
        part = samples[a * HOP : a * HOP + len(x)]
        x[: len(part)] = part
        x = (np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP].astype(np.float32) - 128) * _WINDOW
        mag = np.abs(np.fft.rfft(x, axis=1))
        for k, (lo, hi) in enumerate(BANDS):
            m = mag[:, lo:hi]
            best = m.argmax(1)
            strong = m[np.arange(n), best] > 2 * m.mean(1)
            out[a : a + n, k] = np.where(strong, best + lo, -1)
    return out


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and codes of all peak pairs, in order of frame: code = bin << 13 | other bin << 4 | frames between."""
    p = peaks(samples)
    times, codes = [], []
    for step in range(1, FANOUT + 1):
        for a in range(len(BANDS)):
            for b in range(len(BANDS)):
                x, y = p[: len(p) - step, a].astype(np.int64), p[step:, b].astype(np.int64)
                at = np.flatnonzero((x >= 0) & (y >= 0)) if len(p) > step else np.zeros(0, np.int64)
                times.append(at)
                codes.append(x[at] << 13 | y[at] << 4 | step)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, feature string, peak_times array<int>, peak_codes array<int>"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
OUT = 1 << 22  # bytes of text whose columns are handed on together


def describe(data: bytes) -> tuple:
    """The columns of SCHEMA for one text."""
    media, _ = to_wav(data)
    payload = from_wav(media)
    t, c = fingerprint(np.frombuffer(payload, np.uint8))
    digest = zlib.crc32(c.tobytes(), zlib.crc32(t.tobytes()))
    feature = f"{-(-len(payload) // HOP)}:{len(t)}:{digest:08x}"
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media, feature, t, c


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of SCHEMA added; columns of these names are replaced.

    media: the WAV file; the columns before it but n_bytes, and those behind it, come from the samples read back from it. peak_times, peak_codes: the fingerprint, a code for each
    pair of peaks and the frame it starts at (frames begin every HOP samples), in order of frame and code; feature: number of frames, number of pairs, CRC-32 of both arrays.
    A null text is empty. An empty text's payload is UNIT bytes of 255; a text whose length is a positive multiple of UNIT gets no
    padding. Equal texts get equal values; memory follows the longest text, whose spectra are made CHUNK frames at a time."""
    names = StructType.fromDDL(SCHEMA).fields
    docs = docs.drop(*[f.name for f in names])
    schema = StructType([*docs.schema.fields, *names])

    @B.trimmed
    def run(batches):
        for batch in batches:
            for part in B.cut(batch, text, OUT):
                rows = [describe((x or "").encode()) for x in part.column(text).to_pylist()]
                cols = zip(*rows, strict=True) if rows else [[] for _ in names]
                made = [pa.array(list(c), kind) for c, kind in zip(cols, _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
