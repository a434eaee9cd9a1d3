"""Media columns: payload bytes kept as 8-bit WAV, and spectral-peak pair fingerprints of what is read back.

A WAV column is written and read with the wave module, one unsigned 8-bit sample per byte. The fingerprint takes
a short-time Fourier transform with a Hann window, finds in each band of each frame the strongest frequency, keeps
those that are peaks in time too, and pairs each with those of higher bands in its frame and with the peaks of the frames just after it. A pair is a code of both
frequencies and their distance in time; pairs are kept as two arrays, time and code.

The transform is a product with a table of windowed sines and cosines rounded to whole numbers, so every sum is an exact
whole number in single precision: equal payloads have equal fingerprints on any machine and in any batch.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docgrove.llm.tables import narrow
from docgrove.llm.words import text_column

UNIT, PAD, RATE = 192, b" ", 8000
FRAME, HOP, BANDS, REACH = 256, 128, 4, 3
SILENCE = 128
#: Frames transformed at once, so that a very long payload needs no more memory than a short one.
_AT_ONCE = 1 << 13


def _table() -> np.ndarray:
    place = np.arange(FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * place / FRAME)
    turn = 2 * np.pi * np.outer(place, np.arange(1, FRAME // 2 + 1)) / FRAME
    return np.rint(127 * np.hstack([window[:, None] * np.cos(turn), window[:, None] * np.sin(turn)])).astype(np.float32)


_TABLE = _table()


def payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and those bytes filled up with spaces to a positive multiple of UNIT."""
    data = text.encode()
    return len(data), data + PAD * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def to_wav(data: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band: the number of the strongest frequency in the band, and its power."""
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    padded = np.full((n - 1) * HOP + FRAME, SILENCE, np.uint8)
    padded[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    bins, powers = [], []
    for at in range(0, n, _AT_ONCE):
        both = (frames[at : at + _AT_ONCE].astype(np.float32) - SILENCE) @ _TABLE
        power = both[:, : FRAME // 2].astype(np.float64) ** 2 + both[:, FRAME // 2 :].astype(np.float64) ** 2
        power = power.reshape(len(power), BANDS, -1)
        best = power.argmax(axis=2)
        bins.append(best + np.arange(BANDS) * power.shape[2])
        powers.append(np.take_along_axis(power, best[:, :, None], 2)[:, :, 0])
    return np.concatenate(bins), np.concatenate(powers)


def fingerprint(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of all pairs of spectral peaks, by time."""
    bins, powers = band_peaks(np.frombuffer(data, np.uint8))
    peak = powers > 0
    peak[1:] &= powers[1:] > powers[:-1]
    peak[:-1] &= powers[:-1] >= powers[1:]
    times, codes = [], []
    for band in range(BANDS):  # within a frame: all that a payload of one frame has
        for other in range(band + 1, BANDS):
            at = np.flatnonzero(peak[:, band] & peak[:, other])
            times.append(at)
            codes.append((bins[at, band] << 11) | (bins[at, other] << 4))
    for gap in range(1, REACH + 1):
        for step in range(BANDS):
            after = np.roll(bins, -step, axis=1)
            both = peak[:-gap] & np.roll(peak, -step, axis=1)[gap:]
            at, band = np.nonzero(both)
            times.append(at)
            codes.append((bins[at, band] << 11) | (after[at + gap, band] << 4) | gap)
    times, codes = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def media_columns(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a WAV file in a binary column. Null counts as empty, which is
    one unit of spaces. Every row has a row, with or without an id; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [payload(t.as_py()) for t in text_column(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([to_wav(d) for _, d in made], pa.binary())],
                [id_column, "n_bytes", "media"],
            )

    return narrow(docs, id_column, text).mapInArrow(run, f"`{id_column}` long, n_bytes long, media binary")


def _features(media: DataFrame, id_column: str, schema: str, values) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [values(m.as_py()) for m in batch.column("media")]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            kinds = [types[part.strip().split(" ")[1]] for part in schema.split(",")]
            arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], [id_column, "n_bytes", *names])

    return media.select(id_column, "n_bytes", "media").mapInArrow(run, f"`{id_column}` long, n_bytes long, {schema}")


def fingerprints(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, times, codes) of a media column."""
    return _features(media, id_column, "times array<int>, codes array<int>", lambda m: fingerprint(from_wav(m)))


def digests(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload and media sizes and hashes, feature): feature is the number of pairs and a hash of them."""

    def values(media: bytes):
        data = from_wav(media)
        times, codes = fingerprint(data)
        pairs = hashlib.sha256(np.concatenate([times, codes]).astype("<i4").tobytes()).hexdigest()
        return (
            len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media),
            hashlib.sha256(media).hexdigest(), f"{len(times)}:{pairs}",
        )

    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _features(media, id_column, schema, values)
