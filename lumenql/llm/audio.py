"""Audio features of byte payloads kept as 8-bit media.

A payload is stored losslessly as an 8-bit mono WAV clip.  The clip is read back, resampled by a
polyphase filter, cut into overlapping frames, and each frame becomes a row of log-mel energies; frame
energies under a hysteresis rule give segments.  Features are stored as Arrow tensors of one
fixed shape, each with its time span.  Filters and levels are integers, so equal payloads have equal features.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenql.llm import kernel as K
from lumenql.llm.shared import saved, ship


@dataclass(frozen=True)
class AudioRule:
    """Rate of the clip, resampling up / down, taps of a phase, frame and hop, mel bands, frames of a tensor,
    and the hysteresis levels in thirty-seconds of a decade over the median."""

    rate: int = 8000
    up: int = 3
    down: int = 8
    taps: int = 16
    frame: int = 128
    hop: int = 64
    bands: int = 16
    frames: int = 32
    on_level: int = 8
    off_level: int = 2
    pad: int = 64


def payload_of(data: bytes, pad: int = 64) -> bytes:
    """The bytes and zeros up to a positive multiple of `pad`."""
    return data + bytes(max(pad, -(-len(data) // pad) * pad) - len(data))


def to_wav(payload: bytes, rate: int) -> bytes:
    """A RIFF clip of unsigned 8-bit mono samples."""
    form = struct.pack("<HHIIHH", 1, 1, rate, rate, 1, 8)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + bytes(len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def from_wav(clip: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a clip of to_wav()'s kind."""
    if clip[:4] != b"RIFF" or clip[8:12] != b"WAVE":
        raise ValueError("not a RIFF clip")
    at, rate = 12, 0
    while at + 8 <= len(clip):
        name, size = clip[at : at + 4], struct.unpack_from("<I", clip, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", clip, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono only")
        elif name == b"data":
            return rate, clip[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(4)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Integer taps of each phase of a Hann-windowed low pass at the lower of both Nyquist rates."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1.0 / max(up, down)
    h = np.sinc(t * cut) * cut * up * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))
    return np.round(h.reshape(taps, up).T * (1 << 12)).astype(np.int32)


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """up / down of the rate: output k is phase (k * down) % up of the filter at input (k * down) // up, in 1/4096."""
    bank = _phases(up, down, taps)
    half = taps // 2
    padded = np.concatenate([np.zeros(half, np.int32), x.astype(np.int32), np.zeros(taps, np.int32)])
    many = -(-len(x) * up // down)
    out = np.empty(many, np.int32)
    rows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for first in range(min(up, many)):
        at = first * down // up
        part = rows[at::down][: len(range(first, many, up))]
        phase = bank[first * down % up][::-1]
        y = part[:, 0] * phase[0]
        for t in range(1, taps):
            y += part[:, t] * phase[t]
        out[first::up] = y
    return out


@lru_cache(4)
def _mel(bands: int, frame: int, rate: float) -> np.ndarray:
    """Triangular bands, evenly spaced in mel, over the bins of a frame."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1) * frame / rate
    bins = np.arange(frame // 2 + 1)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((bins - low) / np.maximum(mid - low, 1e-9), (high - bins) / np.maximum(high - mid, 1e-9))) + 1e-6


def log_mel(x: np.ndarray, rule: AudioRule, block: int = 1 << 13) -> np.ndarray:
    """Rows of overlapping frames: mel energies in thirty-seconds of a decade, as int16; `block` frames at a time."""
    if len(x) < rule.frame:
        x = np.concatenate([x, np.zeros(rule.frame - len(x), x.dtype)])
    frames = np.lib.stride_tricks.sliding_window_view(x, rule.frame)[:: rule.hop]
    bank, window, out = _mel(rule.bands, rule.frame, rule.rate * rule.up / rule.down), np.hanning(rule.frame), []
    for at in range(0, len(frames), block):
        power = np.abs(np.fft.rfft(frames[at : at + block] * window, axis=1)) ** 2
        out.append(np.round(32 * np.log10(power @ bank + 1.0)).astype(np.int16))
    return np.concatenate(out)


def segments(level: np.ndarray, on: int, off: int) -> list[tuple[int, int]]:
    """Runs of frames that begin at `on` or more and last until below `off`, both over the median level."""
    if not len(level):
        return []
    over = level - int(np.median(level))
    mark = np.where(over >= on, 1, np.where(over < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    active = (last >= 0) & (mark[np.maximum(last, 0)] > 0)
    change = np.diff(np.concatenate([[0], active.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True))


def features(samples: bytes, rule: AudioRule) -> tuple[np.ndarray, list[tuple[float, float]], list[tuple[float, float]]]:
    """(tensors of shape (n, frames, bands), their spans, the segments' spans), spans in milliseconds."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    mel = log_mel(resample(x, rule.up, rule.down, rule.taps), rule)
    step = 1000.0 * rule.hop * rule.down / rule.up / rule.rate
    found = [(a * step, b * step) for a, b in segments(mel.max(axis=1), rule.on_level, rule.off_level)]
    n = -(-len(mel) // rule.frames)
    full = np.zeros((n * rule.frames, rule.bands), np.int16)
    full[: len(mel)] = mel
    spans = [(k * rule.frames * step, min((k + 1) * rule.frames, len(mel)) * step) for k in range(n)]
    return full.reshape(n, rule.frames, rule.bands), spans, found


def tensor_bytes(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of fixed-shape tensors with start_ms and end_ms."""
    column = pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))
    batch = pa.record_batch([column, pa.array([s[0] for s in spans]), pa.array([s[1] for s in spans])], names=["mel", "start_ms", "end_ms"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as stream:
        stream.write_batch(batch)
    return out.getvalue()


def read_tensors(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()


def _store(rule: AudioRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            data, ends = K.utf8(batch.column("text"))
            media = [to_wav(payload_of(data[a:b].tobytes(), rule.pad), rule.rate) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(ends)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return run


def clips(docs: DataFrame, rule: AudioRule = AudioRule()) -> DataFrame:
    """(doc_id, n_bytes, media) of each row: the text's bytes as an 8-bit clip.  Null text is empty and makes a clip of `pad` zeros."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store(rule), "doc_id long, n_bytes long, media binary")


_SPANS = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))


def _analyse(rule: AudioRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, column="media"):
            rows = []
            for blob in batch.column("media"):
                media = blob.as_py()
                _, payload = from_wav(media)  # all that follows comes from the stored form
                tensors, spans, found = features(payload, rule)
                row = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()]
                rows.append([*row, tensor_bytes(tensors, spans), [{"start_ms": s, "end_ms": e} for s, e in found]])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), _SPANS)
            names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors", "segments")
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *names])

    return run


_MEASURED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def media_features(media: DataFrame, rule: AudioRule = AudioRule()) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tensors, segments) of each row of clips().

    `tensors` is an Arrow stream of fixed-shape tensors with their spans.  Rows keep their doc_id, null or repeated; an
    empty table gives an empty one; other columns aren't read.  One narrow pass: nothing is shuffled, a clip is in memory at a time."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_analyse(rule), f"{_MEASURED}, tensors binary, segments array<struct<start_ms: double, end_ms: double>>")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for blob, found in zip(batch.column("tensors"), batch.column("segments").to_pylist(), strict=True):
            table = read_tensors(blob.as_buffer())
            mel = table.column("mel").combine_chunks()
            mel = mel.chunk(0) if isinstance(mel, pa.ChunkedArray) else mel
            cells = mel.to_numpy_ndarray()
            spans = list(zip(table.column("start_ms").to_pylist(), table.column("end_ms").to_pylist(), strict=True))
            digest = hashlib.sha256(cells.tobytes() + repr((spans, [(f["start_ms"], f["end_ms"]) for f in found])).encode()).hexdigest()[:32]
            out.append("x".join(map(str, cells.shape)) + f":{len(found)}:{digest}")
        yield batch.drop_columns(["tensors", "segments"]).append_column("feature", pa.array(out, pa.string()))


def digests(found: DataFrame) -> DataFrame:
    """The table of media_features() with `feature`, a digest of the stored tensors, spans and segments, in their place."""
    return found.mapInArrow(_digest, f"{_MEASURED}, feature string")


def stored_features(docs: DataFrame, rule: AudioRule = AudioRule()) -> DataFrame:
    """The table of media_features(), written to the shared folder as are the clips that it is computed from."""
    return saved(media_features(saved(clips(docs, rule), "zclips"), rule), "zfeatures")
