"""Media columns: 8-bit audio from payloads, and features computed from the stored form.

A payload is stored losslessly as 8-bit unsigned PCM in a RIFF/WAVE file. From the samples
read back: polyphase resampling to half the rate, overlapped log-mel frames, and segments by hysteresis on
frame energy, stored as fixed-shape Arrow tensors of FRAMES x MELS with time spans. What the query tells of a document
is read from its stored tensors.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bytefacts.llm import common

UNIT = 576
RATE, DOWN = 16_000, 2
WINDOW, HOP, FFT, MELS, FRAMES = 200, 80, 256, 32, 64
TAPS = 32
#: Hysteresis in log energy above the quietest frame's floor: a segment begins at HIGH, ends below LOW.
HIGH, LOW, SHORTEST = 0.6, 0.3, 3
#: Frames computed at once, and bytes of media whose tensors are stored together.
BLOCK, TOGETHER = 8192, 1 << 19


def pad(raw: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; a chunk of odd size gets its pad byte."""
    even = payload + b"\0" * (len(payload) % 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(even), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + even


def from_wave(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono PCM file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no wave file")
    at, rate = 12, 0
    while at < len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.cache
def low_pass(down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed sinc at the new Nyquist rate, of unit gain, as `down` phases (rows)."""
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / down) * np.hamming(taps)
    return np.ascontiguousarray((h / h.sum()).reshape(-1, down).T, dtype=np.float32)


def resample(x: np.ndarray, down: int = DOWN) -> np.ndarray:
    """Decimation in polyphase form: phase p filters every down-th sample from p on, and the phases are summed."""
    phases = low_pass(down)
    taps = phases.size
    n = -(-len(x) // down)
    padded = np.zeros((n + taps // down) * down, dtype=np.float32)
    padded[taps // 2 : taps // 2 + len(x)] = x
    y = np.zeros(n, dtype=np.float32)
    for p in range(down):
        lane = np.ascontiguousarray(padded[p::down])
        y += np.convolve(lane, phases[p][::-1], "valid")[:n]
    return y


@functools.cache
def mel_filters(rate: int = RATE // DOWN, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(fft, 1 / rate)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


@dataclass
class Features:
    log_mel: np.ndarray  # frames x MELS
    energy: np.ndarray  # per frame, log
    segments: list[tuple[int, int]]  # frames, end exclusive

    def spans(self) -> list[tuple[float, float]]:
        """Seconds."""
        s = HOP * DOWN / RATE
        return [(a * s, ((b - 1) * HOP + WINDOW) * DOWN / RATE) for a, b in self.segments]

    def tensors(self) -> np.ndarray:
        """n x FRAMES x MELS; the last is padded with the value of silence."""
        n = -(-len(self.log_mel) // FRAMES)
        out = np.full((n * FRAMES, MELS), np.float32(np.log(1e-6)), dtype=np.float32)
        out[: len(self.log_mel)] = self.log_mel
        return out.reshape(n, FRAMES, MELS)


def analyse(samples: bytes) -> Features:
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    if len(y) < WINDOW:
        y = np.concatenate([y, np.zeros(WINDOW - len(y), dtype=np.float32)])
    n = 1 + (len(y) - WINDOW) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:n]
    window, filters = np.hanning(WINDOW).astype(np.float32), mel_filters()
    mel, energy = np.empty((n, MELS), dtype=np.float32), np.empty(n, dtype=np.float32)
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * window, FFT, axis=1)) ** 2
        mel[at : at + BLOCK] = np.log(power.astype(np.float32) @ filters + np.float32(1e-6))
        energy[at : at + BLOCK] = np.log((part * part).mean(axis=1) + np.float32(1e-6))
    return Features(mel, energy, hysteresis(energy))


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs that begin where energy reaches HIGH above the floor and end where it falls below LOW above it."""
    if not len(energy):
        return []
    floor = np.quantile(energy, 0.1)
    state = np.where(energy >= floor + HIGH, 1, np.where(energy < floor + LOW, -1, 0))
    known = np.flatnonzero(state)
    last = np.searchsorted(known, np.arange(len(energy)), side="right") - 1
    on = (last >= 0) & (state[known[np.maximum(last, 0)]] == 1) if len(known) else np.zeros(len(energy), dtype=bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= SHORTEST]


SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])


def tensor_type() -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])


def tensor_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64()), ("voiced", pa.list_(SPAN)), ("log_mel", tensor_type())])


def tensor_table(doc_ids: list[int], media: list[bytes]) -> pa.Table:
    """A row for each block of FRAMES frames: its fixed-shape tensor and the time it spans.

    doc_id, block, frames (real ones; the rest is silence), start_s, end_s, level (mean log energy of its frames), voiced (the time spans of
    segments that begin in it), log_mel.
    """
    cols: dict[str, list] = {f.name: [] for f in tensor_schema()}
    cubes, hop = cols["log_mel"], HOP * DOWN / RATE
    for i, m in zip(doc_ids, media, strict=True):
        f = analyse(from_wave(m)[1])
        cube, n, spans = f.tensors(), len(f.energy), f.spans()
        cubes.append(cube)
        at = np.arange(0, n, FRAMES)
        count = np.minimum(FRAMES, n - at)
        starts = [[] for _ in at]
        for (a, _), span in zip(f.segments, spans, strict=True):
            starts[a // FRAMES].append({"start_s": span[0], "end_s": span[1]})
        cols["doc_id"] += [i] * len(at)
        cols["block"] += range(len(at))
        cols["frames"] += count.tolist()
        cols["start_s"] += (at * hop).tolist()
        cols["end_s"] += (((at + count - 1) * HOP + WINDOW) * DOWN / RATE).tolist()
        cols["level"] += (np.add.reduceat(f.energy.astype(np.float64), at) / count).tolist()
        cols["voiced"] += starts
    flat = np.concatenate(cubes).ravel() if cubes else np.zeros(0, dtype=np.float32)
    tensor = pa.ExtensionArray.from_storage(tensor_type(), pa.FixedSizeListArray.from_arrays(pa.array(flat), FRAMES * MELS))
    return pa.table([tensor if f.name == "log_mel" else pa.array(cols[f.name], type=f.type) for f in tensor_schema()], schema=tensor_schema())


def stored(table: pa.Table) -> bytes:
    """A table of tensors as an Arrow stream, in which they keep their shape."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def digests(stream: bytes) -> list[str]:
    """Of each document of a stored table of tensors, in order: frames, segments, voiced share in thousandths, mean level and the three strongest mel bands."""
    table = pa.ipc.open_stream(stream).read_all()
    if not table.num_rows:
        return []
    first = np.flatnonzero(table.column("block").to_numpy() == 0)
    frames, level = table.column("frames").to_numpy(), table.column("level").to_numpy()
    cubes = table.column("log_mel").combine_chunks().to_numpy_ndarray()
    real = np.arange(FRAMES) < frames[:, None]
    sums = np.where(real[:, :, None], cubes, 0).sum(axis=1, dtype=np.float64)
    voiced, hop, out = table.column("voiced").to_pylist(), HOP * DOWN / RATE, []
    for a, b in zip(first, [*first[1:], table.num_rows], strict=True):
        n, spans = int(frames[a:b].sum()), [x for v in voiced[a:b] for x in v]
        held = sum(round((x["end_s"] - x["start_s"] - WINDOW * DOWN / RATE) / hop) + 1 for x in spans)
        top = np.argsort(-np.round(sums[a:b].sum(axis=0) / n, 3), kind="stable")[:3]
        out.append(f"frames={n};segments={len(spans)};voiced={held * 1000 // n};level={float((level[a:b] * frames[a:b]).sum() / n):.2f};bands={'-'.join(map(str, top))}")
    return out


def audio_tensors(media: DataFrame) -> DataFrame:
    """(doc_id, media) -> (doc_id, tensors): each medium's table of tensors as an Arrow stream, read with pyarrow.ipc. A null medium has none."""
    common.ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = None if m is None else stored(tensor_table([i], [m]))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([made], pa.binary())], names=["doc_id", "tensors"])

    return media.select(common.column("doc_id").cast("long"), common.column("media").cast("binary")).mapInArrow(run, "doc_id long, tensors binary")


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, payload and media sizes and digests, and the digest of its features, read from the stored tensors and their time spans.

    Null texts count as empty (one unit of bytes 255); null ids and repeated rows stay; extra columns are
    ignored; equal texts give equal values. Whole texts, frames in blocks of BLOCK, no shuffle.
    """

    def kernel(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        group, size = [], 0
        for t in texts:
            raw = t.encode()
            media = to_wave(pad(raw))
            _, payload = from_wave(media)
            for k, v in zip(out, (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()), strict=False):
                out[k].append(v)
            if group and size + len(media) > TOGETHER:
                out["feature"] += digests(stored(tensor_table([0] * len(group), group)))
                group, size = [], 0
            group.append(media)
            size += len(media)
        if group:
            out["feature"] += digests(stored(tensor_table([0] * len(group), group)))
        return {"doc_id": ids} | out

    return common.map_texts(docs, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", kernel, id_col, text_col)


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(common.read(spark, sf_dir, "documents"))
