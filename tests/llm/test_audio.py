import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from bytefacts.llm.audio import DOWN, FFT, FRAMES, HIGH, HOP, LOW, MELS, RATE, SHORTEST, TAPS, UNIT, WINDOW, analyse, audio_features, audio_tensors, digests, from_wave, hysteresis, low_pass, mel_filters, pad, resample, stored, tensor_table, to_wave

from .helpers import edge_docs, edge_rows, got, no_docs


def test_round_trip_of_payloads():
    for raw in (b"", b"a", b"x" * UNIT, b"y" * (UNIT + 1), bytes(range(256)) * 50):
        payload = pad(raw)
        assert len(payload) % UNIT == 0 and len(payload) > 0 and payload.startswith(raw)
        assert from_wave(to_wave(payload)) == (RATE, payload)
    assert from_wave(to_wave(b"odd")) == (RATE, b"odd")


def test_polyphase_equals_direct_filtering():
    x = np.random.default_rng(1).random(1001).astype(np.float32)
    h = low_pass().T.ravel()
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), x, np.zeros(TAPS, np.float32)])
    direct = [float((padded[DOWN * k : DOWN * k + TAPS] * h).sum()) for k in range(501)]
    assert np.allclose(resample(x), direct, atol=1e-5)


def test_a_tone_lands_in_its_band_and_above_half_the_rate_vanishes():
    t = np.arange(RATE) / RATE

    def level(f):
        return analyse((128 + 100 * np.sin(2 * np.pi * f * t)).astype(np.uint8).tobytes()).log_mel.mean(axis=0)

    bins = np.fft.rfftfreq(256, DOWN / RATE)
    assert level(1000).argmax() == mel_filters()[np.abs(bins - 1000).argmin()].argmax()
    assert level(7000).max() < level(1000).max() - 4


def test_hysteresis():
    e = np.array([0, 0, 0, 0, 0, 0, 1, 0.5, 0.5, 0.5, 0.1, 0, 0.5, 0.5, 0.5, 1, 1, 0, 0, 0], dtype=np.float32)
    assert hysteresis(e) == [(6, 10)]  # held by LOW; the later run is too short, as rises below HIGH do not open one
    assert hysteresis(np.zeros(0, np.float32)) == []


def test_tensors_have_a_fixed_shape(tmp_path, spark):
    media = [to_wave(pad(b"speech " * 3000)), to_wave(pad(b""))]
    table = tensor_table([1, 2], media)
    assert table.schema.field("log_mel").type.shape == [FRAMES, MELS]
    pq.write_table(table, tmp_path / "t.parquet")
    assert pq.read_table(tmp_path / "t.parquet").schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
    rows = {r.doc_id: r.tensors for r in audio_tensors(spark.createDataFrame([(1, media[0]), (2, media[1]), (3, None)], "doc_id long, media binary")).collect()}
    assert rows[3] is None and pa.ipc.open_stream(rows[1]).read_all().equals(tensor_table([1], media[:1]))
    spans = table.to_pydict()
    assert all(b > a for a, b in zip(spans["start_s"], spans["end_s"], strict=True))
    assert spans["start_s"][1] == FRAMES * HOP * DOWN / RATE
    f = analyse(from_wave(media[0])[1])
    cubes = table.column("log_mel").combine_chunks().to_numpy_ndarray()
    assert np.array_equal(cubes[: -(-len(f.energy) // FRAMES)].reshape(-1, MELS)[: len(f.energy)], f.log_mel)
    assert [(x["start_s"], x["end_s"]) for d, v in zip(spans["doc_id"], spans["voiced"], strict=True) if d == 1 for x in v] == f.spans()


def plain_feature(raw):
    """The digest by loops over frames and direct sums, without blocks, phases or tensors."""
    x = (np.frombuffer(pad(raw), dtype=np.uint8).astype(np.float64) - 128) / 128
    h = low_pass().T.ravel().astype(np.float64)
    padded = np.concatenate([np.zeros(TAPS // 2), x, np.zeros(TAPS + 2)])
    y = np.array([padded[DOWN * k : DOWN * k + TAPS] @ h for k in range(-(-len(x) // DOWN))])
    y = np.concatenate([y, np.zeros(max(0, WINDOW - len(y)))])
    mel, energy = [], []
    k = np.arange(FFT // 2 + 1)[:, None] * np.arange(WINDOW) * (2 * np.pi / FFT)
    for at in range(0, len(y) - WINDOW + 1, HOP):
        part = y[at : at + WINDOW] * np.hanning(WINDOW)
        power = (np.cos(k) @ part) ** 2 + (np.sin(k) @ part) ** 2
        mel.append(np.log(power @ mel_filters().astype(np.float64) + 1e-6))
        energy.append(np.log((y[at : at + WINDOW] ** 2).mean() + 1e-6))
    floor, segments, start = np.quantile(np.float32(energy), 0.1), [], None
    for i, e in enumerate([*energy, -np.inf]):
        if start is None and e >= floor + HIGH:
            start = i
        elif start is not None and e < floor + LOW:
            if i - start >= SHORTEST:
                segments.append((start, i))
            start = None
    mean = np.mean(mel, axis=0)
    return len(energy), len(segments), sum(b - a for a, b in segments) * 1000 // len(energy), np.mean(energy), mean


def test_features_equal_direct_sums():
    r = np.random.default_rng(8)
    texts = [b"", b"a", b"a few words", b"word " * 700, bytes(r.integers(32, 127, 5000)), b"x" * 3000 + b"\x00\xff" * 900 + b"mild words here " * 90, " ünïcödé 日本".encode() * 60]
    got_ = digests(stored(tensor_table([0] * len(texts), [to_wave(pad(t)) for t in texts])))
    for t, said in zip(texts, got_, strict=True):
        frames, segments, voiced, level, mean = plain_feature(t)
        told = dict(x.split("=") for x in said.split(";"))
        assert (int(told["frames"]), int(told["segments"]), int(told["voiced"])) == (frames, segments, voiced), t[:20]
        assert abs(float(told["level"]) - level) < 0.011
        bands = [int(x) for x in told["bands"].split("-")]
        assert all(mean[b] >= np.sort(mean)[-3] - 0.002 for b in bands) and len(set(bands)) == 3
    assert digests(stored(tensor_table([], []))) == []


def test_edge_cases(spark):
    features = {}
    for r in audio_features(edge_docs(spark)).collect():
        text = next(t for i, t, *_ in edge_rows() if i == r.doc_id) or ""
        payload = pad(text.encode())
        media = to_wave(payload)
        assert tuple(r)[1:-1] == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
        assert features.setdefault(text, r.feature) == r.feature == digests(stored(tensor_table([0], [media])))[0]
    assert got(audio_features(no_docs(spark))) == []
