"""Operator 5: exact round trips, the general decoder, and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from scoreloom.llm import motion_jpeg as M


def test_round_trip_of_all_bytes():
    r = random.Random(1)
    for n in (64, 128, 1024, 1088, 64 * 37):
        payload = bytes(r.choice([0, 1, 127, 128, 254, 255, r.randrange(256)]) for _ in range(n))
        frames, noted, rate = M.parse_clip(M.encode_clip(payload, n - 3))
        assert b"".join(M.decode_frame(f).tobytes() for f in frames) == payload
        assert (noted, rate) == (n - 3, 25.0)
        coefficients, _ = M._general(frames[-1])  # the bit-by-bit decoder agrees
        kept = coefficients[(np.abs(coefficients) >= 128).all(axis=1)]
        assert np.where(kept < 0, kept + 255, kept).astype(np.uint8).tobytes() == M.decode_frame(frames[-1]).tobytes()


def test_pixels_of_a_flat_frame():
    flat = M.encode_frames(bytes(64))[0]
    assert M.pixels(flat).shape == (32, 32)
    assert (M.pixels(flat)[8:, 8:] == 128).all()  # blocks that are not there are grey


def test_shots():
    a, b = np.full(1024 * 4, 10, np.uint8), np.full(1024 * 3, 200, np.uint8)
    assert M.shots(np.concatenate([a, b])) == [(0, 3), (4, 6)]
    assert M.shots(a[:64]) == [(0, 0)]


def test_histograms_are_of_decoded_pictures():
    r = np.random.default_rng(2)
    for n in (64, 1024, 64 * 40, 64 * 16 * 300):
        payload = r.integers(0, 256, n, np.uint8).tobytes()
        frames, _, _ = M.parse_clip(M.encode_clip(payload, n))
        samples = np.concatenate([M.decode_frame(f) for f in frames])
        got = M.clip_histograms(frames, samples)
        some = [0, len(frames) - 1]
        want = [np.bincount(M.pixels(frames[k]).ravel() // 16, minlength=16) for k in some]
        assert (got[some] == want).all() and (got.sum(axis=1) == 1024).all()
    # the transform against its definition in floating point
    c = r.integers(-255, 256, (5, 64))
    n = np.arange(8)
    wave = np.cos((2 * n[None] + 1) * n[:, None] * np.pi / 16) * np.where(n[:, None] == 0, np.sqrt(1 / 8), 0.5)
    grid = np.zeros((5, 8, 8))
    for k, (row, col) in enumerate(M.ZIGZAG):
        grid[:, row, col] = c[:, k]
    want = np.clip(np.einsum("uy,buv,vx->byx", wave, grid, wave) + 128, 0, 255).reshape(5, 64)
    assert np.abs(M.picture(c).astype(float) - want).max() <= 1.5


def test_shots_against_plain_python():
    r = np.random.default_rng(3)
    for _ in range(20):
        hist = np.concatenate([r.multinomial(1024, r.dirichlet(np.ones(16)), r.integers(1, 6)) for _ in range(4)])
        want, first, seen = [], 0, []
        for k in range(1, len(hist)):
            d = sum(abs(int(a) - int(b)) for a, b in zip(hist[k], hist[k - 1])) / 1024
            if seen and d > 2.0 * sum(seen) / len(seen) + 0.05:
                want.append((first, k - 1))
                first, seen = k, []
            else:
                seen.append(d)
        assert M.cuts_of(hist) == [*want, (first, len(hist) - 1)]


def test_not_avi():
    with pytest.raises(ValueError):
        M.parse_clip(b"RIFX" + bytes(20))


def test_query(odd, clashing, empty, documents):
    for df in (odd, clashing, documents):
        got = sorted((tuple(r)[:5] for r in M.read_media(M.to_media(df)).collect()), key=str)
        want = []
        for r in df.collect():
            raw = (r["text"] or "").encode()
            p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            want.append((r["doc_id"], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
        assert got == sorted(want, key=str)
    assert M.read_media(M.to_media(empty)).count() == 0
    timed = M.clips(M.to_media(odd)).filter("doc_id = 5").orderBy("clip").collect()
    assert timed[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(timed, timed[1:]))
