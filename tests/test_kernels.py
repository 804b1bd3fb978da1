from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom import frames, kernels
from scanloom.errors import DECODE, MESSAGES, UNUSED, PngError
from scanloom.plans import fixtures

SHAPES = [(1, 1), (3, 2), (5, 5), (8, 8), (9, 17)]
MODES = [(c, d) for c, ds in kernels.DEPTHS.items() for d in ds]


@pytest.mark.parametrize("color,depth", MODES)
@pytest.mark.parametrize("interlace", [False, True])
def test_round_trip(color, depth, interlace):
    rng = np.random.default_rng(color * 17 + depth)
    for w, h in SHAPES:
        for strategy in (None, "zero", "minsum", "entropy", "bruteforce"):
            x = rng.integers(0, 1 << depth, (2, h, w, kernels.CHANNELS[color])).astype(np.uint16 if depth == 16 else np.uint8)
            palette = bytes(rng.integers(0, 256, 768, dtype=np.uint8)) if color == 3 else None
            done = frames.decode(kernels.encode_images(x, color, depth, interlace, strategy, 6, palette))
            for f, own in zip(done, x):
                assert len(f) == 1 and f[0].error is None and (f[0].samples == own).all()


def forced(x: np.ndarray, step: int) -> np.ndarray:
    """Rows filtered by types 0 to 4 in turn."""
    kind = (np.arange(x.shape[1]) % 5).astype(np.uint8)
    tried = kernels.filters(x, step)
    body = np.stack([tried[k, :, y] for y, k in enumerate(kind)], 1)
    return np.concatenate([np.broadcast_to(kind[None, :, None], (len(x), x.shape[1], 1)), body], 2)


@pytest.mark.parametrize("step", [1, 2, 3, 4, 6, 8])
def test_all_filters_in_turn(step):
    rng = np.random.default_rng(step)
    x = rng.integers(0, 256, (3, 13, 7 * step), dtype=np.uint8)
    assert (kernels.unfilter(forced(x, step), step) == x).all()


def slow_unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.int64)
    for y, r in enumerate(rows):
        for i, v in enumerate(r[1:].tolist()):
            a = out[y, i - step] if i >= step else 0
            b = out[y - 1, i] if y else 0
            c = out[y - 1, i - step] if y and i >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out[y, i] = (v + (0, a, b, (a + b) // 2, nearest)[r[0]]) % 256
    return out.astype(np.uint8)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4, 6, 8]), st.integers(0, 2**32 - 1))
def test_unfilter_against_plain_loops(w, h, step, seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(0, 256, (h, 1 + w * step), dtype=np.uint8)
    rows[:, 0] = rng.integers(0, 5, h)
    assert (kernels.unfilter(rows[None], step)[0] == slow_unfilter(rows, step)).all()


def test_every_pair_of_bytes():
    """All values next to and below all values, by each filter, with and without a row above."""
    pairs = np.stack(np.meshgrid(np.arange(256), np.arange(256)), -1).reshape(-1, 1, 2).astype(np.uint8)
    two = np.concatenate([pairs, pairs[::-1]], 1)
    for k in range(5):
        for x in (pairs, two):
            rows = np.concatenate([np.full((*x.shape[:2], 1), k, np.uint8), kernels.filters(x, 1)[k]], 2)
            assert (kernels.unfilter(rows, 1) == x).all()


@pytest.mark.parametrize(
    "size,want",
    [
        ((1, 1), [(1, 1)] + [(0, 0)] * 6), ((3, 2), [(1, 1), (0, 0), (0, 0), (1, 1), (0, 0), (1, 1), (3, 1)]),
        ((5, 5), [(1, 1), (1, 1), (2, 1), (1, 2), (3, 1), (2, 3), (5, 2)]), ((8, 8), [(1, 1), (1, 1), (2, 1), (2, 2), (4, 2), (4, 4), (8, 4)]),
        ((9, 17), [(2, 3), (1, 3), (3, 2), (2, 5), (5, 4), (4, 9), (9, 8)]),
    ],
)
def test_pass_sizes(size, want):
    assert [kernels.pass_size(p, *size) for p in range(7)] == want
    assert sum(w * h for w, h in want) == size[0] * size[1]


def test_formula_raster():
    raster = fixtures.formula_raster()
    assert raster[:16].hex() == "0000010303010106070601020202020e"
    assert fixtures.check() == (1227099636, 2607682306)
    assert hashlib.sha256(raster).hexdigest() == "94dc8db502c88dad34ac05a20548022114754ad8b5ba36adcacb491faf3dfed9"
    x = np.frombuffer(raster, np.uint8).reshape(1, 479, 639, 3)
    for interlace in (False, True):
        assert (frames.decode(kernels.encode_images(x, 2, 8, interlace))[0][0].samples == x[0]).all()


def test_zlib():
    assert zlib.crc32(b"IEND") == 2923585666
    for level in range(11):
        out = kernels.deflate(b"abc" * 100, level)
        assert out[:2] == b"\x78\x01" and kernels.inflate(out) == b"abc" * 100 == zlib.decompress(out)
    with pytest.raises(ValueError):
        kernels.deflate(b"", 11)
    with pytest.raises(PngError) as e:
        kernels.inflate(kernels.deflate(bytes(10_000)), 100)
    assert e.value.code == "TooLarge"
    with pytest.raises(PngError) as e:
        kernels.inflate(kernels.deflate(b"abc") + b"junk")
    assert e.value.code in ("AdlerChecksum", "Inflate")


@pytest.mark.parametrize("name,data,code", fixtures.errors(), ids=[x[0] for x in fixtures.errors()])
def test_error(name, data, code):
    found = frames.decode([data])[0]
    assert [f.error.code for f in found if f.error] == [code]


def test_each_live_error_has_a_file():
    want = set(DECODE) - {"TrailingChunk", "UnknownChunkType", "TooLarge"}
    assert {c for *_, c in fixtures.errors()} == want and set(DECODE) <= set(MESSAGES) and len(UNUSED) == 8


@pytest.mark.parametrize("name,data,code", fixtures.strict_errors(), ids=[x[0] for x in fixtures.strict_errors()])
def test_strict_error(name, data, code):
    assert frames.decode([data], strict=True)[0][-1].error.code == code
    assert frames.decode([data])[0][-1].error is None


def test_trailing_chunk_warns():
    f = frames.decode([fixtures.trailing()])[0]
    assert len(f) == 1 and f[0].error is None and f[0].warning == "TrailingChunk"


def test_two_runs_are_two_frames():
    text = kernels.chunk(b"tEXt", b"k\0v")
    one, two = frames.decode([fixtures.png(fixtures.IDAT, text, fixtures.IDAT, fixtures.IEND)])[0]
    assert (one.index, two.index) == (0, 1) and (one.samples == two.samples).all()


def test_many_small_data_chunks():
    data = kernels.deflate(fixtures.ROWS)
    parts = [kernels.chunk(b"IDAT", data[k : k + 1]) for k in range(len(data))] + [kernels.chunk(b"IDAT", b"")] * 150
    f = frames.decode([fixtures.png(*parts, fixtures.IEND)])[0]
    assert f[0].samples.reshape(-1).tolist() == [1, 2, 3, 4]


def test_missing_rows_are_zero():
    f = frames.decode([fixtures.png(kernels.chunk(b"IDAT", kernels.deflate(fixtures.ROWS[:3])), fixtures.IEND)])[0]
    assert f[0].samples.reshape(-1).tolist() == [1, 2, 0, 0]


def test_image_above_the_limit():
    f = frames.decode([fixtures.png(fixtures.IDAT, fixtures.IEND)], max_pixels=3)[0]
    assert f[-1].error.code == "TooLarge"


@pytest.mark.parametrize("data,plain,strict", [(b"\xc3A", "�A", "�"), (b"\xe9", "�", ""), (b"caf\xe9 x", "caf� x", "caf�x"), (b"abc", "abc", "abc")])
def test_lossy_text(data, plain, strict):
    assert frames.lossy(data, False) == plain and frames.lossy(data, True) == strict


def test_text_shares_keys_and_the_last_wins():
    z = kernels.chunk(b"zTXt", b"k\0\0" + kernels.deflate(b"two"))
    i = kernels.chunk(b"iTXt", b"k\0\1\0en\0key\0" + kernels.deflate("drei ü".encode()))
    f = frames.decode([fixtures.png(kernels.chunk(b"tEXt", b"k\0one"), z, fixtures.IDAT, i, fixtures.IEND)])[0]
    assert f[0].text == {"k": "drei ü"}


def test_encode_refuses():
    x = np.zeros((1, 1, 1, 1), np.uint8)
    for args, code in (((x, 3, 8), "BadPalette"), ((x, 2, 8), "ColorMode"), ((x[:, :0], 0, 8), "ImageDimensions"), ((x, 0, 3), "ColorMode")):
        with pytest.raises(PngError) as e:
            kernels.encode_images(*args)
        assert e.value.code == code


def test_strict_bruteforce_never_leaves_type_0():
    x = np.random.default_rng(1).integers(0, 256, (2, 6, 9), dtype=np.uint8)
    assert not kernels.choose(kernels.filters(x, 1), "bruteforce", strict=True).any()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
@pytest.mark.parametrize("w,h", [(1, 20_000), (2, 20_000), (20_000, 1), (20_000, 2)])
def test_memory_of_long_images_is_that_of_their_pixels(kind, w, h):
    import tracemalloc

    raw = np.random.default_rng(kind).integers(0, 256, (1, h, w + 1), dtype=np.uint8)
    raw[:, :, 0] = kind
    tracemalloc.start()
    got = kernels.unfilter(raw, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < (32 << 10) + 40 * w * h and (kernels.filters(got, 1)[kind] == raw[:, :, 1:]).all()


def test_too_little_memory_is_an_error_of_the_file(monkeypatch):
    png = kernels.encode_images(np.zeros((2, 3, 3, 1), np.uint8), 0, 8)

    def fails(*_):
        raise MemoryError

    monkeypatch.setattr(kernels, "from_filtered", fails)
    assert [f[0].error.code for f in frames.decode(png)] == ["TooLarge", "TooLarge"]
