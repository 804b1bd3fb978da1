from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from scanloom.llm import media, webp

RNG = np.random.default_rng(3)


def images():
    for k in range(12):
        h, w = RNG.integers(1, 30, 2)
        base = RNG.integers(0, 2**32, RNG.choice([1, 2, 3, 9, 200, 100_000]), dtype=np.uint32)
        x = base[RNG.integers(0, len(base), (h, w))]
        yield x if k % 3 else np.cumsum(RNG.integers(0, 3, (h, w, 4)), 1).astype(np.uint8).reshape(h, w * 4).view(np.uint32)


@pytest.mark.parametrize("x", list(images()))
@pytest.mark.parametrize("shift", [2, 4])
def test_all_features_round_trip(x, shift):
    blocks = (-(-x.shape[0] >> shift), -(-x.shape[1] >> shift))
    modes, cross = RNG.integers(0, 14, blocks), RNG.integers(0, 2**32, blocks)
    options = [
        {}, {"subtract_green": False}, {"cache_bits": 5}, {"copies": True}, {"cache_bits": 11, "copies": True}, {"predictor": modes, "shift": shift},
        {"cross": cross, "shift": shift}, {"predictor": modes, "cross": cross, "shift": shift, "copies": True, "cache_bits": 3},
    ]
    if len(np.unique(x)) <= 256:
        options += [{"palette": True}, {"palette": True, "copies": True, "cache_bits": 2}]
    for o in options:
        assert (webp.decode(webp.encode(x, **o)) == x).all(), o


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    x = RNG.integers(0, 2**32, (9, 11), dtype=np.uint32)
    assert (webp.decode(webp.encode(x, predictor=np.full((3, 3), mode))) == x).all()


def test_a_file_by_hand():
    """One pixel, all codes simple: green 5, red 6, blue 7, alpha 255."""
    bits = [(0x2F, 8), (0, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    for v in (5, 6, 7, 255, 0):
        bits += [(1, 1), (0, 1), (1, 1), (v, 8)]
    value = at = 0
    for v, n in bits:
        value |= v << at
        at += n
    body = value.to_bytes(-(-at // 8) + 2, "little")
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert webp.decode(data).tolist() == [[0xFF060507]]


def test_broken_files():
    good = webp.encode(RNG.integers(0, 2**32, (8, 8), dtype=np.uint32))
    for bad in (b"", b"RIFF", good[:30], good[:-20], good.replace(b"VP8L", b"VP8 "), good[:20] + b"\0" + good[21:]):
        with pytest.raises((webp.WebpError, ValueError)):
            webp.decode(bad)
    for _ in range(200):  # damage ends in pixels or in an error of ours
        x = bytearray(good)
        x[RNG.integers(20, len(x))] ^= 1 << RNG.integers(0, 8)
        try:
            webp.decode(bytes(x))
        except (webp.WebpError, IndexError, ValueError):
            pass


@pytest.mark.parametrize("data", [b" " * 192, bytes(range(192)), b"ab" * 960, "ü😀é".encode() * 192, bytes(192) + b"\1" * 192])
def test_bytes_round_trip(data):
    assert media.load_bytes(media.store_bytes(data)) == data


def transforms_of(data):
    """Kinds of the first file's transforms, and whether its pixels have back-references, as the decoder meets them."""
    kinds, copied, inner, unpredict = [], [], webp._with_copies, webp._unpredict
    with pytest.MonkeyPatch.context() as m:
        m.setattr(webp, "_with_copies", lambda *a: copied.append(1) or inner(*a))
        m.setattr(webp, "_unpredict", lambda *a: kinds.append("predictor") or unpredict(*a))
        x = webp.decode(data)
    used = webp.Bits(data[20:])
    used.read(40)
    if used.read(1) and used.read(2) == webp.PALETTE:
        kinds.append("palette")
    return x, kinds, bool(copied)


def test_stored_form_uses_the_method():
    words = [bytes(RNG.integers(97, 123, 12, dtype=np.uint8)) for _ in range(40)]
    prose = b" ".join(words[k] for k in RNG.integers(0, 40, 400))
    rows = RNG.integers(0, 256, 192, dtype=np.uint8)
    slopes = np.concatenate([rows + k * 7 for k in range(20)]).astype(np.uint8).tobytes()
    for data, kinds, copied in (
        (prose[: len(prose) // 192 * 192], [], True), (slopes, ["predictor"], True), ((RNG.random(192 * 9) < 0.05).astype(np.uint8).tobytes(), ["palette"], False),
    ):
        x = np.frombuffer(data, np.uint8).reshape(-1, 192)
        stored = media.store_bytes(data)
        got, used, has = transforms_of(stored)
        assert used == kinds and (has or not copied)
        assert (got == (x.astype(np.uint32) * 0x10101 | 0xFF000000)).all() and media.load_bytes(stored) == data
        assert len(stored) <= len(webp._grey_file(x))
    assert len(media.store_bytes(prose[: len(prose) // 192 * 192])) < len(prose) / 3  # of what codes alone take, some 0.6


def test_back_references_against_the_plain_decoder(monkeypatch):
    """The reader of all bits at once and the one that goes pixel by pixel agree, also on damaged files."""
    def plain(data):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(webp, "_with_copies", lambda bits, code, far, total, width: slow(bits, code, far, total, width))
            return outcome(data)

    def slow(bits, code, far, total, width):
        out = []
        while len(out) < total:
            s = code.read(bits)
            if s < 256:
                out.append(s)
                continue
            n, d = webp._value(s - 256, bits), webp._value(far.read(bits), bits)
            d = d - 120 if d > 120 else max(webp.NEAR[d - 1][0] + webp.NEAR[d - 1][1] * width, 1)
            if d > len(out) or len(out) + n > total:
                raise webp.WebpError("a back-reference leads out of the image")
            for _ in range(n):
                out.append(out[-d])
        return np.array(out, np.uint8)

    def outcome(data):
        try:
            return webp.decode(data).tobytes()
        except (webp.WebpError, ValueError, IndexError):
            return None

    for k in range(60):
        base = RNG.integers(0, 60, 900, dtype=np.uint8).tobytes()
        data = b"".join(base[a : a + n] for a, n in zip(RNG.integers(0, 800, 30), RNG.integers(1, 90, 30)))
        data = data[: len(data) // 192 * 192] + b"ab" * 96 + b"c" * 192 * (k % 3)
        good = media.store_bytes(data)
        assert outcome(good) == plain(good) is not None
        x = bytearray(good)
        x[RNG.integers(40, len(x))] ^= 1 << RNG.integers(0, 8)
        assert outcome(bytes(x)) == plain(bytes(x))


def test_long_payload_is_several_files(monkeypatch):
    monkeypatch.setattr(media, "ROWS", 3)
    data = RNG.integers(0, 256, 192 * 10, dtype=np.uint8).tobytes()
    stored = media.store_bytes(data)
    assert stored.count(b"RIFF") == 4 and media.load_bytes(stored) == data


def test_skewed_counts_stay_within_15_bits():
    count = np.array([int(1.7**k) for k in range(40)])
    n = webp.code_lengths(count)
    assert n.max() <= 15 and sum(2.0 ** -n) == 1


def test_store_texts(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "ü" * 96), (4, "ü" * 96), (None, "x" * 100_000), (5, "  "), (6, "ü" * 97)]
    f = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, media_bytes int")
    got = media.store_texts(f).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        b = (t or "").encode()
        p = b + b" " * (-len(b) % 192 or (0 if b else 192))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert by[2][2:] == by[3][2:] and media.store_texts(f.limit(0)).collect() == []


def test_columns(spark):
    x = RNG.integers(0, 2**32, (3, 5), dtype=np.uint32)
    rgba = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()
    f = spark.createDataFrame([(5, 3, bytearray(rgba), 1), (5, 2, bytearray(rgba), 2), (None, 3, None, 3)], "w int, h int, p binary, image int")
    files = media.encode_column(f, "w", "h", "p")
    assert [r.media is None for r in files.orderBy("image").collect()] == [False, True, True]
    back = media.decode_column(files.drop("image"), "media").collect()
    assert bytes(back[0].image.pixels) == rgba and (back[0].image.width, back[0].image.height) == (5, 3) and back[1].image is None
    bad = media.decode_column(spark.createDataFrame([(bytearray(b"junk"),)], "media binary"), "media").first()
    assert bad.image.pixels is None and bad.image.error


def test_codes_are_packed_by_words():
    """As bit by bit, after any number of bits, with values of no bits and of 33."""
    rng = np.random.default_rng(3)
    for head in (0, 1, 7, 8, 31, 4097):
        n = np.append(rng.integers(0, 34, 500), [33] * 40 + [0] * 5)
        values = rng.integers(0, 1 << 62, len(n)) & ((1 << n) - 1)
        one, other = webp.Writer(), webp.Writer()
        for w in (one, other):
            w.put((1 << head) - 1, head)
        one.extend_codes(values, n)
        for v, k in zip(values.tolist(), n.tolist()):
            other.put(v, k)
        for w in (one, other):
            w.put(5, 3), w.extend_codes(np.zeros(0, np.int64), np.zeros(0, np.int64)), w.put(1, 1)
        assert one.bytes() == other.bytes()


def test_tables_that_files_share_are_made_once(monkeypatch):
    """Of a stored text's codes, those of code lengths and of one symbol are the same in all files."""
    payloads = [(f"some words {k} and more words, {k * k} of them " * 9).encode()[:192] * 2 for k in range(3)]
    files = [media.store_bytes(p) for p in payloads]
    assert media.load_bytes(files[0]) == payloads[0]
    made, table = [], webp._table
    monkeypatch.setattr(webp, "_table", lambda lengths, used: made.append(len(lengths)) or table(lengths, used))
    for p, f in zip(payloads[1:], files[1:]):
        made.clear()
        assert media.load_bytes(f) == p and 19 not in made and len(made) <= 2
