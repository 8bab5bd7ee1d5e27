"""Operator 3: exact round trips through every part of the format."""

import base64
import hashlib

import numpy as np
import pytest

from tessella.llm import webp as w

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 70_001])
@pytest.mark.parametrize("kinds", [1, 2, 60, 256])
def test_payloads(n, kinds):
    payload = w.payload_of(RNG.integers(0, kinds, n).astype(np.uint8).tobytes())
    assert len(payload) % w.ROW == 0 and len(payload) >= w.ROW
    assert w.load(w.store(payload)) == payload


def test_more_rows_than_one_image_and_skewed_codes(monkeypatch):
    monkeypatch.setattr(w, "MAX_ROWS", 10)
    monkeypatch.setattr(w, "_RUN", 1 << 13)
    payload = w.payload_of(np.minimum(RNG.geometric(0.5, 50_000), 250).astype(np.uint8).tobytes())
    assert w.load(w.store(payload)) == payload


def _stream(width, height, alpha=1):
    out = w.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(value, n)
    return out


def _append(out, data, colours, top):
    """Another image's bits after out's: _put_literals ends at a byte, so its bits are counted by decoding."""
    inner = w.Writer()
    body = w._put_literals(inner, colours, False, top)
    bits = w.Bits(body)
    w._read_image(bits, *data, top)
    out.put(int.from_bytes(body, "little") & ((1 << bits.at) - 1), bits.at)


def _file(out):
    return w.riff(out.value.to_bytes((out.size + 7) // 8, "little"))


def _pixels(colours, width, height):
    return w._bytes_of(colours)[:, [2, 1, 0, 3]].reshape(height, width, 4)


def _colours(n, most=1 << 32):
    return RNG.integers(0, most, n).astype(np.uint32)


@pytest.mark.parametrize("kind", ["predictor", "cross", "green", "palette2", "palette4", "palette16", "palette200", "all"])
def test_transforms(kind):
    width, height, block = 21, 17, 2
    across, down = (width + 3) >> 2, (height + 3) >> 2
    out = _stream(width, height)
    if kind.startswith("palette"):
        n = int(kind[7:])
        palette = _colours(n)
        index = RNG.integers(0, n, (height, width))
        want = palette[index].ravel()
        pack = w.packing(n)
        padded = np.zeros((height, ((width + (1 << pack) - 1) >> pack) << pack), np.uint32)
        padded[:, :width] = index
        step = 8 >> pack
        packed = sum(padded[:, i :: 1 << pack] << (i * step) for i in range(1 << pack)) << 8
        out.put(1, 1)
        out.put(w.PALETTE, 2)
        out.put(n - 1, 8)
        entries = w._bytes_of(palette)
        delta = np.ascontiguousarray(np.diff(entries, axis=0, prepend=np.zeros((1, 4), np.uint8))).view("<u4").ravel()
        _append(out, (n, 1), delta, False)
        out.put(0, 1)
        _append(out, (packed.shape[1], height), packed.ravel().astype(np.uint32), True)
        assert (w.decode(_file(out)) == _pixels(want, width, height)).all()
        return
    want = colours = _colours(width * height)
    if kind in ("predictor", "all"):
        modes = (np.arange(across * down) % 14).astype(np.uint32) << 8
        colours = w.do_predictor(colours, modes, width, height, block)
        out.put(1, 1)
        out.put(w.PREDICTOR, 2)
        out.put(block - 2, 3)
        _append(out, (across, down), modes, False)
    if kind in ("cross", "all"):
        factors = _colours(across * down, 1 << 24)
        colours = w.cross_colour(colours, factors, width, height, block, -1)
        out.put(1, 1)
        out.put(w.CROSS_COLOUR, 2)
        out.put(block - 2, 3)
        _append(out, (across, down), factors, False)
    if kind in ("green", "all"):
        colours = w.green_added(colours, -1)
        out.put(1, 1)
        out.put(w.SUBTRACT_GREEN, 2)
    out.put(0, 1)
    _append(out, (width, height), colours, True)
    assert (w.decode(_file(out)) == _pixels(want, width, height)).all()


def test_a_file_made_elsewhere():
    """Fixed value: the one-pixel lossless file that browsers are asked to show to find out if they can."""
    file = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert w.decode(file).tolist() == [[[0, 0, 0, 0]]]


def _kinds(file):
    """The transforms of a file, and whether it has a colour cache or back-references."""
    bits, found = w.Bits(w.chunk_of(file)), []
    bits.at = 8 + 14 + 14 + 1 + 3
    if bits.read(1):
        found.append(bits.read(2))
    return found


PLAIN = RNG.integers(0, 256, (30, 64, 3)).astype(np.uint8)


def _rolled(image):
    """The image twice, the second time moved to the side."""
    return np.concatenate([image, np.roll(image, 17, axis=1)])


@pytest.mark.parametrize(
    ("image", "kind"),
    [
        (np.repeat(np.cumsum(RNG.integers(0, 3, (30, 64, 3)), axis=1), 3, axis=0), w.PREDICTOR),
        (np.tile(np.cumsum(RNG.integers(0, 3, (64, 3)), axis=0), (90, 1, 1)) + np.arange(90)[:, None, None] // 2, w.PREDICTOR),
        (_rolled(RNG.integers(0, 200, (20, 64, 1)) + RNG.integers(0, 4, (20, 64, 3))), w.SUBTRACT_GREEN),
        (_rolled(np.concatenate([9 + (g := RNG.integers(0, 126, (20, 64, 1))) // 2, g, 7 + g // 2], axis=2) + RNG.integers(0, 3, (20, 64, 3))), w.CROSS_COLOUR),
        (np.repeat(PLAIN, 3, axis=0), None),
        (np.tile(PLAIN[:1, :2], (40, 32, 1)), w.PALETTE),
        (np.tile(PLAIN[:1, :13], (40, 5, 1))[:, :64], w.PALETTE),
        (np.tile(PLAIN[:2, :50], (40, 2, 1))[:, :64], w.PALETTE),
        (PLAIN[:1, :1].repeat(16_383, 0).repeat(64, 1), w.PALETTE),
    ],
)
def test_encoder_transforms(image, kind):
    image = image.astype(np.uint8)
    file = w.encode(image)
    assert (w.decode(file)[..., :3] == image).all() and (w.decode(file)[..., 3] == 255).all()
    assert len(file) < 0.7 * image.size
    if kind is not None:
        assert _kinds(file) == [kind]


@pytest.mark.parametrize("kind", ["passages", "lines", "spaces", "long"])
def test_repeating_payloads(kind, monkeypatch):
    monkeypatch.setattr(w, "_RUN", 1 << 14)  # tokens of several runs
    words = [bytes(RNG.choice(list(b"abcdefghij"), RNG.integers(2, 9))) for _ in range(60)]
    text = b" ".join(RNG.choice(words) for _ in range(4000))
    payload = {"passages": text[:3000] * 9 + text, "lines": (text[:71] + b"\n") * 300, "spaces": text[:900] + b" " * 30_000, "long": text * 6}[kind]
    payload = w.payload_of(payload)
    media = w.store(payload)
    assert w.load(media) == payload and len(media) < 0.5 * len(payload)


def test_predictors_by_rows_equal_those_by_pixels():
    width, height, block = 37, 19, 2
    modes = (RNG.integers(0, 14, 10 * 5).astype(np.uint32)) << 8
    want = _colours(width * height)
    assert (w.undo_predictor(w.do_predictor(want, modes, width, height, block), modes, width, height, block) == want).all()


def test_broken_streams_raise():
    file = w.store(w.payload_of(b"a line that repeats\n" * 400))
    for cut in range(30, len(file) - 2, 3):
        try:
            w.decode(file[:cut])
        except (ValueError, IndexError):
            pass


def _put_code(out, lengths):
    w._put_lengths(out, lengths)
    return w.code_words(lengths), lengths


@pytest.mark.parametrize("meta", [False, True])
def test_back_references_cache_and_groups(meta):
    """A stream of literals, short and long distances and cache symbols, written symbol by symbol."""
    width, height, cache_bits = 10, 12, 4
    out = _stream(width, height)
    out.put(0, 1)
    out.put(1, 1)
    out.put(cache_bits, 4)
    groups = 2 if meta else 1
    which = np.arange(3 * 3) % 2
    out.put(int(meta), 1)
    if meta:
        out.put(0, 3)  # blocks of 4
        _append(out, (3, 3), (which << 8).astype(np.uint32), False)
    green = [0] * (256 + 24 + 16)
    for s in (10, 20, 30, 40, 256, 257, 258, 260, *range(280, 296)):
        green[s] = 1
    codes = []
    for _ in range(groups):
        own = [_put_code(out, w.code_lengths(np.array(green)))]
        own += [_put_code(out, w.code_lengths(np.array([int(s in (1, 2, 255)) for s in range(256)]))) for _ in range(3)]
        own.append(_put_code(out, w.code_lengths(np.array([int(s < 14) for s in range(40)]))))
        codes.append(own)
    cache, image = w._Cache(cache_bits), []

    def put(group, k, s):
        words, lengths = codes[group][k]
        out.put(int(words[s]), lengths[s])

    def number(group, k, base, value):
        v = value - 1
        if v < 4:
            put(group, k, base + v)
            return
        extra = v.bit_length() - 2
        put(group, k, base + 2 * (extra + 1) + ((v >> extra) & 1))
        out.put(v & ((1 << extra) - 1), extra)

    def here():
        at = len(image)
        return int(which[(at // width >> 2) * 3 + (at % width >> 2)]) if meta else 0

    while len(image) < width * height:
        group, left, choice = here(), width * height - len(image), RNG.integers(0, 4)
        if choice == 1 and len(image) > width + 2 and left >= 5:
            length = int(RNG.choice([1, 2, 3, 5]))
            code = int(RNG.choice([1, 2, 3, 4, 121, 125]))
            number(group, 0, 256, length)
            number(group, 4, 0, code)
            dx, dy = w.DISTANCES[code - 1] if code <= 120 else (code - 120, 0)
            for _ in range(length):
                image.append(image[-(dx + dy * width)])
                cache.add(image[-1])
        elif choice == 2 and image:
            slot = int(RNG.integers(0, 16))
            put(group, 0, 280 + slot)
            image.append(cache.colours[slot])
            cache.add(image[-1])
        else:
            g, r, b, a = int(RNG.choice([10, 20, 30, 40])), *(int(x) for x in RNG.choice([1, 2, 255], 3))
            for k, s in enumerate((g, r, b, a)):
                put(group, k, s)
            image.append(a << 24 | r << 16 | g << 8 | b)
            cache.add(image[-1])
    got = w.decode(_file(out))
    assert (got == _pixels(np.array(image, np.uint32), width, height)).all()


def test_columns(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (2, ""), (3, "é" * 50_000), (4, "x" * 192)]
    got = w.media_columns(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, feature string")).collect()
    for (i, t), r in zip(rows, got, strict=True):
        payload = w.payload_of((t or "").encode())
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (i, len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_bytes == len(r.media)
    assert got[0] == got[1] and got[2].media_sha256 == got[3].media_sha256
    files = spark.createDataFrame([(bytes(got[0].media),), (None,), (b"",), (b"RIFF",), (bytes(got[4].media)[: len(got[4].media) // 2],)], "media binary")
    found = w.pixel_arrays(files).collect()
    assert found[0].width == 64 and found[0].error is None
    assert all(r.pixels is None and r.error for r in found[1:])
    clash = files.limit(1).selectExpr("media", "1 AS width", "'x' AS error", "2 AS pixels", "3 AS other")
    assert w.pixel_arrays(clash).columns == ["media", "other", "width", "height", "pixels", "error"]
    assert w.pixel_arrays(files.limit(0)).count() == 0
    assert w.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_green_red_and_blue_of_one_code_are_read_once(monkeypatch):
    read, of = [], w._read_lengths
    monkeypatch.setattr(w, "_read_lengths", lambda bits, size: read.append(size) or of(bits, size))
    rng = np.random.default_rng(8)
    payload = rng.integers(32, 127, 192 * 40, np.uint8).tobytes()
    assert w.load(w.store(payload)) == payload
    assert read == [w.LITERALS + w.LENGTHS, 256, w.DISTANCE_SYMBOLS]


@pytest.mark.parametrize("most", [7, 15])
def test_code_lengths_are_complete_and_bounded(most):
    rng = np.random.default_rng(9)
    for n in (2, 3, 19, 100):
        for counts in (rng.integers(0, 50, n), np.array([1 << min(i, 40) for i in range(n)]), np.ones(n, np.int64)):
            lengths = w.code_lengths(counts, most)
            if np.count_nonzero(counts) > 1:
                assert sum(2.0**-k for k in lengths if k) == 1 and max(lengths) <= most
            assert [bool(k) for k in lengths] == [bool(c) for c in counts]
