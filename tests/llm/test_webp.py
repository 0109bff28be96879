"""Lossless images: samples there and back, and streams with transforms, caches and groups written here."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media, webp


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.text("ab\n. ", max_size=900).map(str.encode), st.text(max_size=200).map(str.encode)))
def test_payloads_come_back(raw):
    payload = media.padded(raw)
    assert media.load(media.store(payload)) == payload and len(payload) % 64 == 0 and payload


def test_payloads_over_one_image():
    payload = media.padded(np.random.default_rng(0).integers(0, 40, media.IMAGE_BYTES + 100, np.uint8).tobytes())
    stored = media.store(payload)
    assert len(list(media.images_in(stored))) == 2 and media.load(stored) == payload


def test_cut_images_are_refused():
    stored = media.store(media.padded(b"hello there, this is a text. " * 40))
    with pytest.raises(ValueError):
        media.load(stored[:-30])


def write(out, pixels, top, cache_bits=0):
    """Pixels as literals (or cache hits) under codes made for them."""
    out.put(1, 1) if cache_bits else out.put(0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if top:
        out.put(0, 1)
    cache, symbols = [None] * (1 << cache_bits), []
    for p in pixels.tolist():
        slot = (p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        hit = cache_bits and cache[slot] == p
        symbols.append((280 + slot,) if hit else (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24))
        cache[slot] = p
    codes = []
    for k, size in enumerate((280 + (len(cache) if cache_bits else 0), 256, 256, 256, 40)):
        counts = [0] * size
        for s in symbols:
            if k < len(s):
                counts[s[k]] += 1
        lengths = webp.code_lengths(counts)
        webp.write_lengths(out, lengths)
        codes.append((webp.canonical(lengths).tolist(), lengths if sum(map(bool, lengths)) > 1 else [0] * size))
    for s in symbols:
        for (code, lengths), value in zip(codes, s):
            out.put(code[value], lengths[value])


def start(width, height):
    out = webp.BitWriter()
    webp.header(out, width, height)
    return out


def picture(width, height, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**32, width * height, np.uint64).astype(np.uint32)
    base[::3] = base[0]
    return base


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_literals_and_cache(cache_bits):
    pixels = picture(13, 9)
    out = start(13, 9)
    out.put(0, 1)
    write(out, pixels, True, cache_bits)
    assert (webp.decode(webp.file_of(out.bytes())).reshape(-1) == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    width, height, shift = 11, 10, 2
    pixels = picture(width, height, mode)
    modes = np.full(3 * 3, mode << 8 | 0xFF000000, np.uint32)
    left = pixels.copy()
    for at, guess in webp.predictions(modes, shift, width, height, pixels):
        a, b = int(pixels[at]), guess
        left[at] = sum(((a >> s) - (b >> s) & 255) << s for s in (0, 8, 16, 24))
    out = start(width, height)
    out.put(1, 1)
    out.put(0, 2)
    out.put(shift - 2, 3)
    write(out, modes, False)
    out.put(0, 1)
    write(out, left, True)
    assert (webp.decode(webp.file_of(out.bytes())).reshape(-1) == pixels).all()


def test_colour_transform_and_green():
    width, height = 9, 6
    pixels = picture(width, height, 3)
    factors = picture(3, 2, 4)
    out = start(width, height)
    out.put(1, 1)
    out.put(2, 2)
    out.put(1, 1)
    out.put(1, 2)
    out.put(0, 3)
    write(out, factors, False)
    out.put(0, 1)
    green = webp.subtract_green(pixels, -1)
    write(out, webp.cross_colour(green, factors, 2, width, -1), True)
    assert (webp.decode(webp.file_of(out.bytes())).reshape(-1) == pixels).all()


def test_back_references_near_and_over_themselves():
    samples = b"abcdefgh" * 30 + b"." * 200 + bytes(range(64)) + b"abcdefgh" * 7
    samples += bytes(-len(samples) % 64)
    assert webp.samples_of(webp.encode(samples, 64)) == samples
    assert webp._distance(1, 64) == 64 and webp._distance(2, 64) == 1 and webp._distance(121, 64) == 1


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17])
def test_palettes(colours):
    samples = np.random.default_rng(colours).choice(np.arange(5, 250, 11)[:colours], 64 * 5).astype(np.uint8).tobytes()
    assert webp.samples_of(webp.encode(samples, 64)) == samples
