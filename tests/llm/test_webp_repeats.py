"""Repeats at the ends of what a length and a distance code can say."""

import numpy as np
import pytest

from tessera.llm import media, webp


@pytest.mark.parametrize("words", [10, 85, 300, 682, 683, 700])
def test_long_unpunctuated_lines_that_repeat(words):
    line = " ".join(f"{chr(97 + i % 26)}{i % 97:04d}" for i in range(words)) + "\n"
    payload = media.padded((line * 12).encode())
    assert media.load(media.store(payload)) == payload
    assert all(length <= 4096 for _, length, _ in webp._repeats(payload))


def test_start_of_an_image_repeated_at_its_end():
    start = b"the very first words of this image,"
    for gap in (60, 100, 119, 120, 121, 200):
        filler = np.random.default_rng(gap).integers(65, 91, media.IMAGE_BYTES - len(start) - gap, np.uint8).tobytes()
        samples = (start + filler[:-1] + b"." + start).ljust(media.IMAGE_BYTES, b"x")[:media.IMAGE_BYTES]
        assert webp.samples_of(webp.encode(samples, 64)) == samples
