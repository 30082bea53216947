"""Suffixes that differ only in how many NUL bytes they end in."""

import numpy as np
import pytest

from vigilog.llm.substrings import repeated_windows, suffix_ranks


@pytest.mark.parametrize("text", [b"ab\0\0", b"\0" * 40, b"abc" + b"\0" * 20 + b"abc" + b"\0" * 20, b"\0a" * 9 + b"\0\0\0", b"x"])
def test_ranks_of_texts_that_end_in_nul(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    assert np.argsort(suffix_ranks(np.frombuffer(text, np.uint8))).tolist() == order


def test_repeats_that_end_in_nul():
    body = b"some words" + b"\0" * 30
    starts, windows, mask, _ = repeated_windows([body, body], 20)
    assert all(mask[a:a + n].all() for a, n in zip(starts, windows, strict=True))
