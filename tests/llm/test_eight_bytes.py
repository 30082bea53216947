"""Common prefixes are compared by eight bytes at a time."""

import numpy as np

from vigilog.llm import substrings


def test_eight_bytes_from_each_position_on():
    text = np.frombuffer(b"abcdefghij", np.uint8)
    got = substrings._eights(text)
    assert [int(x).to_bytes(8, "big") for x in got] == [bytes(text[i:i + 8]).ljust(8, b"\0") for i in range(10)]


def test_common_prefixes_of_any_length_up_to_the_limit():
    rng = np.random.default_rng(4)
    for limit in (5, 8, 13, 29):
        stem = bytes(rng.integers(0, 256, limit + 30, np.uint8))
        bodies = [stem] + [stem[:k] + bytes([stem[k] ^ (1 << int(rng.integers(8)))]) + stem[k + 1:] for k in range(limit + 12)]
        text = np.frombuffer(b"".join(bodies), np.uint8)
        starts = np.arange(len(bodies)) * len(stem)
        windows = np.full(len(bodies), len(stem) - limit + 1)
        at = (starts[:, None] + np.arange(windows[0])).ravel()
        order = at[np.argsort(substrings.suffix_ranks(text)[at])]
        before = np.full(len(text), -1, np.int32)
        before[order[1:]] = order[:-1]
        shared = substrings.common_prefixes(text, before, starts, windows, limit)
        for here, other in zip(order[1:].tolist(), order[:-1].tolist(), strict=True):
            a, b = bytes(text[here:here + limit]), bytes(text[other:other + limit])
            assert shared[here] == next((k for k in range(limit) if a[k] != b[k]), limit)
