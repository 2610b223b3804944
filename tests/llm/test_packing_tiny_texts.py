"""Sequences that the segment limit ends are not padded."""

import random
from collections import Counter

import pytest

from sparkgas.llm import packing


@pytest.mark.parametrize("loss_tokens", [2048, 100])
def test_tiny_texts_pad_nothing(loss_tokens):
    rnd = random.Random(4)
    sizes = {i: rnd.randrange(2, 12) for i in range(1500)}
    packer = packing.Packer(packing.Limits(loss_tokens=loss_tokens), 0)
    for i, n in sizes.items():
        packer.add(packing.Part(i, bytes(4 * n), 0, rnd.randrange(3)))
    packer.finish()
    used, segments, loss, total, at = Counter(), Counter(), Counter(), Counter(), {}
    for doc, start, n, _, _, sequence, offset, bearing in packer.take():
        assert offset == used[sequence] and start == total[doc]
        used[sequence] += n
        segments[sequence] += 1
        loss[sequence] += bearing
        total[doc] += n
    assert total == sizes
    assert max(segments.values()) <= 64 and max(loss.values()) <= loss_tokens
    assert all(n & (n - 1) == 0 for n in used.values())
