"""Recall of the trees by depth, for pairs whose tokens agree with a chance of the threshold."""

import numpy as np
import pyarrow as pa
import pytest

from vigilog.llm import neardup
from vigilog.llm.common import BATCH_ROWS


def together(pairs: int, depth: int, threshold: float = 0.8) -> list[float]:
    """The share of pairs that share a node at START_DEPTH and after each of ``depth`` more levels."""
    rng = np.random.default_rng(3)
    left = rng.integers(1 << 32, size=(pairs, neardup.WIDTH), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < threshold, left, left ^ np.uint32(1))
    sigs = np.concatenate([left, right])

    def grown(step, node, v):
        out = []
        for at in range(0, len(v), BATCH_ROWS):
            own = v[at:at + BATCH_ROWS]
            batch = pa.RecordBatch.from_pydict({
                "sig": pa.array([x.tobytes() for x in sigs[own]], pa.binary()), "v": pa.array(own),
                "node": pa.array(node[at:at + BATCH_ROWS])})
            out += [(np.asarray(b["node"]), np.asarray(b["v"])) for b in step(threshold)([batch])]
        node, v = (np.concatenate(x) for x in zip(*out, strict=True))
        # only nodes with both of a pair go on
        _, which, n = np.unique(np.stack([node, v % pairs]), axis=1, return_inverse=True, return_counts=True)
        return node[n[which] > 1], v[n[which] > 1]

    v = np.arange(2 * pairs)
    node, v = grown(neardup._roots, np.zeros(len(v), np.int64), v)
    out = [len(np.unique(v)) / 2 / pairs]
    for _ in range(depth):
        node, v = grown(neardup._children, node, v)
        out.append(len(np.unique(v)) / 2 / pairs)
    return out


def test_recall_does_not_fall_with_depth():
    assert min(together(150, 12)) >= 0.997


@pytest.mark.parametrize("seed", [1, 2])
def test_every_node_has_a_child(seed):
    rng = np.random.default_rng(seed)
    node = rng.integers(1 << 62, size=500)
    sig = pa.array([rng.bytes(4 * neardup.WIDTH) for _ in node], pa.binary())
    batch = pa.RecordBatch.from_pydict({"sig": sig, "v": pa.array(np.arange(500)), "node": pa.array(node)})
    met = np.concatenate([np.asarray(b["v"]) for b in neardup._children(0.8)([batch])])
    assert len(np.unique(met)) == 500 and 1.3 < len(met) / 500 < 1.8
