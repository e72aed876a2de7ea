import math

import haruspex.llm.ctw as m
import numpy as np
from haruspex.llm.ctw import ContextTree


def test_no_node_is_left_out(monkeypatch):
    monkeypatch.setattr(m, "SLOTS", 1 << 14, raising=False)  # where nodes were hashed, they lost their slots to others
    rng = np.random.default_rng(4)
    u = np.unique(rng.integers(97, 103, (3000, m.DEPTH + 1)).astype(np.uint64) @ (np.uint64(256) ** np.arange(m.DEPTH, -1, -1, dtype=np.uint64)))
    n = rng.integers(1, 9, len(u))
    counts, split, trust = {}, {}, {}
    for g, k in zip(u.tolist(), n.tolist()):
        for d in range(m.DEPTH + 1):
            for bit in range(8):
                x = counts.setdefault((d, (g >> 8) % 256**d, (g % 256 | 256) >> 8 - bit), [0, 0])
                x[g >> 7 - bit & 1] += k
    lg = math.lgamma
    for (d, c, p), (a, b) in sorted(counts.items(), reverse=True):
        own = lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
        weighted = own if d == m.DEPTH else np.logaddexp(own, split[d, c, p]) - math.log(2)
        trust[d, c, p] = 1.0 if d == m.DEPTH else math.exp(own - math.log(2) - weighted)
        if d:
            up = (d - 1, c % 256 ** (d - 1), p)
            split[up] = split.get(up, 0.0) + weighted

    def plain(g):
        out = 0.0
        for bit in range(8):
            q, left, last, one = 0.0, 1.0, 0.5, g >> 7 - bit & 1
            for d in range(m.DEPTH + 1):
                key = (d, (g >> 8) % 256**d, (g % 256 | 256) >> 8 - bit)
                if key not in counts:
                    break
                last = (counts[key][one] + 0.5) / (sum(counts[key]) + 1)
                q, left = q + left * trust[key] * last, left * (1 - trust[key])
            out += math.log10(q + left * last)
        return out

    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tree = ContextTree([(m.DEPTH, u, n), (3, *none), (1, *none)])
    assert len(u) > 2500 and max(abs(tree.mixed_score(u) - [plain(g) for g in u.tolist()])) < 1e-6
