"""A small causal self-attention model over token classes, in numpy.

One layer and one head.  A query sees itself and the ``CONTEXT - 1`` tokens
before it in its text.  As the inputs are a few hundred classes, the products
of all queries and keys are one table, and a window's attention weights are
looked up in it.  The output is a softmax in two steps: the group of the next
class, then the class within its group.
"""

from __future__ import annotations

import numpy as np

CLASSES, GROUP, WIDTH, CONTEXT = 256, 16, 16, 6
GROUPS = CLASSES // GROUP
WINDOW = 1 << 12
LARGE = 40  # exponents beyond it are taken relative to the largest of their token
ONES = np.ones(GROUP, np.float32)
SHAPES = {
    "embed": (CLASSES, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "own": (WIDTH, WIDTH),
    "near": (CONTEXT,), "hidden": (WIDTH,), "group": (WIDTH, GROUPS), "group_bias": (GROUPS,),
    "class": (GROUPS, WIDTH, GROUP), "class_bias": (GROUPS, GROUP),
}


def keep_memory() -> None:
    """Let a process reuse the memory of arrays it has freed: glibc hands freed blocks back unless a larger one was freed before."""
    np.zeros(30 << 20, np.uint8)


def start(frequencies: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters that give every class its frequency, whatever stands before."""
    rng = np.random.default_rng(seed)
    p = {name: rng.normal(0, 0.3 if name == "embed" else shape[0] ** -0.5, shape) for name, shape in SHAPES.items()}
    share = (frequencies + 0.5) / (frequencies + 0.5).sum()
    by_group = share.reshape(GROUPS, GROUP)
    p["near"], p["hidden"] = np.zeros(CONTEXT), np.full(WIDTH, 0.1)
    p["group"], p["class"] = p["group"] * 0.1, rng.normal(0, 0.03, SHAPES["class"])
    p["group_bias"] = np.log(by_group.sum(1))
    p["class_bias"] = np.log(by_group / by_group.sum(1, keepdims=True))
    return {name: v.astype(np.float32) for name, v in p.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[name].ravel() for name in SHAPES])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


class Scorer:
    """The model with its tables worked out."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.q, self.k, self.v = (p["embed"] @ p[name] for name in ("query", "key", "value"))
        self.v_columns = np.ascontiguousarray(self.v.T)
        own = (p["embed"] @ p["own"] + p["hidden"]).T
        self.own = np.vstack([own, np.ones((1, CLASSES), own.dtype)])  # a hidden state ends with a 1, which the biases multiply
        self.match = np.exp(np.clip(self.q @ self.k.T / np.sqrt(WIDTH), -15, 15)).ravel().astype(self.v.dtype)
        self.near = np.exp(np.clip(p["near"], -10, 10))
        self.group = np.vstack([p["group"], p["group_bias"]]).T
        self.inner = np.concatenate([p["class"], p["class_bias"][:, None]], 1).transpose(0, 2, 1)

    def attend(self, x: np.ndarray, place: np.ndarray):
        """Hidden states of the tokens behind the first ``CONTEXT - 1``, with a 1 at the end, and what they are made of.

        ``x`` is an index array, ``place`` a token's place in its text; what lies before it is masked.
        All of these have a column per token, so that weights multiply whole rows.
        """
        head, n = CONTEXT - 1, len(x) - CONTEXT + 1
        now, at = x[head:], place[head:]
        row = now * CLASSES
        values = self.v_columns.take(x, axis=1)
        weights = np.empty((CONTEXT, n), values.dtype)
        early = np.flatnonzero(at < head)
        for r, near in enumerate(self.near):
            w = weights[r]
            self.match.take(row + x[head - r : len(x) - r], out=w, mode="clip")
            w *= near
            if r:
                w[early[at[early] < r]] = 0
        weights /= weights.sum(0)
        mixed = values[:, head:] * weights[0]
        part = np.empty_like(mixed)
        for r in range(1, CONTEXT):
            mixed += np.multiply(values[:, head - r : len(x) - r], weights[r], out=part)
        hidden = self.own.take(now, axis=1)
        hidden[:WIDTH] += mixed
        return np.maximum(hidden, 0, out=hidden), weights, mixed, values

    def logits(self, h: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the groups, and of the classes of a token's group, with a column per token.

        Tokens stand in the order of their groups, which end at ``ends``.
        """
        outer, inner = self.group @ h, np.empty((GROUP, h.shape[1]), h.dtype)
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if a < b:
                np.matmul(self.inner[k], h[:, a:b], out=inner[:, a:b])
        for z in (outer, inner):
            if z.size and max(z.max(), -z.min()) > LARGE:
                z -= z.max(0)
        return outer, inner

    def log_probs(self, x: np.ndarray, y: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Natural logarithm of the chance of each ``y`` after its ``x``.

        The texts stand one behind the other.  Windows overlap by the context, so
        every token is scored once with all it may see.
        """
        head = CONTEXT - 1
        x = np.concatenate([np.zeros(head, np.uint8), x])
        place = np.concatenate([np.zeros(head, np.int32), place])
        out = np.empty(len(y), np.float32)
        for at in range(0, len(y), WINDOW):
            to = min(at + WINDOW, len(y))
            h, _, _, _ = self.attend(x[at : to + head].astype(np.intp), place[at : to + head])
            order, target, ends = by_group(y[at:to])
            outer, inner = self.logits(h.take(order, axis=1), ends)
            every = np.arange(to - at)
            found = outer.ravel().take((target >> 4) * (to - at) + every) + inner.ravel().take((target & 15) * (to - at) + every)
            found -= np.log((ONES @ np.exp(outer, out=outer)) * (ONES @ np.exp(inner, out=inner)))
            out[at + order] = found
        return out


def by_group(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of classes by their groups, the classes in this order, and where each group ends."""
    order = np.argsort(y >> 4, kind="stable")
    target = y.take(order).astype(np.intp)
    return order, target, np.cumsum(np.bincount(target >> 4, minlength=GROUPS)).tolist()


def gradients(
    p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, place: np.ndarray, counted: np.ndarray | None = None
) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradient over a batch of texts standing one behind the other.

    Tokens that are not ``counted`` are seen by those behind them, and have no loss of their own.
    """
    head, size = CONTEXT - 1, len(y)
    counted = np.ones(size, bool) if counted is None else counted
    n = max(1, int(counted.sum()))
    s = Scorer(p)
    full = np.concatenate([np.zeros(head, np.uint8), x]).astype(np.intp)
    h, weights, mixed, values = s.attend(full, np.concatenate([np.zeros(head, np.int32), place]))
    g = {name: np.zeros(shape) for name, shape in SHAPES.items()}
    # tokens that count, in the order of their groups: each group is a slice
    places = np.flatnonzero(counted)
    order, target, ends = by_group(y.take(places))
    order = places.take(order)
    h = h.take(order, axis=1)
    outer, inner = s.logits(h, ends)
    every, ones, loss = np.arange(len(order)), np.ones(GROUP, h.dtype), 0.0
    for z, own in ((outer, target >> 4), (inner, target & 15)):
        np.exp(z, out=z)
        z *= 1 / (ones @ z)
        cells = own * len(order) + every
        chosen = z.ravel().take(cells)
        loss -= np.log(chosen).sum(dtype=float)
        z.ravel()[cells] = chosen - 1
    d_group = h @ outer.T
    g["group"], g["group_bias"] = d_group[:WIDTH], d_group[WIDTH]
    dh = p["group"] @ outer
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            d_class = h[:, a:b] @ inner[:, a:b].T
            g["class"][k], g["class_bias"][k] = d_class[:WIDTH], d_class[WIDTH]
            dh[:, a:b] += p["class"][k] @ inner[:, a:b]
    dh *= h[:WIDTH] > 0
    g["hidden"] = dh.sum(1)
    back = np.full(size, len(order))  # the last column, of zeros, stands for tokens that do not count
    back[order] = every
    dh = np.hstack([dh, np.zeros((WIDTH, 1), dh.dtype)]).take(back, axis=1)
    d_own = _by_class(x, dh)
    d_seen = np.zeros((WIDTH, len(full)), dh.dtype)
    d_weights, part = np.empty((CONTEXT, size), dh.dtype), np.empty_like(dh)
    for r in range(CONTEXT):
        behind = slice(head - r, len(full) - r)
        d_seen[:, behind] += np.multiply(dh, weights[r], out=part)
        np.einsum("it,it->t", dh, values[:, behind], out=d_weights[r])
    d_weights -= np.einsum("it,it->t", dh, mixed)
    d_weights *= weights
    g["near"] = d_weights.sum(1, dtype=float)
    d_value = _by_class(full, d_seen)
    cells, row = np.empty((CONTEXT, size), np.intp), full[head:] * CLASSES
    for r in range(CONTEXT):
        np.add(row, full[head - r : len(full) - r], out=cells[r])
    d_match = np.bincount(cells.ravel(), d_weights.ravel(), CLASSES * CLASSES)
    d_match = d_match.reshape(CLASSES, CLASSES) / np.sqrt(WIDTH)
    for name, d in (("query", d_match @ s.k), ("key", d_match.T @ s.q), ("value", d_value), ("own", d_own)):
        g[name] = p["embed"].T @ d
        g["embed"] += d @ p[name].T
    return loss / n, {name: v / n for name, v in g.items()}


def _by_class(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sums of the columns with equal class, one row per class."""
    return np.stack([np.bincount(x, row, CLASSES) for row in columns], 1)


class Trainer:
    """Adam on batches of texts."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.steps = p, rate, 0
        self.first, self.second = np.zeros(len(pack(p))), np.zeros(len(pack(p)))

    def step(self, x, y, place, counted=None) -> float:
        loss, g = gradients(self.p, x, y, place, counted)
        d = pack(g)
        self.steps += 1
        self.first += 0.1 * (d - self.first)
        self.second += 0.01 * (d * d - self.second)
        m, v = self.first / (1 - 0.9**self.steps), self.second / (1 - 0.99**self.steps)
        self.p = unpack(pack(self.p) - self.rate * m / (np.sqrt(v) + 1e-8))
        return loss


def sequences(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, next classes and places of texts; class 0 stands before and behind each."""
    x = np.concatenate([np.append(np.uint8(0), t) for t in texts])
    y = np.concatenate([np.append(t, np.uint8(0)) for t in texts])
    place = np.concatenate([np.arange(len(t) + 1, dtype=np.int32) for t in texts])
    return x.astype(np.uint8), y.astype(np.uint8), place


def sequences_of_blocks(blocks: list[tuple[np.ndarray, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`sequences`, and which tokens count, for blocks of texts.

    A block is its classes, the place of its first token, how many of its tokens
    only give context, as they count in the block before, and whether its text
    ends with it.  ``CONTEXT`` tokens of context make up for all that lies before.
    """
    texts = [t for t, _, _, _ in blocks]
    x, y, place = sequences(texts)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    kept, counted = np.ones(len(y), bool), np.ones(len(y), bool)
    for (t, at, context, last), a in zip(blocks, first.tolist()):
        place[a : a + len(t) + 1] += at
        counted[a : a + context] = False
        kept[a + len(t)] = last
    return x[kept], y[kept], place[kept], counted[kept]
