"""A gated recurrent language model with a class-factored softmax, in numpy.

Word ids 0..n-1 run from the commonest; classes are runs of ids of about equal
frequency. P(word) = P(class | state) * P(word | class, state). Many sequences
advance side by side in lanes; a lane takes one document after another, carries
its state from window to window, and starts each document from zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

F32 = np.float32
#: Steps of a window: of truncated backpropagation, and of output computed at once.
WINDOW = 24
#: Tokens whose probabilities are computed at once when scoring, at least.
BLOCK = 12000


def start(counts: np.ndarray, hidden: int = 16, classes: int = 32, seed: int = 3) -> dict:
    """Parameters before training: output biases are log frequencies, so the model starts at the unigram one."""
    rng = np.random.default_rng(seed)
    n = len(counts)
    mass = np.cumsum(counts) / counts.sum()
    edge = np.unique(np.minimum(np.searchsorted(mass, np.arange(1, classes) / classes) + 1, n))
    edge = np.concatenate([[0], edge[edge < n], [n]])
    of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    per = np.bincount(of, counts)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(F32)
    return {
        "edge": edge, "of": of,
        "I": draw(n, 3 * hidden), "U": draw(hidden, 3 * hidden) * F32(2), "b": np.zeros(3 * hidden, F32),
        "C": draw(hidden, len(edge) - 1), "c": np.log(per / per.sum()).astype(F32),
        "O": draw(hidden, n), "o": np.log(counts / per[of]).astype(F32),
    }


TRAINED = ("I", "U", "b", "C", "c", "O", "o")


def lanes(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of the token at each step and lane (-1: none), and whether a document starts there; the longest lane first."""
    width = max(1, min(width, len(sizes)))
    begin = np.cumsum(sizes) - sizes
    load, of = np.zeros(width, np.int64), [[] for _ in range(width)]
    for d in np.argsort(-sizes, kind="stable"):
        lane = int(load.argmin())
        of[lane].append(d)
        load[lane] += sizes[d]
    at = np.full((int(load.max()), width), -1, np.int32)
    first = np.zeros(at.shape, bool)
    for lane, full in enumerate(np.argsort(-load, kind="stable").tolist()):
        step = 0
        for d in of[full]:
            at[step : step + sizes[d], lane] = np.arange(begin[d], begin[d] + sizes[d])
            first[step, lane] = sizes[d] > 0
            step += sizes[d]
    return at, first


def _softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each column, in place."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_prob(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The log softmax of each column at its row k; x is overwritten."""
    x -= x.max(0)
    own = x[k, np.arange(len(k))]
    np.exp(x, out=x)
    return own - np.log(x.sum(0))


def _steps(m: dict, tokens: np.ndarray, at: np.ndarray, first: np.ndarray, end: int) -> Iterator[tuple]:
    """For each window: its positions, inputs and starts, then by step and lane the states before and after, the gates
    r and z, the candidate n, and what r gates.

    Lanes that have ended, which are the last ones, take no part.
    """
    hidden = len(m["U"])
    h = np.zeros((at.shape[1], hidden), F32)
    before = np.where(first | (at <= 0), end, tokens[np.maximum(at - 1, 0)])
    for lo in range(0, len(at), WINDOW):
        rows = np.s_[lo : lo + WINDOW, : int((at[lo] >= 0).sum())]
        x, f = m["I"][before[rows]] + m["b"], first[rows]  # looked up here, as training changes them between windows
        h, fresh = h[: f.shape[1]], f.any(1)
        past, now, n, gated = (np.empty((*f.shape, hidden), F32) for _ in range(4))
        rz = np.empty((*f.shape, 2 * hidden), F32)
        for t in range(len(f)):
            if fresh[t]:
                h = h * ~f[t][:, None]
            past[t] = h
            u = h @ m["U"]
            g = np.add(x[t, :, : 2 * hidden], u[:, : 2 * hidden], out=rz[t])
            g *= F32(0.5)
            np.tanh(g, out=g)
            g *= F32(0.5)
            g += F32(0.5)
            gated[t] = u[:, 2 * hidden :]
            c = np.multiply(g[:, :hidden], gated[t], out=n[t])
            c += x[t, :, 2 * hidden :]
            np.tanh(c, out=c)
            h = h - c
            h *= g[:, hidden:]
            h += c
            now[t] = h
        yield at[rows], before[rows], f, past, now, rz[:, :, :hidden], rz[:, :, hidden:], n, gated


def _order(x: np.ndarray, n: int) -> np.ndarray:
    """A stable order of ids below n; short integers are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


def _by_class(m: dict, cls: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Of each class of several words: its words a..z, and its run i..j of the order."""
    cls = cls[order]
    cut = [0, *(np.flatnonzero(np.diff(cls)) + 1).tolist(), len(cls)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if j > i:
            a, z = m["edge"][cls[i]], m["edge"][cls[i] + 1]
            if z - a > 1:
                yield int(a), int(z), i, j


def score(m: dict, tokens: np.ndarray, sizes: np.ndarray, end: int, width: int = 256) -> np.ndarray:
    """log10 probability of each document; ``tokens`` of all documents on end, ``sizes`` of each."""
    out = np.zeros(len(tokens))

    def fill(spot: np.ndarray, h: np.ndarray) -> None:
        cls = m["of"][tokens[spot]]
        order = _order(cls, len(m["edge"]))
        spot, h = spot[order], h[order]
        words = tokens[spot]
        p = _log_prob(m["C"].T @ h.T + m["c"][:, None], cls[order])
        for a, z, i, j in _by_class(m, cls, order):
            p[i:j] += _log_prob(m["O"][:, a:z].T @ h[i:j].T + m["o"][a:z, None], words[i:j] - a)
        out[spot] = p

    spots, states, held = [], [], 0
    for at, _, _, _, now, *_ in _steps(m, tokens, *lanes(sizes, width), end) if len(tokens) else ():
        live = at >= 0
        spots.append(at[live])
        states.append(now[live])
        held += len(spots[-1])
        if held >= BLOCK:  # windows of few lanes are put together
            fill(np.concatenate(spots), np.concatenate(states))
            spots, states, held = [], [], 0
    if held:
        fill(np.concatenate(spots), np.concatenate(states))
    sums = np.concatenate([[0.0], np.cumsum(out)])
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]) / np.log(10)


#: Windows that a shard is learned from in, about; it sets how many documents advance side by side.
UPDATES = 250


def train(m: dict, tokens: np.ndarray, sizes: np.ndarray, end: int, width: int | None = None, rate: float = 0.2, epochs: int = 1) -> dict:
    """One pass (or more) of truncated backpropagation with Adagrad; returns new parameters."""
    width = width or int(np.clip(len(tokens) // (UPDATES * WINDOW), 16, 256))
    m = m | {k: m[k].copy() for k in TRAINED}
    total = {k: np.full_like(m[k], 1e-3) for k in TRAINED}
    hidden = len(m["U"])
    slope, bias = np.zeros_like(m["O"]), np.zeros_like(m["o"])

    def move(k: str, g: np.ndarray, part=...) -> None:
        """Only parameters with a gradient move; Adagrad leaves the others as they are. g is overwritten."""
        np.clip(g, -5, 5, out=g)
        total[k][part] += g * g
        g /= np.sqrt(total[k][part])
        g *= F32(rate)
        m[k][part] -= g

    for _ in range(epochs if len(tokens) else 0):
        for at, before, f, past, now, r, z, n, gated in _steps(m, tokens, *lanes(sizes, width), end):
            live = at >= 0
            if not live.any():
                continue
            words = tokens[at[live]]
            cls = m["of"][words]
            order = _order(cls, len(m["edge"]))
            h, words = now[live][order], words[order]
            d = _softmax(m["C"].T @ h.T + m["c"][:, None])
            d[cls[order], np.arange(len(words))] -= 1
            back = (m["C"] @ d).T
            move("C", (d @ h).T)
            move("c", d.sum(1))
            slope.fill(0)
            bias.fill(0)
            for a, b, i, j in _by_class(m, cls, order):
                d = _softmax(m["O"][:, a:b].T @ h[i:j].T + m["o"][a:b, None])
                d[words[i:j] - a, np.arange(j - i)] -= 1
                back[i:j] += (m["O"][:, a:b] @ d).T
                slope[:, a:b] = (d @ h[i:j]).T
                bias[a:b] = d.sum(1)
            move("O", slope)
            move("o", bias)
            grad, spread = np.zeros((*at.shape, hidden), F32), np.empty_like(back)
            spread[order] = back
            grad[live] = spread
            to_n = (1 - z) * (1 - n * n)
            to_r, to_z = gated * r * (1 - r), (past - n) * z * (1 - z)
            keep = ~f[:, :, None]
            carry = np.zeros((at.shape[1], hidden), F32)
            into = np.empty((*at.shape, 3 * hidden), F32)  # as it reaches U; the part of n still gated by r
            plain = np.empty((*at.shape, hidden), F32)
            for t in range(len(at) - 1, -1, -1):
                dh = grad[t]
                dh += carry
                dn = np.multiply(dh, to_n[t], out=plain[t])
                np.multiply(dn, to_r[t], out=into[t, :, :hidden])
                np.multiply(dh, to_z[t], out=into[t, :, hidden : 2 * hidden])
                np.multiply(dn, r[t], out=into[t, :, 2 * hidden :])
                carry = into[t] @ m["U"].T
                dh *= z[t]
                carry += dh
                carry *= keep[t]
            turn = past.reshape(-1, hidden).T @ into.reshape(-1, 3 * hidden)
            into[:, :, 2 * hidden :] = plain
            from_, into = before[live], into[live]
            order = _order(from_, len(m["I"]))
            seen, cut = np.unique(from_[order], return_index=True)
            move("U", turn)
            move("b", into.sum(0))
            move("I", np.add.reduceat(into[order], cut), seen)
    return m
