"""A small gated recurrent network over symbols in numpy: truncated backpropagation, class-factored output.

The symbols are frequent words and, for all other words, their ending. A symbol's probability is that of its class of
SIDE symbols times its share in the class, both softmaxes over the state. The state is carried from window to window.
"""

from __future__ import annotations

import numpy as np

SIDE, STATE, WINDOW = 16, 24, 16
SYMBOLS = SIDE * SIDE
SHAPES = {"x": (SYMBOLS, 3 * STATE), "u": (STATE, 3 * STATE), "c": (STATE, SIDE), "cb": (SIDE,),
          "s": (SIDE, STATE, SIDE), "sb": (SIDE, SIDE)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as named views of one vector."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at:at + size].reshape(shape)
        at += size
    return out


def initial() -> np.ndarray:
    flat = np.zeros(SIZE, np.float32)
    rng, p = np.random.default_rng(11), views(flat)
    for name in ("x", "u", "c", "s"):
        p[name][...] = rng.normal(0, 0.2, SHAPES[name])
    return flat


def step(p: dict[str, np.ndarray], given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(new state, gates, candidate, recurrent part) for inputs already looked up in x; lanes lie in columns inside."""
    given, h = given.T, h.T
    part = p["u"].T @ h
    gates = part[:2 * STATE] + given[:2 * STATE]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    fresh = gates[STATE:] * part[2 * STATE:]
    fresh += given[2 * STATE:]
    np.tanh(fresh, out=fresh)
    new = h - fresh
    new *= gates[:STATE]
    new += fresh
    return new.T, gates.T, fresh.T, part[2 * STATE:].T


def by_side(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the targets by their class, and where each class begins; few bits are sorted in one pass."""
    side = (target // SIDE).astype(np.uint16)
    order = np.argsort(side, kind="stable")
    return order, np.searchsorted(side[order], np.arange(SIDE + 1))


def softmax(logits: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


def side_shares(p: dict[str, np.ndarray], hs: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the classes, and of the symbols in the class, for the states of targets in the order of classes."""
    outer = p["c"].T @ hs.T
    outer += p["cb"][:, None]
    inner = np.empty((SIDE, len(hs)), hs.dtype)
    for c in np.flatnonzero(np.diff(cut)):
        own = slice(cut[c], cut[c + 1])
        inner[:, own] = p["s"][c].T @ hs[own].T
        inner[:, own] += p["sb"][c][:, None]
    return softmax(outer), softmax(inner)


def log_shares(p: dict[str, np.ndarray], h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probability of each target under its state."""
    order, cut = by_side(target)
    outer, inner = side_shares(p, h[order], cut)
    goal, at = target[order], np.arange(len(order))
    out = np.empty(len(order))
    out[order] = np.log(np.maximum(outer[goal // SIDE, at], 1e-30)) + np.log(np.maximum(inner[goal % SIDE, at], 1e-30))
    return out


def train(flat: np.ndarray, symbols: np.ndarray, starts: np.ndarray, begin: int, rounds: int, rate: float) -> np.ndarray:
    """Adam over windows of lanes cut from the row of `symbols`; `starts` marks where a text begins."""
    flat = flat.copy()
    n = len(symbols)
    lanes = int(np.clip(n // 4000, 8, 512))
    length = -(-n // lanes)
    pad = lanes * length - n
    lane = lambda v, fill: np.append(v, np.full(pad, fill, v.dtype)).reshape(lanes, length).T.copy()
    given = np.where(starts, begin, np.append(begin, symbols[:-1]))
    target, given = lane(symbols.astype(np.uint16), 0), lane(given.astype(np.uint16), 0)  # sorted in one pass
    keep, weight = lane(1 - starts.astype(np.float32), 1), lane(np.ones(n, np.float32), 0)
    m, v, t = np.zeros(SIZE, np.float32), np.zeros(SIZE, np.float32), 0
    total = rounds * -(-length // WINDOW)
    for _ in range(rounds):
        h = np.zeros((lanes, STATE), np.float32)
        for at in range(0, length, WINDOW):
            part = slice(at, min(at + WINDOW, length))
            h, gradient = window_gradient(views(flat), given[part], target[part], keep[part], weight[part], h)
            t += 1
            gradient *= min(1, 1 / (float(np.sqrt((gradient**2).sum())) + 1e-9))
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            now = rate * (1 - 0.9 * t / total) / (1 - 0.9**t)
            flat -= now * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return flat


def window_gradient(p: dict[str, np.ndarray], given: np.ndarray, target: np.ndarray, keep: np.ndarray,
                    weight: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state after a window (time, lanes) and the gradient of its mean log loss."""
    time, lanes = given.shape
    before, saved, states = [], [], np.empty((time, lanes, STATE), np.float32)
    looked = np.ascontiguousarray(p["x"][given].transpose(0, 2, 1))
    for t in range(time):
        h = h * keep[t][:, None]
        before.append(h.T)
        h, *rest = step(p, looked[t].T, h)
        states[t] = h
        saved.append([x.T for x in rest])
    flat = np.zeros(SIZE, np.float32)
    g = views(flat)
    goal = target.ravel()
    scale = (weight / max(weight.sum(), 1)).ravel()
    order, cut = by_side(goal)
    hs, goal, scale, at = states.reshape(-1, STATE)[order], goal[order], scale[order], np.arange(len(goal))
    outer, inner = side_shares(p, hs, cut)
    outer[goal // SIDE, at] -= 1
    inner[goal % SIDE, at] -= 1
    outer *= scale
    inner *= scale
    g["c"][...], g["cb"][...] = (outer @ hs).T, outer.sum(axis=1)
    sorted_back = outer.T @ p["c"].T
    for c in np.flatnonzero(np.diff(cut)):
        own = slice(cut[c], cut[c + 1])
        g["s"][c], g["sb"][c] = (inner[:, own] @ hs[own]).T, inner[:, own].sum(axis=1)
        sorted_back[own] += inner[:, own].T @ p["s"][c].T
    back = np.empty_like(sorted_back)
    back[order] = sorted_back
    back = np.ascontiguousarray(back.reshape(time, lanes, STATE).transpose(0, 2, 1))
    later = np.zeros((STATE, lanes), np.float32)
    inputs = np.empty((time, lanes, 3 * STATE), np.float32)
    own, recurrent = np.empty((3 * STATE, lanes), np.float32), np.empty((3 * STATE, lanes), np.float32)
    slope = np.zeros((3 * STATE, STATE), np.float32)
    for t in range(time - 1, -1, -1):
        gates, fresh, part = saved[t]
        z, r = gates[:STATE], gates[STATE:]
        dh = back[t] + later
        rest = 1 - z
        new = dh * rest
        new *= 1 - fresh**2
        own[:STATE] = dh * (before[t] - fresh) * z * rest
        own[STATE:2 * STATE] = new * part * r * (1 - r)
        own[2 * STATE:] = new
        inputs[t] = own.T
        recurrent[...] = own
        recurrent[2 * STATE:] *= r
        slope += recurrent @ before[t].T
        later = (dh * z + p["u"] @ recurrent) * keep[t]
    g["u"][...] = slope.T
    flat_given = given.ravel()
    order = np.argsort(flat_given, kind="stable")
    cut = np.flatnonzero(np.append(True, flat_given[order][1:] != flat_given[order][:-1]))
    g["x"][flat_given[order][cut]] = np.add.reduceat(inputs.reshape(-1, 3 * STATE)[order], cut, axis=0)
    return h, flat


def score(flat: np.ndarray, symbols: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """Natural log probability of each text's symbols; all texts of a block step together, the longest to the end."""
    p, sizes = views(flat), np.diff(first)
    x = np.ascontiguousarray(p["x"].T)
    order = np.argsort(-sizes, kind="stable")
    sizes, at = sizes[order], first[:-1][order]
    out, h = np.zeros(len(order)), np.zeros((len(order), STATE), np.float32)
    for t in range(0, int(sizes[0]) if len(sizes) else 0, 4 * WINDOW):
        alive = int(np.searchsorted(-sizes, -t, "left"))  # sizes above t
        hs, goals, rows = [], [], []
        for k in range(t, min(t + 4 * WINDOW, int(sizes[0]))):
            own = int(np.searchsorted(-sizes, -k, "left"))
            if own == 0:
                break
            given = symbols[at[:own] + k - 1] if k else np.full(own, begin)
            h = step(p, x[:, given].T, h[:own])[0]
            hs.append(h), goals.append(symbols[at[:own] + k]), rows.append(np.arange(own))
        logs = log_shares(p, np.concatenate(hs), np.concatenate(goals))
        out[:alive] += np.bincount(np.concatenate(rows), logs, minlength=alive)
    back = np.empty(len(order))
    back[order] = out
    return back
