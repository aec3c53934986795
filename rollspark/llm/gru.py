"""A small gated recurrent network with a class-factored output, in numpy: truncated backpropagation and whole-text scoring.

States and activations stand in columns, a row for each unit, so that every operation runs along memory.

Tokens are numbers. Those under ``classes * width`` are known one by one: number i stands in class i // width. Each number
beyond is a class of its own, whose inside the network does not know. P(token) = P(class | state) * P(token | class, state).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

END = 0  # the token that ends a text, and the input before its first token


class Shape(NamedTuple):
    """How many classes of known tokens, how many tokens in each, how many other classes, and the size of the state."""

    classes: int
    width: int
    others: int
    hidden: int

    @property
    def known(self) -> int:
        return self.classes * self.width

    def sizes(self) -> list[tuple[int, ...]]:
        c, h = self.classes + self.others, self.hidden
        return [(self.known + self.others, 3 * h), (h, 3 * h), (h, c), (c,), (self.classes, h, self.width), (self.classes, self.width)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for size in self.sizes():
            n = int(np.prod(size))
            out.append(flat[at : at + n].reshape(size))
            at += n
        return out

    def class_of(self, tokens: np.ndarray) -> np.ndarray:
        return np.where(tokens < self.known, tokens // self.width, tokens - self.known + self.classes)


def initial(shape: Shape, counts: np.ndarray, seed: int = 1) -> np.ndarray:
    """Flat weights that give every token its share in the counts."""
    rng = np.random.default_rng(seed)
    e, u, o, b, ow, bw = (np.zeros(s, np.float32) for s in shape.sizes())
    h = shape.hidden
    e += rng.normal(0, 0.3, e.shape)
    e[:, :h] -= 0.5
    u[:, : 2 * h] += rng.normal(0, 0.3 / h**0.5, (h, 2 * h))
    u[:, 2 * h :] += rng.normal(0, 1 / h**0.5, (h, h))
    inside = counts[: shape.known].reshape(shape.classes, shape.width) + 1e-3
    each = np.r_[inside.sum(1), counts[shape.known :] + 1e-3]
    b += np.log(each / each.sum())
    bw += np.log(inside / inside.sum(1, keepdims=True))
    return np.concatenate([x.ravel() for x in (e, u, o, b, ow, bw)]).astype(np.float32)


def _step(given: np.ndarray, h: np.ndarray, ut: np.ndarray):
    """One step from the inputs' columns; gives the states and what the backward pass needs."""
    n = len(h)
    a = ut @ h
    zr = given[: 2 * n] + a[: 2 * n]
    zr *= np.float32(0.5)
    np.tanh(zr, out=zr)
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    hv = a[2 * n :]
    c = zr[n:] * hv
    c += given[2 * n :]
    np.tanh(c, out=c)
    new = h - c
    new *= zr[:n]
    new += c
    return new, zr, hv, c


def _tops(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Logits of states, which lie within -1 and 1, may be too large for ``exp`` as they are."""
    return float(np.abs(weights).sum(-2).max() + np.abs(bias).max()) > 60


def _exps(logits: np.ndarray, large: bool):
    """Exponents in place; gives their sums by column, and what was taken off before."""
    top = np.float32(0)
    if large:
        top = logits.max(0)
        logits -= top
    np.exp(logits, out=logits)
    return logits.sum(0), top


def _in_classes(kinds: np.ndarray, classes: int):
    """The places of the tokens in known classes, in the order of classes, and (class, begin, end) in that order."""
    order = np.argsort(kinds.astype(np.uint16), kind="stable")
    ends = np.searchsorted(kinds[order], np.arange(classes + 1))
    return order[: ends[-1]], [(c, ends[c], ends[c + 1]) for c in range(classes) if ends[c] < ends[c + 1]]


def train(shape: Shape, flat: np.ndarray, tokens: np.ndarray, weights: np.ndarray | None = None, streams: int = 512, window: int = 16, rate: float = 0.01) -> np.ndarray:
    """One pass of Adam over texts that are each ended by END, cut into parallel streams.

    ``weights`` says how often each token counts. States are carried from window to window and start anew after END;
    gradients go back through one window at most.
    """
    n = len(tokens)
    streams = max(1, min(streams, n // (8 * window)))
    length = -(-n // streams)
    if not n:
        return flat
    spare = streams * length - n  # fills up the streams, and is not learned from
    weights = np.ones(n, np.float32) if weights is None else weights.astype(np.float32)
    ys = np.ascontiguousarray(np.r_[tokens, np.full(spare, END)].reshape(streams, length).T)
    xs = np.ascontiguousarray(np.r_[END, tokens, np.full(spare, END)][:-1].reshape(streams, length).T)
    ws = np.ascontiguousarray(np.r_[weights, np.zeros(spare, np.float32)].reshape(streams, length).T)
    flat = flat.copy()
    grad, m, s = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    e, u, o, b, ow, bw = shape.split(flat)
    ge, gu, go, gb, gow, gbw = shape.split(grad)
    k = shape.hidden
    h = np.zeros((k, streams), np.float32)
    for turn, begin in enumerate(range(0, length, window), 1):
        grad[:] = 0
        x, y, w = xs[begin : begin + window], ys[begin : begin + window].ravel(), ws[begin : begin + window].ravel()
        et, ut = np.ascontiguousarray(e.T), np.ascontiguousarray(u.T)
        kept, states, before = [], [], []
        goes_on = (x != END).astype(np.float32)
        for t in range(len(x)):
            h = h * goes_on[t]
            before.append(h)
            h, zr, hv, c = _step(et[:, x[t]], h, ut)
            kept.append((zr, hv, c)), states.append(h)
        hs = np.concatenate(states, 1)
        kinds = shape.class_of(y)
        share = w / max(float(w.sum()), 1e-9)
        p = o.T @ hs
        p += b[:, None]
        p *= share / _exps(p, _tops(o, b))[0]
        p[kinds, np.arange(len(y))] -= share
        go += hs @ p.T
        gb += p.sum(1)
        dhs = o @ p
        order, spans = _in_classes(kinds, shape.classes)
        own, own_y, own_share, large = hs[:, order], y[order] % shape.width, share[order], _tops(ow, bw)
        back_own = np.empty_like(own)
        for c, i, j in spans:
            q = ow[c].T @ own[:, i:j]
            q += bw[c][:, None]
            q *= own_share[i:j] / _exps(q, large)[0]
            q[own_y[i:j], np.arange(j - i)] -= own_share[i:j]
            gow[c] += own[:, i:j] @ q.T
            gbw[c] += q.sum(1)
            back_own[:, i:j] = ow[c] @ q
        dhs[:, order] += back_own
        dh = np.zeros_like(h)
        rows = np.empty((3 * k, len(x), streams), np.float32)  # gradients of each step's inputs
        back = np.empty_like(rows)  # and of what the states before add
        for t in range(len(x) - 1, -1, -1):
            zr, hv, c = kept[t]
            z, r = zr[:k], zr[k:]
            dh += dhs[:, t * streams : (t + 1) * streams]
            dc = dh * (1 - z)
            dc *= 1 - c * c
            d = np.empty((3 * k, streams), np.float32)
            np.multiply(dh, before[t] - c, out=d[:k])
            np.multiply(dc, hv, out=d[k : 2 * k])
            d[: 2 * k] *= zr * (1 - zr)
            d[2 * k :] = dc
            rows[:, t] = d
            d[2 * k :] *= r
            back[:, t] = d
            dh = dh * z
            dh += u @ d
            dh *= goes_on[t]
        gu += np.concatenate(before, 1) @ back.reshape(3 * k, -1).T
        seen = x.ravel()
        for i, row in enumerate(rows.reshape(3 * k, -1)):
            ge[:, i] = np.bincount(seen, row, len(ge))
        grad *= min(1.0, 1.0 / (float(np.sqrt(grad @ grad)) + 1e-9))
        m += np.float32(0.1) * (grad - m)
        s += np.float32(0.01) * (grad * grad - s)
        flat -= np.float32(rate / (1 - 0.9**turn)) * m / (np.sqrt(s / np.float32(1 - 0.99**turn)) + np.float32(1e-6))
    return flat


def score(shape: Shape, flat: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, window: int = 32) -> np.ndarray:
    """The natural log-probability of each text (its END included); ``tokens`` holds the texts one after the other.

    Windows bound memory; states go on through them, over whole texts.
    """
    e, u, o, b, ow, bw = shape.split(flat)
    n = len(lengths)
    if not n:
        return np.zeros(0)
    et, ut, ot = np.ascontiguousarray(e.T), np.ascontiguousarray(u.T), np.ascontiguousarray(o.T)
    large = _tops(o, b), _tops(ow, bw)
    order = np.argsort(-lengths, kind="stable")
    sorted_, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    total = np.zeros(n)
    h = np.zeros((shape.hidden, n), np.float32)
    x = np.full(n, END)
    active = np.searchsorted(-sorted_, -np.arange(sorted_[0]), "left")  # texts longer than t
    for begin in range(0, int(sorted_[0]), window):
        states, ys = [], []
        for t in range(begin, min(begin + window, int(sorted_[0]))):
            a = active[t]
            h = _step(et[:, x[:a]], h[:, :a], ut)[0]
            x = tokens[starts[:a] + t]
            states.append(h), ys.append(x)
        hs, y = np.concatenate(states, 1), np.concatenate(ys)
        who = np.concatenate([np.arange(len(i)) for i in ys])
        kinds = shape.class_of(y)
        got = np.empty(len(y))
        for i in range(0, len(y), 4096):  # slices that stay in a processor's cache
            logits = ot @ hs[:, i : i + 4096]
            logits += b[:, None]
            got[i : i + 4096] = _log_shares(logits, kinds[i : i + 4096], large[0])
        places, spans = _in_classes(kinds, shape.classes)
        own, own_y = hs[:, places], y[places] % shape.width
        for c, i, j in spans:
            for k in range(i, j, 4096):
                part = slice(k, min(j, k + 4096))
                logits = ow[c].T @ own[:, part]
                logits += bw[c][:, None]
                got[places[part]] += _log_shares(logits, own_y[part], large[1])
        total += np.bincount(who, got, n)
    out = np.empty(n)
    out[order] = total
    return out


def _log_shares(logits: np.ndarray, at: np.ndarray, large: bool) -> np.ndarray:
    """The log of one unit's share in each column."""
    own = logits[at, np.arange(len(at))]
    sums, top = _exps(logits, large)
    return own - top - np.log(sums)
