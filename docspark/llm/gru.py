"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, carried state.

Token ids are 0 .. CLASSES * PER_CLASS - 1; a token's class is its id // PER_CLASS.  P(token) = P(class | state) * P(token | class, state).
Inputs enter by table look-up, as an embedding times the input weights of all three gates is itself a table.

The recurrence works on arrays with a row for each unit and a column for each stream, so that no operation runs along the few units
alone; the softmax works on a row for each place.
"""

from __future__ import annotations

import math

import numpy as np

HIDDEN, CLASSES, PER_CLASS = 16, 40, 40
TOKENS = CLASSES * PER_CLASS
#: Tokens that backpropagation looks back, and documents side by side.
WINDOW, STREAMS = 16, 256
F32 = np.float32


#: Logits up to this size are exponentiated as they are; beyond it each row's greatest is taken off first.
SAFE = 60
_ONES = np.ones(max(CLASSES, PER_CLASS), F32)


def _exponentials(x: np.ndarray) -> tuple[np.ndarray | float, np.ndarray]:
    """Exponentiate in place; returns what was taken off each row, and the sums of the rows."""
    top: np.ndarray | float = 0.0
    if x.size and max(float(x.max()), -float(x.min())) > SAFE:
        top = x.max(1)
        x -= top[:, None]
    np.exp(x, out=x)
    return top, x @ _ONES[: x.shape[1]]


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Natural log of the sum of exponentials of each row; ``x`` is used up."""
    top, total = _exponentials(x)
    return top + np.log(total)


def _to_errors(x: np.ndarray, rows: np.ndarray, target: np.ndarray) -> float:
    """Turn logits into probabilities less the targets, divided by the rows, in place; returns the sum of the targets' log probabilities."""
    _, total = _exponentials(x)
    flat, at = x.reshape(-1), rows * x.shape[1] + target
    logs = float(np.log(np.maximum(flat[at] / total, 1e-30)).sum())
    share = F32(1 / max(len(x), 1))
    x *= (share / total)[:, None]
    flat[at] -= share
    return logs


def _turned(x: np.ndarray) -> np.ndarray:
    """A copy with the last two axes exchanged."""
    return np.ascontiguousarray(x.swapaxes(-1, -2))


class Gru:
    """Parameters as views of one flat vector, so that models can be averaged entry by entry."""

    SHAPES = {"x": (TOKENS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "cw": (HIDDEN, CLASSES), "cb": (CLASSES,), "ow": (CLASSES, PER_CLASS, HIDDEN), "ob": (CLASSES, PER_CLASS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray) -> None:
        self.flat = np.ascontiguousarray(flat, dtype=F32)
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Gru:
        """Small random weights, and biases that give each token its share of the counts (plus one)."""
        m = cls(np.random.default_rng(seed).standard_normal(cls.SIZE) * 0.1)
        p = (np.asarray(counts, float) + 1).reshape(CLASSES, PER_CLASS)
        m.cb[:] = np.log(p.sum(1) / p.sum())
        m.ob[:] = np.log(p / p.sum(1, keepdims=True))
        return m

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """New state, and the gates that backpropagation needs; a row for each stream."""
        new, *gates = self._step(_turned(x), _turned(h))
        return new.T, *(k.T for k in gates)

    def _step(self, x: np.ndarray, h: np.ndarray, new: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same with a column for each stream; ``x`` is used up, the new state is written to ``new`` if given."""
        a = self.u.T @ h
        g, n, last = x[: 2 * HIDDEN], x[2 * HIDDEN :], a[2 * HIDDEN :]
        g += a[: 2 * HIDDEN]
        g *= F32(0.5)
        np.tanh(g, out=g)
        g *= F32(0.5)
        g += F32(0.5)
        z, r = g[:HIDDEN], g[HIDDEN:]
        n += r * last
        np.tanh(n, out=n)
        new = np.subtract(h, n, out=new)
        new *= z
        new += n
        return new, z, r, n, last

    def _inputs(self, tokens: np.ndarray) -> np.ndarray:
        """Inputs of tokens (.., stream), as (.., unit, stream)."""
        return _turned(np.take(self.x, tokens, axis=0, mode="clip"))

    def log_likelihood(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each target, given states (rows)."""
        c = h @ self.cw
        c += self.cb
        cls = target // PER_CLASS
        rows = np.arange(len(h))
        out = c[rows, cls] - _log_sum(c)
        order, _, _, o = self._within(h, cls)
        out[order] += o[rows, target[order] % PER_CLASS] - _log_sum(o)
        return out

    def _within(self, h: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]], np.ndarray, np.ndarray]:
        """Rows by class, each class among them with its rows, their states with a column of ones, and their logits within the class."""
        order = np.argsort(cls.astype(np.int16), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        mine = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
        sorted_h, o = np.ones((len(h), HIDDEN + 1), F32), np.empty((len(h), PER_CLASS), F32)
        sorted_h[:, :HIDDEN] = np.take(h, order, axis=0, mode="clip")
        weights = np.concatenate((self.ow.swapaxes(1, 2), self.ob[:, None]), axis=1)
        for k, at in mine:
            np.matmul(sorted_h[at], weights[k], out=o[at])
        return order, mine, sorted_h, o

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, real: np.ndarray | None = None) -> tuple[Gru, np.ndarray, float]:
        """Mean gradient of the negative log-likelihood over a window (time by stream), last state, mean loss.

        ``fresh`` marks places where a document begins, and so the state is zero; ``real`` is false on padding, which teaches nothing.
        """
        steps, b = inputs.shape
        g = Gru(np.zeros(self.SIZE, F32))
        before, states = np.empty((steps, HIDDEN, b), F32), np.empty((steps, HIDDEN, b), F32)
        x, on = self._inputs(inputs), (~fresh).astype(F32)
        now, kept = h.T, []
        for t in range(steps):
            np.multiply(now, on[t], out=before[t])
            now, *gates = self._step(x[t], before[t], states[t])
            kept.append(gates)
        flat, target = _turned(states).reshape(-1, HIDDEN), targets.ravel()
        if real is not None:
            rows = np.flatnonzero(real)
            flat, target = flat[rows], target[rows]
        n, cls = len(flat), target // PER_CLASS
        here = np.arange(n)
        c = flat @ self.cw
        c += self.cb
        loss = -_to_errors(c, here, cls)
        g.cw[:] = np.matmul(states, c.reshape(steps, b, CLASSES)).sum(0) if real is None else flat.T @ c
        g.cb[:] = np.ones(n, F32) @ c
        d = c @ self.cw.T
        order, mine, by_class, o = self._within(flat, cls)
        loss -= _to_errors(o, here, target[order] % PER_CLASS)
        back = np.empty((n, HIDDEN), F32)
        for k, at in mine:
            w = o[at].T @ by_class[at]
            g.ow[k], g.ob[k] = w[:, :HIDDEN], w[:, HIDDEN]
            np.matmul(o[at], self.ow[k], out=back[at])
        place = np.empty(n, np.int64)
        place[order] = here
        d += np.take(back, place, axis=0, mode="clip")
        if real is not None:
            dh = np.zeros((steps * b, HIDDEN), F32)
            dh[rows] = d
            d = dh
        dh = _turned(d.reshape(steps, b, HIDDEN))
        carry = np.zeros((HIDDEN, b), F32)
        dx, da = np.empty((steps, 3 * HIDDEN, b), F32), np.empty((steps, 3 * HIDDEN, b), F32)
        for t in range(steps - 1, -1, -1):
            z, r, new, a = kept[t]
            dz, dr, dn = dx[t, :HIDDEN], dx[t, HIDDEN : 2 * HIDDEN], dx[t, 2 * HIDDEN :]
            carry += dh[t]
            part = carry * z
            carry -= part  # the new value's share
            np.subtract(before[t], new, out=dz)
            dz *= z
            dz *= carry
            np.multiply(new, new, out=dn)
            np.subtract(F32(1), dn, out=dn)
            dn *= carry
            last = np.multiply(dn, r, out=da[t, 2 * HIDDEN :])
            np.subtract(F32(1), r, out=dr)
            dr *= last
            dr *= a
            da[t, : 2 * HIDDEN] = dx[t, : 2 * HIDDEN]
            carry = self.u @ da[t]
            carry += part
            carry *= on[t]
        g.u[:] = np.matmul(before, da.swapaxes(1, 2)).sum(0)
        token = inputs.ravel()
        order = np.argsort(token.astype(np.int16), kind="stable")
        at = np.flatnonzero(np.diff(token[order], prepend=-1))
        g.x[token[order][at]] = np.add.reduceat(np.take(_turned(dx).reshape(-1, 3 * HIDDEN), order, axis=0, mode="clip"), at, axis=0)
        return g, now.T, loss / n

    def train(self, ids: np.ndarray, end: int, streams: int = STREAMS, window: int = WINDOW, rate: float = 0.02) -> float:
        """One pass over documents laid end to end (each closed by ``end``), by Adam on windows; returns the last mean loss.

        The documents run side by side in ``streams``, fewer where that would leave less than 64 windows.
        """
        streams = int(max(1, min(streams, len(ids) // (64 * window))))
        length = -(-len(ids) // streams)
        padding = streams * length - len(ids)  # the last stream's end
        target = np.concatenate((ids, np.full(padding, end, ids.dtype))).reshape(streams, length).T
        real = np.arange(streams * length).reshape(streams, length).T < len(ids)
        source = np.vstack((np.full((1, streams), end), target[:-1]))
        m, v = np.zeros(self.SIZE, F32), np.zeros(self.SIZE, F32)
        h, loss = np.zeros((streams, HIDDEN), F32), 0.0
        for k, a in enumerate(range(0, length, window), 1):
            b = min(a + window, length)
            g, h, now = self.gradient(source[a:b], target[a:b], source[a:b] == end, h, real[a:b] if padding and b > length - padding else None)
            d = g.flat
            d *= F32(min(1.0, 1.0 / max(float(np.sqrt(np.dot(d, d))), 1e-12)))
            m *= F32(0.9)
            m += F32(0.1) * d
            d *= d
            v *= F32(0.995)
            v += F32(0.005) * d
            np.sqrt(v, out=d)
            d *= F32(1 / math.sqrt(1 - 0.995**k))
            d += F32(1e-6)
            np.divide(m, d, out=d)
            d *= F32(rate / (1 - 0.9**k))
            self.flat -= d
            loss = now
        return loss

    def score(self, ids: np.ndarray, first: np.ndarray, end: int, window: int = 16, together: int = 512) -> np.ndarray:
        """Natural log-likelihood of whole documents: ids first[d] .. first[d + 1], each closed by ``end``.

        Up to ``together`` documents of like length advance side by side; the state of each is carried from window to window to its end.
        """
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        back = np.empty(len(n))
        for at in range(0, len(n), together):
            mine = order[at : at + together]
            back[mine] = self._side_by_side(ids, first[:-1][mine], n[mine], end, window)
        return back

    def _side_by_side(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, end: int, window: int) -> np.ndarray:
        """Scores of documents that are ordered by falling length."""
        out = np.zeros(len(length))
        h = np.zeros((HIDDEN, len(length)), F32)
        previous = np.full(len(length), end)
        a = 0
        while a < length[0]:
            alive = int(np.searchsorted(-length, -a, side="left"))
            stop = min(a + window * max(1, len(length) // alive), int(length[0]))  # longer windows once few are left
            states, targets, owners = [], [], []
            for t in range(a, stop):
                alive = int(np.searchsorted(-length, -t, side="left"))  # documents with more than t tokens
                h = self._step(self._inputs(previous[:alive]), h[:, :alive])[0]
                previous = ids[begin[:alive] + t].astype(np.int64)
                states.append(h.T)
                targets.append(previous)
                owners.append(alive)
            who = np.concatenate([np.arange(k) for k in owners])
            out += np.bincount(who, self.log_likelihood(np.concatenate(states), np.concatenate(targets)), len(length))
            a = stop
        return out
