"""A gated recurrent network over word ids in numpy, with a class-factored softmax and truncated backpropagation through time.

Ids are in order of frequency; id // members is a word's class, so a word's chance is that of its class times that within the class.
Documents lie end to end in lanes that step together. A lane's state starts anew with each document and is carried from window to window,
so a document's likelihood is whole however long it is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

HIDDEN = 24
# Rows, and classes, that are worked on together: their numbers then stay in a core's cache.
ROWS, TOGETHER = 1024, 8
NAMES = ("inputs", "recurrent", "class_w", "class_b", "member_w", "member_b")


def shapes(classes: int, members: int) -> list[tuple[int, ...]]:
    h = HIDDEN
    return [(classes * members, 3 * h), (h, 3 * h), (classes, h), (classes,), (classes, members, h), (classes, members)]


def initial(counts: np.ndarray, classes: int, members: int) -> list[np.ndarray]:
    """Small random weights; the biases give each id its share of ``counts``."""
    random = np.random.default_rng(11)
    out = [random.normal(0, 0.1, s).astype(np.float32) for s in shapes(classes, members)]
    share = np.full(classes * members, 1e-9)
    share[: len(counts)] += counts
    share = share.reshape(classes, members)
    out[3] = np.log(share.sum(axis=1)).astype(np.float32)
    out[5] = np.log(share).astype(np.float32)
    out[2] *= 0
    out[4] *= 0
    return out


def packed(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def unpacked(flat: np.ndarray, classes: int, members: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(classes, members):
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s).astype(np.float32))
        at += n
    return out


class Lanes:
    """Documents (flat ids, where each begins) laid into lanes, longest first, in windows of ``steps``."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, start: int, lanes: int, steps: int):
        size = np.diff(first)
        self.ids, self.steps = ids, steps
        self.before = np.roll(ids, 1)
        self.opens = np.zeros(len(ids), bool)
        self.opens[first[:-1][size > 0]] = True
        self.before[self.opens] = start
        heap = [(0, i) for i in range(min(lanes, max(1, len(size))))]
        rows: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-size, kind="stable").tolist():
            n, lane = heapq.heappop(heap)
            rows[lane].append(d)
            heapq.heappush(heap, (n + int(size[d]), lane))
        # Positions of each lane's tokens, in order; lanes longest first.
        self.order = [np.concatenate([np.arange(first[d], first[d + 1]) for d in r]) if r else np.zeros(0, np.int64) for r in rows]
        self.order.sort(key=len, reverse=True)
        self.length = np.array([len(o) for o in self.order])
        self.flat = np.concatenate(self.order)
        self.start = self.length.cumsum() - self.length

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(steps, lanes) positions and which of them are real; lanes that have ended are left out."""
        for t in range(0, int(self.length[0]) if len(self.length) else 0, self.steps):
            n = int(np.searchsorted(-self.length, -t, side="left"))
            step = t + np.arange(min(self.steps, int(self.length[0]) - t))[:, None]
            real = step < self.length[None, :n]
            yield self.flat[self.start[None, :n] + np.minimum(step, self.length[None, :n] - 1)], real


def _forward(weights: list[np.ndarray], before: np.ndarray, opens: np.ndarray, state: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
    """States after each step (steps, lanes, hidden), and what backpropagation needs: states before, gates z, r and n, and n's recurrent input."""
    (steps, lanes), h, one = before.shape, HIDDEN, np.float32(1)
    # Gate by gate, so that each step works on whole blocks. Only backpropagation needs the gates of all steps.
    inputs, gate = weights[0].reshape(-1, h), np.arange(3)[:, None, None]
    x = np.empty((3, steps if keep else 1, lanes, h), np.float32)
    own = weights[1].reshape(h, 3, h).transpose(1, 0, 2).copy()
    np.negative(own[:2], out=own[:2])  # z and r are 1 / (1 + exp(-sum)): 0 where that overflows
    out = np.empty((steps, lanes, h), np.float32)
    past, late = (np.empty_like(out), np.empty_like(out)) if keep else (None, None)
    u, gated, fresh = np.empty((3, lanes, h), np.float32), np.empty((lanes, h), np.float32), opens.any(axis=1).tolist()
    for t in range(steps):
        if fresh[t]:
            state = state * ~opens[t][:, None]
        np.matmul(state, own, out=u)
        if t % len(x[0]) == 0:
            inputs.take(before[t : t + len(x[0])] * 3 + gate, axis=0, out=x[:, : len(before) - t], mode="clip")
        zr, n, new = x[:2, t % len(x[0])], x[2, t % len(x[0])], out[t]
        np.subtract(u[:2], zr, out=zr)
        with np.errstate(over="ignore"):
            np.exp(zr, out=zr)
        zr += one
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], u[2], out=gated)
        n += gated
        np.tanh(n, out=n)
        if keep:
            past[t], late[t] = state, u[2]
        np.subtract(state, n, out=new)
        new *= zr[0]
        new += n
        state = new
    return out, (past, *x, late)


def _weighed(logit: np.ndarray) -> np.ndarray:
    """Turns logits into their exponentials; returns each row's sum."""
    np.clip(logit, -80, 80, out=logit)  # within what single precision can hold, and much cheaper than each row's maximum
    np.exp(logit, out=logit)
    return logit @ np.ones((logit.shape[-1], 1), logit.dtype)


def _joined(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with the bias as one more column."""
    return np.concatenate([w, b[..., None]], axis=-1)


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """The order of ids below ``most``; short ones are sorted by their bytes."""
    return np.argsort(ids.astype(np.int16) if most <= 1 << 15 else ids, kind="stable")


def _by_class(states: np.ndarray, kind: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of classes, the states in that order with a column of ones, and where each class begins (one more entry than classes)."""
    order = _order(kind, classes)
    rows = np.ones((len(order), HIDDEN + 1), np.float32)
    rows[:, :HIDDEN] = states[order]
    return order, rows, np.searchsorted(kind[order], np.arange(classes + 1)).tolist()


def log10_chances(weights: list[np.ndarray], ids: np.ndarray, first: np.ndarray, start: int, lanes: int = 256, steps: int = 32) -> np.ndarray:
    """log10 chance of each token given those before it in its document."""
    class_w, member_w = _joined(*weights[2:4]), _joined(*weights[4:6])
    members = member_w.shape[1]
    out = np.zeros(len(ids))
    laid = Lanes(ids, first, start, lanes, steps)
    state = np.zeros((len(laid.order), HIDDEN), np.float32)
    for at, real in laid.windows():
        n = at.shape[1]
        h, _ = _forward(weights, laid.before[at], laid.opens[at], state[:n], False)
        state = h[-1]
        at = at[real]
        kind, member = np.divmod(laid.ids[at], members)
        order, rows, bounds = _by_class(h[real], kind, len(class_w))
        at, kind, member = at[order], kind[order], member[order]
        for low in range(0, len(at), ROWS):
            some = slice(low, min(low + ROWS, len(at)))
            logit = np.empty((some.stop - low, members), np.float32)
            for c in range(kind[low], kind[some.stop - 1] + 1):
                own = slice(max(bounds[c], low), min(bounds[c + 1], some.stop))
                if own.start < own.stop:
                    np.dot(rows[own], member_w[c].T, out=logit[own.start - low : own.stop - low])
            p = np.ones(len(logit))
            for each, pick in ((rows[some] @ class_w.T, kind[some]), (logit, member[some])):
                total = _weighed(each)[:, 0]
                p *= each[np.arange(len(p)), pick] / total
            out[at[some]] = np.log10(np.maximum(p, 1e-30))
    return out


def learn(weights: list[np.ndarray], ids: np.ndarray, first: np.ndarray, start: int, memory: list[np.ndarray], rate: float = 0.05, lanes: int = 64, steps: int = 16) -> None:
    """One pass of truncated backpropagation with steps scaled by each weight's past gradients (``memory``); changes the weights."""
    inputs, recurrent = weights[:2]
    classes, members, hidden = *weights[5].shape, HIDDEN
    class_w, member_w = _joined(*weights[2:4]), _joined(*weights[4:6])
    class_memory, member_memory = _joined(*memory[2:4]), _joined(*memory[4:6])
    member_grad = np.empty_like(member_w)
    laid = Lanes(ids, first, start, lanes, steps)
    state = np.zeros((len(laid.order), hidden), np.float32)

    def step(w: np.ndarray, past: np.ndarray, grad: np.ndarray) -> None:
        size = grad * grad
        past += size
        np.add(past, np.float32(1e-6), out=size)
        np.sqrt(size, out=size)
        np.divide(grad, size, out=size)
        size *= np.float32(rate)
        w -= size

    def less_one(logit: np.ndarray, right: np.ndarray, scale: np.float32) -> np.ndarray:
        """The loss's gradient by the logits: chances, less one for what came."""
        logit *= scale / _weighed(logit)
        logit[np.arange(len(logit)), right] -= scale
        return logit

    for at, real in laid.windows():
        n = at.shape[1]
        before, opens = laid.before[at], laid.opens[at]
        h, (past, z, r, new, late) = _forward(weights, before, opens, state[:n], True)
        state = h[-1].copy()
        scale = np.float32(1 / max(1, real.sum()))
        kind, member = np.divmod(laid.ids[at[real]], members)
        order, rows, bounds = _by_class(h[real], kind, classes)
        parts = [(c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        d = less_one(rows @ class_w.T, kind[order], scale)
        back, class_grad = d @ class_w, d.T @ rows
        d = np.empty((len(rows), members), np.float32)
        for c, own in parts:
            np.dot(rows[own], member_w[c].T, out=d[own])
        less_one(d, member[order], scale)
        more = np.empty_like(back)
        if len(parts) < classes:
            member_grad[:] = 0
        for c, own in parts:
            mine = d[own]
            np.dot(mine, member_w[c], out=more[own])
            np.dot(mine.T, rows[own], out=member_grad[c])
        back += more
        for c in range(0, classes, TOGETHER):
            step(member_w[c : c + TOGETHER], member_memory[c : c + TOGETHER], member_grad[c : c + TOGETHER])
        step(class_w, class_memory, class_grad)
        outer = np.zeros_like(h)
        sorted_back = np.empty((len(rows), hidden), np.float32)
        sorted_back[order] = back[:, :hidden]
        outer[real] = sorted_back
        # What a state's gradient is multiplied by to give those of the sums inside z, r and n: known for all steps at once.
        inner = (1 - z) * (1 - new * new)
        factor = np.empty((*before.shape, 3, hidden), np.float32)
        factor[:, :, 0] = (past - new) * z * (1 - z)
        factor[:, :, 1] = inner * late * r * (1 - r)
        factor[:, :, 2] = inner * r
        grads, du = np.empty_like(h), np.empty_like(factor)
        back_w, dh, more = recurrent.T.copy(), np.zeros((n, hidden), np.float32), np.empty((n, hidden), np.float32)
        fresh = opens.any(axis=1).tolist()
        for t in range(len(before) - 1, -1, -1):
            g = grads[t]
            np.add(dh, outer[t], out=g)
            np.multiply(g[:, None], factor[t], out=du[t])
            np.dot(du[t].reshape(n, 3 * hidden), back_w, out=more)
            np.multiply(g, z[t], out=dh)
            dh += more
            if fresh[t]:
                dh *= ~opens[t][:, None]
        step(recurrent, memory[1], np.clip(past.reshape(-1, hidden).T @ du.reshape(-1, 3 * hidden), -1, 1))
        du[:, :, 2] = grads * inner
        words, pre = before[real], du.reshape(*before.shape, 3 * hidden)[real]
        order = _order(words, len(inputs))
        words = words[order]
        at_word = np.flatnonzero(np.diff(words, prepend=-1))
        unique = words[at_word]
        some, some_memory = inputs[unique], memory[0][unique]
        step(some, some_memory, np.clip(np.add.reduceat(pre[order], at_word, axis=0), -1, 1))
        inputs[unique], memory[0][unique] = some, some_memory
    for k, (w, m) in enumerate(((class_w, class_memory), (member_w, member_memory))):
        for kept, joined in ((weights, w), (memory, m)):
            kept[2 + 2 * k][:], kept[3 + 2 * k][:] = joined[..., :-1], joined[..., -1]
