"""A gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, states carried on.

Symbols 0 to words-1 are words, in classes of `per_class` each; the symbols after them are classes that stand for
all other words, whose share within the class the caller knows. The last input, `begin`, starts a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass(frozen=True)
class Shape:
    words: int
    per_class: int
    other_classes: int
    hidden: int

    @property
    def word_classes(self) -> int:
        return -(-self.words // self.per_class)

    @property
    def classes(self) -> int:
        return self.word_classes + self.other_classes

    @property
    def symbols(self) -> int:
        return self.words + self.other_classes

    @property
    def begin(self) -> int:
        return self.symbols

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.words, symbols // self.per_class, symbols - self.words + self.word_classes)


def initial(shape: Shape, symbol_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights, with biases at the given frequencies, so that training starts from a unigram model."""
    rng = np.random.default_rng(seed)
    h, k = shape.hidden, shape.per_class
    normal = lambda *size: rng.normal(0, 0.1, size).astype(F32)
    counts = np.zeros(shape.word_classes * k)
    counts[: shape.words] = symbol_counts[: shape.words]
    counts = counts.reshape(-1, k)
    tops = np.concatenate([counts.sum(1), symbol_counts[shape.words :]]) + 0.1
    inside = np.where(np.arange(counts.size).reshape(counts.shape) < shape.words, np.log(counts + 0.1), -30.0)
    return {
        "input": normal(shape.symbols + 1, 3 * h),
        "state": normal(h, 3 * h),
        "top": normal(h, shape.classes) * F32(0.1),
        "top_bias": np.log(tops / tops.sum()).astype(F32),
        "inner": normal(shape.word_classes, h, k) * F32(0.1),
        "inner_bias": inside.astype(F32),
    }


def _forward(w: dict, inputs: np.ndarray, state: np.ndarray, begin: int, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States after each of the inputs (steps x lanes x hidden); lanes whose input is `begin` start from zero.

    Inside, lanes lie side by side: each gate is one stretch of memory. So are the values kept for the way back.
    """
    steps, lanes = inputs.shape
    h = state.shape[1]
    out = np.empty((steps, lanes, h), F32)
    fresh = inputs == begin
    any_fresh = fresh.any(1)
    # sigmoid(x) is (1 + tanh(x / 2)) / 2: the gates' weights are halved once
    half = np.concatenate([np.full(2 * h, 0.5, F32), np.ones(h, F32)])
    given, recurrent = w["input"] * half, np.ascontiguousarray((w["state"] * half).T)
    state = np.ascontiguousarray(state.T)
    for t in range(steps):
        if any_fresh[t]:
            state = np.where(fresh[t], F32(0), state)
        a, b = np.ascontiguousarray(given.take(inputs[t], 0).T), recurrent @ state
        gates, n, inner = a[: 2 * h], a[2 * h :], b[2 * h :]
        gates += b[: 2 * h]
        np.tanh(gates, out=gates)
        gates += F32(1)
        gates *= F32(0.5)
        z, r = gates[:h], gates[h:]
        n += r * inner
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((state, z, r, n, inner))
        step = n - state
        step *= z
        step += state
        state = step
        out[t] = state.T
    return out, np.ascontiguousarray(state.T)


ROWS = 2_048  # states whose classes are looked at together: their exponentials stay near the processor
SPREAD = 60.0  # exponents that far below the largest one still have a value in single precision


def _powers(states: np.ndarray, weight: np.ndarray, bias: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of states @ weight + bias below a top, the exponent at one column of each row, and each row's sum.

    No part of a state is above one, so the weights bound all exponents. If the bounds lie close, the highest is the
    top of all rows and nothing has to be searched; else each row has its own.
    """
    reach = np.abs(weight).sum(0)
    top = (bias + reach).max()
    near = top - (bias - reach).min() < SPREAD
    x = states @ weight
    x += bias - top if near else bias
    if not near:
        x -= x.max(1, initial=-np.inf)[:, None]
    at = x[np.arange(len(x)), of]
    np.exp(x, out=x)
    return x, at, x @ np.ones(x.shape[1], x.dtype)


def _log_share(states: np.ndarray, weight: np.ndarray, bias: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The log softmax at one column of each row."""
    _, at, sums = _powers(states, weight, bias, of)
    return at - np.log(sums)


def _slopes(states: np.ndarray, weight: np.ndarray, bias: np.ndarray, of: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the scaled negative log softmax at one column of each row, and the log softmax there unscaled."""
    x, at, sums = _powers(states, weight, bias, of)
    x *= (scale / sums)[:, None]
    x[np.arange(len(x)), of] -= scale
    return x, at - np.log(sums)


def _short(numbers: np.ndarray, most: int) -> np.ndarray:
    """The same numbers in two bytes where they fit: those are sorted by their digits."""
    return numbers.astype(np.uint16) if most < 1 << 16 else numbers


def _inner_runs(shape: Shape, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(_short(classes, shape.classes), kind="stable")
    return order, np.searchsorted(classes[order], np.arange(shape.word_classes + 1))


def log_likelihoods(w: dict, shape: Shape, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of each target's probability after its state (both flat)."""
    classes = shape.class_of(targets)
    out = np.empty(len(targets))
    for at in range(0, len(targets), ROWS):
        some = slice(at, at + ROWS)
        out[some] = _log_share(states[some], w["top"], w["top_bias"], classes[some])
    order, bounds = _inner_runs(shape, classes)
    for c in range(shape.word_classes):
        rows = order[bounds[c] : bounds[c + 1]]
        if len(rows):
            out[rows] += _log_share(states.take(rows, 0), w["inner"][c], w["inner_bias"][c], targets[rows] - c * shape.per_class)
    return out


def lanes_for(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt over lanes of about equal length, longest first; fewer lanes where one text is very long."""
    lanes = int(max(1, min(most, len(lengths), -(-int(lengths.sum()) // max(1, int(lengths.max(initial=1)))))))
    order, load = np.argsort(-lengths, kind="stable"), np.zeros(lanes)
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for i in order.tolist():
        lane = int(load.argmin())
        dealt[lane].append(i)
        load[lane] += lengths[i]
    return sorted((lane for lane in dealt if lane), key=lambda lane: -int(lengths[lane].sum()))


def _laid_out(shape: Shape, texts: list[np.ndarray], dealt: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and text numbers (steps x lanes), and the length of each lane."""
    sizes = np.array([sum(len(texts[i]) for i in lane) for lane in dealt])
    inputs = np.full((int(sizes.max(initial=0)), len(dealt)), shape.begin, np.int32)
    targets, which = np.zeros_like(inputs), np.full_like(inputs, -1)
    for j, lane in enumerate(dealt):
        at = 0
        for i in lane:
            n = len(texts[i])
            targets[at : at + n, j] = texts[i]
            inputs[at + 1 : at + n, j] = texts[i][:-1]
            which[at : at + n, j] = i
            at += n
    return inputs, targets, which, sizes


def score(w: dict, shape: Shape, texts: list[np.ndarray], lanes: int = 512, window: int = 128) -> np.ndarray:
    """Natural log-likelihood of each text, the state carried through all its windows. No text is empty."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    dealt = lanes_for(np.array([len(t) for t in texts]), lanes)
    inputs, targets, which, sizes = _laid_out(shape, texts, dealt)
    state = np.zeros((len(dealt), shape.hidden), F32)
    for start in range(0, len(inputs), window):
        active = int((sizes > start).sum())  # lanes are sorted by length
        stop = min(start + window, len(inputs))
        states, state = _forward(w, inputs[start:stop, :active], state[:active], shape.begin)
        real = which[start:stop, :active] >= 0
        logs = log_likelihoods(w, shape, states[real], targets[start:stop, :active][real])
        out += np.bincount(which[start:stop, :active][real], weights=logs, minlength=len(out))
    return out


def gradients(w: dict, shape: Shape, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss over one window, the state after it (through which nothing flows back), and the loss."""
    kept: list = []
    states, after = _forward(w, inputs, state, shape.begin, kept)
    steps, lanes, h = states.shape
    flat, wanted, here = states.reshape(-1, h), targets.reshape(-1), real.reshape(-1)
    total = max(1, int(here.sum()))
    classes = shape.class_of(wanted)
    scale = (here / F32(total)).astype(F32)
    g = {k: np.zeros_like(w[k]) for k in ("top", "top_bias", "inner", "inner_bias")}
    d_flat, ones, loss = np.empty_like(flat), np.ones(max(ROWS, len(flat)), F32), 0.0
    for at in range(0, len(flat), ROWS):
        some = slice(at, at + ROWS)
        d, logs = _slopes(flat[some], w["top"], w["top_bias"], classes[some], scale[some])
        loss -= float(logs[here[some]].sum())
        g["top"] += flat[some].T @ d
        g["top_bias"] += ones[: len(d)] @ d
        np.matmul(d, w["top"].T, out=d_flat[some])
    order, bounds = _inner_runs(shape, np.where(here, classes, shape.classes))
    for c in range(shape.word_classes):
        rows = order[bounds[c] : bounds[c + 1]]
        if len(rows):
            some = flat.take(rows, 0)
            e, logs = _slopes(some, w["inner"][c], w["inner_bias"][c], wanted[rows] - c * shape.per_class, scale[rows])
            loss -= float(logs.sum())
            g["inner"][c], g["inner_bias"][c] = some.T @ e, ones[: len(e)] @ e
            d_flat[rows] += e @ w["inner"][c].T
    d_states = d_flat.reshape(steps, lanes, h)
    d_inputs, g_state = np.empty((steps, lanes, 3 * h), F32), np.zeros_like(w["state"])
    back = np.zeros((h, lanes), F32)
    begins = inputs == shape.begin
    any_begin = begins.any(1)
    da, db = np.empty((3 * h, lanes), F32), np.empty((3 * h, lanes), F32)
    one = F32(1)
    for t in range(steps - 1, -1, -1):
        before, z, r, n, inner = kept[t]
        ds = back
        ds += d_states[t].T
        rest = one - z
        dz, dr, dn = da[:h], da[h : 2 * h], da[2 * h :]
        np.multiply(n, n, out=dn)
        np.subtract(one, dn, out=dn)
        dn *= z
        dn *= ds
        ds *= rest  # what flows back past the gates
        np.subtract(n, before, out=dz)
        dz *= z
        dz *= ds
        np.subtract(one, r, out=dr)
        dr *= r
        dr *= inner
        dr *= dn
        d_inputs[t] = da.T
        db[: 2 * h] = da[: 2 * h]
        np.multiply(dn, r, out=db[2 * h :])
        g_state += before @ db.T
        back = w["state"] @ db
        back += ds
        if any_begin[t]:
            back[:, begins[t]] = 0
    g["state"] = g_state
    g["input"] = np.zeros_like(w["input"])
    flat_inputs, flat_d = inputs.reshape(-1), d_inputs.reshape(-1, 3 * h)
    by_input = np.argsort(_short(flat_inputs, shape.begin), kind="stable")
    sorted_inputs = flat_inputs[by_input]
    first = np.flatnonzero(np.concatenate([[True], sorted_inputs[1:] != sorted_inputs[:-1]]))
    g["input"][sorted_inputs[first]] = np.add.reduceat(flat_d.take(by_input, 0), first, axis=0)
    return g, after, loss / total


class Adam:
    def __init__(self, w: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}
        self.held = {k: np.empty_like(v) for k, v in w.items()}

    def step(self, w: dict, g: dict) -> None:
        self.t += 1
        rate = F32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k in w:
            m, v, d = self.m[k], self.v[k], self.held[k]
            np.subtract(g[k], m, out=d)
            d *= F32(0.1)
            m += d
            np.multiply(g[k], g[k], out=d)
            d -= v
            d *= F32(0.01)
            v += d
            np.sqrt(v, out=d)
            d += F32(1e-6)
            np.divide(m, d, out=d)
            d *= rate
            w[k] -= d


def train(w: dict, shape: Shape, texts: list[np.ndarray], optimiser: Adam, lanes: int = 512, window: int = 32) -> float:
    """One pass of truncated backpropagation over the texts, changing w; the mean loss."""
    dealt = lanes_for(np.array([len(t) for t in texts]), lanes)
    inputs, targets, which, sizes = _laid_out(shape, texts, dealt)
    state, losses = np.zeros((len(dealt), shape.hidden), F32), []
    for start in range(0, len(inputs), window):
        active, part = int((sizes > start).sum()), slice(start, start + window)
        g, state, loss = gradients(w, shape, inputs[part, :active], targets[part, :active], which[part, :active] >= 0, state[:active])
        optimiser.step(w, g)
        losses.append(loss)
    return float(np.mean(losses)) if losses else 0.0
