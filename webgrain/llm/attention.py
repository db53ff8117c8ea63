"""A causal self-attention model in numpy: one layer, one head, a class-factored output.

Every id has an input of its own or, beyond the most frequent ones, one of SHARED that it shares by hash. The output is the
id's class, predicted by attention over the window, times the id's share of its class after the id before it; the most
frequent ids are classes of their own. Class logits start from the training counts of classes after the id before, shares
are smoothed training counts of pairs; the rest is learned. Every probability is positive, and those of all ids sum to 1.
"""

from __future__ import annotations

import numpy as np

WIDTH = 16
#: Positions of a window, and of those at its start that only give context (but in a text's first window).
WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
#: Ids that pairs are counted of, less two: all other ids, and the start of a text; and inputs that the other ids share.
INPUTS, SHARED = 1024, 512
CLASSES, OWN_CLASSES = 96, 72
#: Positions whose class logits are made at a time, so that they stay in a core's cache.
CACHED = 1024
NAMES = ("E", "P", "Q", "K", "V", "O", "C", "b")


#: Pseudo-counts that a class's plain shares, and the classes' plain frequencies, count for after each id.
BACKOFF_SHARE, BACKOFF_CLASS = 2.0, 5.0


class Vocabulary:
    """Ranks, classes and log10 shares of ids from training counts: of ids (array by id), and of pairs of ranks (flat
    array of INPUTS * INPUTS, the rank before times INPUTS plus the rank)."""

    def __init__(self, counts: np.ndarray, pairs: np.ndarray | None = None):
        n, self.total = len(counts), int(counts.sum())
        self.rank = ranks(counts)
        #: Input of each id, and of the start of a text at the end; and the rank of each input.
        self.row = np.where(self.rank == INPUTS - 2, INPUTS + np.arange(n + 1) * 40503 % 65521 % SHARED, self.rank).astype(np.int32)
        self.rank_of = np.append(np.arange(INPUTS), np.full(SHARED, INPUTS - 2)).astype(np.int32)
        order = np.lexsort((np.arange(n), -counts))
        smooth = counts.astype(np.float64) + 0.5
        self.klass = np.empty(n, np.int32)
        self.klass[order[:OWN_CLASSES]] = np.arange(min(n, OWN_CLASSES))
        rest = order[OWN_CLASSES:]
        mass = np.cumsum(smooth[rest])
        if len(rest):  # the others by frequency, in classes of like mass
            self.klass[rest] = OWN_CLASSES + np.minimum(
                (mass - smooth[rest] / 2) / mass[-1] * (CLASSES - OWN_CLASSES), CLASSES - OWN_CLASSES - 1
            ).astype(np.int32)
        total = np.maximum(np.bincount(self.klass, smooth, CLASSES), 1e-9)
        share = smooth / total[self.klass]
        # share of each rank in its class; rare ids of one class are one unit, whose ids have fixed shares of it
        table = np.zeros((INPUTS, INPUTS)) if pairs is None else pairs.reshape(INPUTS, INPUTS).astype(np.float64)
        named = order[: INPUTS - 2]
        after = np.zeros((INPUTS, CLASSES))
        np.add.at(after.T, self.klass[named], table[:, : len(named)].T)
        within = (table[:, : len(named)] + BACKOFF_SHARE * share[named]) / (after[:, self.klass[named]] + BACKOFF_SHARE)
        left = np.maximum(
            1 - np.add.reduceat(within, np.flatnonzero(np.diff(self.klass[named], prepend=-1)), axis=1), 0
        ) if len(named) else np.ones((INPUTS, 1))
        self.within = np.full((INPUTS, INPUTS), 0.0, np.float32)
        self.within[:, : len(named)] = np.log10(within)
        # what rare ids (all in the last class that named ids reach, or later) leave of each class
        rare = order[INPUTS - 2 :]
        self.rare_share = np.zeros(n)
        if len(rare):
            rare_total = np.bincount(self.klass[rare], smooth[rare], CLASSES)
            self.rare_share[rare] = np.log10(smooth[rare] / rare_total[self.klass[rare]])
        room = np.ones((INPUTS, CLASSES))
        if len(named):
            room[:, np.unique(self.klass[named])] = left
        self.room = np.log10(np.maximum(room, 1e-12)).astype(np.float32)
        plain = total / total.sum()
        after[:, self.klass[rare[0]] if len(rare) else CLASSES - 1] += table[:, INPUTS - 2]
        self.bias = np.log(
            (after + BACKOFF_CLASS * plain) / (after.sum(axis=1, keepdims=True) + BACKOFF_CLASS)
        ).astype(np.float32)[self.rank_of]

    def inputs(self, ids: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Input at each place of texts laid end to end: that of the id before it, or of a text's start."""
        before = np.concatenate((self.row[-1:], self.row[ids[:-1]]))
        before[start[sizes > 0]] = self.row[-1]
        return before

    def inside(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 share of each id of its class after an id of that rank."""
        r = self.rank[ids]
        out = self.within[before, r].astype(np.float64)
        rare = np.nonzero(r >= INPUTS - 2)
        before = np.broadcast_to(before, out.shape)[rare]
        out[rare] = self.room[before, self.klass[ids[rare]]] + self.rare_share[ids[rare]]
        return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each id; the last entry is the start of a text."""
    n = len(counts)
    order = np.lexsort((np.arange(n), -counts))
    out = np.full(n + 1, INPUTS - 2, np.int32)
    out[order[: INPUTS - 2]] = np.arange(min(n, INPUTS - 2))
    out[n] = INPUTS - 1
    return out


def fresh(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {
        "E": (INPUTS + SHARED, WIDTH),
        "P": (WINDOW, WIDTH),
        "Q": (WIDTH, WIDTH),
        "K": (WIDTH, WIDTH),
        "V": (WIDTH, WIDTH),
        "O": (WIDTH, WIDTH),
        "C": (WIDTH, CLASSES)
    }
    out = {n: (rng.standard_normal(s) * (0.3 if n == "E" else 0.1 if n == "P" else 0.25)).astype(np.float32) for n, s in shapes.items()}
    out["C"] *= 0.1
    return out | {"b": np.zeros(CLASSES, np.float32)}


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[n].ravel() for n in NAMES])


def views(x: np.ndarray) -> dict[str, np.ndarray]:
    """Weights by name, as parts of one vector."""
    out, at = {}, 0
    for n, s in zip(NAMES, ((INPUTS + SHARED, WIDTH), (WINDOW, WIDTH), *[(WIDTH, WIDTH)] * 4, (WIDTH, CLASSES), (CLASSES,)), strict=True):
        size = int(np.prod(s))
        out[n] = x[at : at + size].reshape(s)
        at += size
    return out


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    return views(x.astype(np.float32))


#: Places of each input's values in a flat E.
_CELLS = np.arange((INPUTS + SHARED) * WIDTH).reshape(-1, WIDTH)
_PAST = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, as a product with ones."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def exps(z: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, of what the mask leaves, and their sums over the last axis: shares but for a factor of each row. Values
    are rarely so large that exponentials overflow, so each row's maximum is looked for only if a sum isn't finite (or
    nothing of it is left)."""
    with np.errstate(over="ignore", invalid="ignore"):
        e = np.exp(z)
        if mask is not None:
            e *= mask
        total = _row_sums(e)
    if not (np.isfinite(total).all() and total.min(initial=1.0) > 1e-30):
        z = z if mask is None else np.where(mask > 0, z, -np.inf)
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        total = _row_sums(e)
    return e, total


def _attend(p: dict[str, np.ndarray], inputs: np.ndarray, skip: int = 0):
    """Embeddings, queries, exponentials of the attention scores and their sums, and attended embeddings; inputs: windows x
    WINDOW. All but the first are of the positions from skip on alone.

    Q and K only occur as Q K', V and O as V O, so embeddings stand for keys and values, and each pair is one product of
    small matrices. The sums divide what is attended, not each weight."""
    x = p["E"].take(inputs, axis=0)
    x += p["P"]
    asking = np.ascontiguousarray(x[:, skip:])
    q = (asking.reshape(-1, WIDTH) @ _asks(p)).reshape(asking.shape)
    e, total = exps(q @ x.transpose(0, 2, 1), _PAST[skip:])
    o = (e @ x).reshape(-1, WIDTH)
    o /= total.reshape(-1, 1)
    return x, q, e, total, o


def _asks(p: dict[str, np.ndarray]) -> np.ndarray:
    """What embeddings are multiplied with to meet other embeddings."""
    return p["Q"] @ p["K"].T * p["Q"].dtype.type(WIDTH**-0.5)


def hidden(p: dict[str, np.ndarray], inputs: np.ndarray, skip: int = 0) -> np.ndarray:
    """What the class logits are made of: a row for each position from skip on of each window."""
    x, _, _, _, o = _attend(p, inputs, skip)
    h = o @ (p["V"] @ p["O"])
    h += x[:, skip:].reshape(-1, WIDTH)
    return h


def logits(p: dict[str, np.ndarray], h: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """bias: that of each row's input with the learned one."""
    return logits_of(p["C"], h, bias)


def logits_of(heads: np.ndarray, h: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = h @ heads
    z += bias
    return z


def picked_log10(z: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """log10 probability of each row's class."""
    own = z.reshape(-1)[np.arange(len(z)) * z.shape[1] + klass]
    with np.errstate(over="ignore"):
        out = own - np.log(_row_sums(np.exp(z)))
    if not np.isfinite(out).all():
        z = z - z.max(axis=1, keepdims=True)
        out = z[np.arange(len(z)), klass] - np.log(_row_sums(np.exp(z)))
    return out * np.float32(np.log10(np.e))


def class_log10(p: dict[str, np.ndarray], inputs: np.ndarray, klass: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log10 probability of each position's class."""
    return picked_log10(logits(p, hidden(p, inputs), (bias + p["b"])[inputs.ravel()]), klass.ravel()).reshape(klass.shape)


def text_log10(
    p: dict[str, np.ndarray], v: Vocabulary, ids: np.ndarray, start: np.ndarray, sizes: np.ndarray, batch: int = 128
) -> np.ndarray:
    """log10 probability of each of the texts laid end to end in ids; every id is scored in one window."""
    before = v.inputs(ids, start, sizes)
    klass, inside = v.klass[ids], v.inside(v.rank_of[before], ids)
    text, at, _ = windows(sizes)
    logs, bias = np.zeros(len(ids)), v.bias + p["b"]
    steps, left = np.arange(WINDOW), sizes[text] - at
    # first windows are scored whole, later ones after their context; those that their text fills go by themselves
    for skip, full in ((0, True), (0, False), (CONTEXT, True), (CONTEXT, False)):
        mine = np.flatnonzero(((at > 0) == (skip > 0)) & ((left >= WINDOW) == full))
        for i in range(0, len(mine), batch):
            t, a = text[mine[i : i + batch]], at[mine[i : i + batch]]
            where = np.minimum((start[t] + a)[:, None] + steps, len(ids) - 1)  # what lies beyond a text is in nobody's past
            inputs = before[where]
            h, one, row = hidden(p, inputs, skip), where[:, skip:].ravel(), inputs[:, skip:].ravel()
            if not full:
                use = (steps[skip:] < left[mine[i : i + batch], None]).ravel()
                h, one, row = h[use], one[use], row[use]
            for j in range(0, len(h), CACHED):
                part = slice(j, j + CACHED)
                logs[one[part]] = picked_log10(logits(p, h[part], bias.take(row[part], axis=0)), klass[one[part]])
    logs += inside
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, klass: np.ndarray, real: np.ndarray, bias: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over the real positions."""
    x, q, a, total, o = _attend(p, inputs)
    asks, brings = _asks(p), p["V"] @ p["O"]
    xs, rows, klass = x.reshape(-1, WIDTH), inputs.ravel(), klass.ravel()
    h = np.ones((len(xs), WIDTH + 1), x.dtype)  # the ones meet the learned bias
    np.add(xs, o @ brings, out=h[:, :WIDTH])
    heads, dh = np.concatenate((p["C"], p["b"][None])), np.empty_like(xs)
    dheads, db = np.zeros((CLASSES, WIDTH), x.dtype), np.zeros_like(p["b"])
    share = real.ravel() * x.dtype.type(1 / max(1, np.count_nonzero(real)))
    for i in range(0, len(xs), CACHED):
        part = slice(i, i + CACHED)
        e, sums = exps(logits_of(heads, h[part], bias.take(rows[part], axis=0)))
        e.reshape(-1)[np.arange(len(e)) * CLASSES + klass[part]] -= sums  # each logit's gradient, but for a factor of its row
        weight = share[part] / sums
        np.multiply(e @ p["C"].T, weight[:, None], out=dh[part])
        dheads += e.T @ (h[part, :WIDTH] * weight[:, None])
        db += weight @ e
    # a is exponentials: what comes back to them is divided by their sums beforehand
    do = dh @ brings.T
    each = (np.vecdot(do, o).reshape(total.shape) / total)[..., None]
    do = do.reshape(x.shape) / total[..., None]
    ds = do @ x.transpose(0, 2, 1)
    ds -= each
    ds *= a
    dq = (ds @ x).reshape(-1, WIDTH)
    dx = dq @ asks.T
    dx += dh
    dx += (ds.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
    dx += (a.transpose(0, 2, 1) @ do).reshape(-1, WIDTH)
    de = np.bincount(_CELLS.take(rows, axis=0).ravel(), dx.ravel(), p["E"].size).astype(x.dtype).reshape(p["E"].shape)
    dasks, dbrings = xs.T @ dq * x.dtype.type(WIDTH**-0.5), o.T @ dh
    out = {"E": de, "P": dx.reshape(x.shape).sum(axis=0), "C": dheads.T, "b": db}
    return out | {"Q": dasks @ p["K"], "K": dasks.T @ p["Q"], "V": dbrings @ p["O"].T, "O": p["V"].T @ dbrings}


def train(p: dict[str, np.ndarray], batches, rate: float, bias: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """One pass of Adam over batches (inputs, classes, real positions); parameters and positions learned from."""
    x = flat(p)
    now, seen = views(x), 0
    # sums of past gradients and of their squares: ten and a hundred times the means
    m, s = np.zeros_like(x), np.zeros_like(x)
    for t, (inputs, klass, real) in enumerate(batches, 1):
        step = flat(gradients(now, inputs, klass, real, bias))
        m *= 0.9  # all in place: one vector of all weights
        m += step
        s *= 0.99
        step *= step
        s += step
        np.sqrt(s, out=step)
        step += 1e-7
        np.divide(m, step, out=step)
        step *= rate * (1 - 0.99**t) ** 0.5 / (1 - 0.9**t)
        x -= step
        seen += int(np.count_nonzero(real))
    return now, seen


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of those sizes, laid end to end: each window's text, first position (in the text) and first scored one."""
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), n)
    w = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, w * STRIDE, np.where(w == 0, 0, w * STRIDE + CONTEXT)


def training_windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and first position of windows that lie side by side, so that each id is learned from once."""
    n = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW


def cut(ids: np.ndarray, start: np.ndarray, size: np.ndarray, text: np.ndarray, at: np.ndarray, v: Vocabulary):
    """Inputs, ids to predict and real positions of windows of texts laid end to end in ids."""
    place = at[:, None] + np.arange(WINDOW)
    real = place < size[text][:, None]
    where = start[text][:, None] + np.where(real, place, 0)
    target = ids[where]
    before = np.where(place == 0, len(v.klass), ids[np.maximum(where - 1, 0)])
    return v.row[np.where(real, before, len(v.klass))], target, real
