"""A small causal self-attention model over subword ids, in numpy.

A position's input is the id before it. One attention head looks back over a context window (learned bias by distance), its
mix of values is added to the id's own vector, and after a rectifier two softmax steps give the next id: its class, then its
member of the class (ids by falling frequency, in classes of equal size), so that the probabilities of all ids sum to one.

A text is scored in windows of `context + fresh` inputs that overlap by `context`; each window scores its `fresh` positions,
so every id is scored once and sees at least `context` ids before it, as far as there are any. Windows of many texts go
through one batched masked attention.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KEY, VALUE, CLASS = 8, 32, 32
CONTEXT, FRESH = 8, 16
WINDOW = CONTEXT + FRESH
TOGETHER = 8
_LATER = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)[CONTEXT:]
_DISTANCE = np.clip(np.arange(WINDOW)[CONTEXT:, None] - np.arange(WINDOW)[None], 0, WINDOW - 1)


@dataclass
class Model:
    """`place`: of each id in the order of falling frequency. Parameters by name."""

    place: np.ndarray
    p: dict[str, np.ndarray]

    @property
    def pad(self) -> int:
        return len(self.place)


def start(frequency: np.ndarray, seed: int = 7) -> Model:
    n = len(frequency)
    place = np.empty(n, np.int64)
    place[np.argsort(-frequency, kind="stable")] = np.arange(n)
    classes, rng = -(-n // CLASS), np.random.default_rng(seed)
    small = lambda *shape, scale=0.1: (rng.standard_normal(shape) * scale).astype(np.float32)
    share = np.zeros(classes * CLASS)
    share[place] = frequency + 0.5
    share = share.reshape(classes, CLASS)
    member = np.where(share > 0, np.log(np.maximum(share, 1e-9)), -30).astype(np.float32)  # places without an id have no part
    return Model(place, {
        "q": small(n + 1, KEY, scale=0.3), "k": small(n + 1, KEY, scale=0.3), "v": small(n + 1, VALUE), "r": small(n + 1, VALUE, scale=0.5),
        "near": np.zeros(WINDOW, np.float32), "rb": np.zeros(VALUE, np.float32),
        "cw": small(VALUE, classes), "cb": np.log(share.sum(axis=1)).astype(np.float32),
        "mw": small(classes, VALUE, CLASS), "mb": member,
    })


class Windows:
    """The windows of texts ids[starts[k]:starts[k+1]] (each begins with the id that stands before a text). Texts are laid out
    with pads between them, so that a window is a run of the layout."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, pad: int):
        length = np.diff(starts)
        counts = -(-(length - 1) // FRESH)
        self.before = np.concatenate([[0], np.cumsum(counts)])  # windows before each text, and in all
        begins = self.before[:-1] * FRESH + np.arange(len(counts)) * (CONTEXT + 1)
        laid = np.full(int(self.before[-1]) * FRESH + len(counts) * (CONTEXT + 1) + WINDOW, pad, np.int64)
        laid[np.arange(starts[0], starts[-1]) + np.repeat(begins + CONTEXT - starts[:-1], length)] = ids[starts[0] : starts[-1]]
        self.pad, self.text = pad, np.repeat(np.arange(len(counts)), counts)
        self.first = begins[self.text] + (np.arange(len(self)) - self.before[self.text]) * FRESH
        self.runs = np.lib.stride_tricks.sliding_window_view(laid, WINDOW + 1)

    def __len__(self) -> int:
        return int(self.before[-1])

    def at(self, chosen: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """Inputs (windows x WINDOW) and targets (windows x FRESH, -1 where there is none)."""
        row = self.runs[self.first[chosen]]
        targets = row[:, CONTEXT + 1 :]
        return row[:, :-1], np.where(targets == self.pad, -1, targets)


def windows(ids: np.ndarray, starts: np.ndarray, pad: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and texts of the chosen windows."""
    found = Windows(ids, starts, pad)
    return *found.at(chosen), found.text[chosen]


def _safe(sums: np.ndarray) -> bool:
    """Whether sums of unshifted exponentials lie far from overflow and underflow."""
    return not sums.size or bool(sums.min() > 1e-30 and sums.max() < 1e30)


def _beside(rows: np.ndarray, value: float) -> np.ndarray:
    """Rows with one more column of a value."""
    return np.concatenate([rows, np.full((len(rows), 1), value, np.float32)], axis=1)


@dataclass
class _Pass:
    """What a block of windows gives on the way to its log probabilities. `use`: targets in the order of their places, so that
    those of one class follow each other (`runs`); `hu`, `up`: their vectors after the rectifier, and what it let through;
    `x`, `y`: exponentials of the logits of classes and members, with their sums; `right`: each target's member in `y`."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    a: np.ndarray
    use: np.ndarray
    hu: np.ndarray
    up: np.ndarray
    runs: list[tuple[int, slice]]
    right: np.ndarray
    x: np.ndarray
    y: np.ndarray
    sums: tuple[np.ndarray, np.ndarray]
    logp: np.ndarray


class Scorer:
    """A model's parameters laid out for products: values carry a column of ones, which comes out of the mix as 1, so biases
    are rows of the weights."""

    def __init__(self, m: Model):
        p, self.place = m.p, m.place
        self.pad = m.pad
        self.q, self.k = p["q"] * np.float32(KEY**-0.5), p["k"]
        self.v, self.r = _beside(p["v"], 1), _beside(p["r"] + p["rb"], 0)
        self.bias = p["near"][_DISTANCE] + _LATER
        self.cw, self.mw = np.concatenate([p["cw"], p["cb"][None]]), np.concatenate([p["mw"], p["mb"][:, None]], axis=1)

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability, 0 where there is no target."""
        found = self.forward(inputs, targets)
        out = np.zeros(targets.size, np.float32)
        out[found.use] = found.logp
        return out.reshape(targets.shape)

    def forward(self, inputs: np.ndarray, targets: np.ndarray) -> _Pass:
        """Usual logits need no shift before their exponential; a block in which a sum leaves the safe range is done again
        with each row's maximum off."""
        with np.errstate(all="ignore"):
            out = self.pass_of(inputs, targets, shift=False)
        return out if out is not None else self.pass_of(inputs, targets, shift=True)

    def pass_of(self, inputs: np.ndarray, targets: np.ndarray, shift: bool) -> _Pass | None:
        blocks, wide, classes = len(inputs), VALUE + 1, len(self.mw)
        fresh = inputs[:, CONTEXT:].ravel()
        q = self.q.take(fresh, axis=0).reshape(blocks, FRESH, KEY)
        k, v = self.k.take(inputs, axis=0), self.v.take(inputs, axis=0)
        a = np.matmul(q, k.transpose(0, 2, 1))
        a += self.bias
        if shift:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        whole = a @ np.ones(WINDOW, np.float32)
        if not shift and not _safe(whole):
            return None
        a /= whole[:, :, None]
        h = np.matmul(a, v).reshape(-1, wide)
        h += self.r.take(fresh, axis=0)

        target = targets.ravel()
        place = np.where(target >= 0, self.place.take(target, mode="clip"), classes * CLASS)
        use = np.argsort(place.astype(np.uint16) if classes * CLASS < 1 << 16 else place, kind="stable")
        use = use[: int(np.count_nonzero(target >= 0))]
        place, n = place.take(use), len(use)
        hu = h.take(use, axis=0)
        up = hu > 0
        hu *= up
        cuts = np.searchsorted(place, np.arange(classes + 1) * CLASS).tolist()
        runs = [(c, slice(lo, hi)) for c, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
        right = np.arange(0, n * CLASS, CLASS) + place % CLASS
        x, y = hu @ self.cw, np.empty((n, CLASS), np.float32)
        for c, run in runs:
            np.matmul(hu[run], self.mw[c], out=y[run])
        if shift:
            x -= x.max(axis=1, keepdims=True)
            y -= y.max(axis=1, keepdims=True)
        logp = y.ravel().take(right)
        for c, run in runs:
            logp[run] += x[run, c]
        sums = []
        for logits in (x, y):
            np.exp(logits, out=logits)
            sums.append(logits @ np.ones(logits.shape[1], np.float32))
            if not shift and not _safe(sums[-1]):
                return None
            logp -= np.log(sums[-1])
        return _Pass(q, k, v, a, use, hu, up, runs, right, x, y, tuple(sums), logp)


def score_texts(scorer: Scorer, ids: np.ndarray, starts: np.ndarray, block: int = 512) -> np.ndarray:
    """log10 probability of each text; a block of windows at a time, however long a text is."""
    out, found = np.zeros(len(starts) - 1), Windows(ids, starts, scorer.pad)
    for lo in range(0, len(found), block):
        part = slice(lo, lo + block)
        text = found.text[part]
        sums = np.bincount(text - text[0], scorer.log_probabilities(*found.at(part)).sum(axis=1, dtype=np.float64))
        out[text[0] : text[0] + len(sums)] += sums
    return out / np.log(10)


def _sums(n: int, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The sum of the rows of each of n ids; there is one more row, of zeros. Each id's rows are filled up to a multiple of
    TOGETHER with that row, so that most are added by whole arrays."""
    order = np.argsort(ids.astype(np.uint16) if n <= 1 << 16 else ids, kind="stable")
    counts = np.bincount(ids, minlength=n)
    groups = -(-counts // TOGETHER)
    ahead = (np.cumsum(groups) - groups) * TOGETHER - (np.cumsum(counts) - counts)  # by how much an id's rows move
    filled = np.full(int(groups.sum()) * TOGETHER, len(ids))
    filled[np.arange(len(ids)) + ahead.take(ids.take(order))] = order
    filled = filled.reshape(-1, TOGETHER).T.copy()
    some = rows.take(filled[0], axis=0)
    for other in filled[1:]:
        some += rows.take(other, axis=0)
    total, has = np.zeros((n, rows.shape[1]), rows.dtype), np.flatnonzero(counts)
    if len(has):
        total[has] = np.add.reduceat(some, (np.cumsum(groups) - groups)[has], axis=0)
    return total


def gradients(m: Model, inputs: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the targets and its slopes. As in scoring, exponentials are shifted only in a block that needs it."""
    with np.errstate(all="ignore"):
        out = _slopes(m, inputs, targets, shift=False)
    return out if out is not None else _slopes(m, inputs, targets, shift=True)


def _slopes(m: Model, inputs: np.ndarray, targets: np.ndarray, shift: bool) -> tuple[float, dict[str, np.ndarray]] | None:
    s = Scorer(m)
    f = s.pass_of(inputs, targets, shift)
    if f is None:
        return None
    blocks, n, ids, wide = len(inputs), len(f.use), len(s.q), VALUE + 1
    x, y, share = f.x, f.y, np.float32(1 / max(1, n))
    for slope, sums in zip((x, y), f.sums, strict=True):  # of the mean loss, by the logits
        slope *= (share / sums)[:, None]
    y.ravel()[f.right] -= share
    gm, dh, more = np.zeros_like(s.mw), np.empty((n + 1, wide + KEY), np.float32), np.empty((n, wide), np.float32)
    for c, run in f.runs:
        x[run, c] -= share
        np.matmul(f.hu[run].T, y[run], out=gm[c])
        np.matmul(y[run], s.mw[c].T, out=more[run])
    gc = f.hu.T @ x
    more += x @ s.cw.T
    np.multiply(more, f.up, out=dh[:n, :wide])
    dh[:n, VALUE:], dh[n] = 0, 0  # the ones are constant
    back = np.full(targets.size + 1, n)
    back[f.use] = np.arange(n)

    # rows of slopes by the vectors of each fresh input, and of each input; one of zeros follows
    own, seen = dh.take(back, axis=0), np.empty((blocks * WINDOW + 1, wide + KEY), np.float32)
    seen[-1] = 0
    by_fresh, by_every = own[:-1].reshape(blocks, FRESH, -1), seen[:-1].reshape(blocks, WINDOW, -1)
    dz = by_fresh[:, :, :wide]
    ds = np.matmul(dz, f.v.transpose(0, 2, 1))
    ds -= np.einsum("nfw,nfw->nf", ds, f.a)[:, :, None]
    ds *= f.a
    np.matmul(ds, f.k, out=by_fresh[:, :, wide:])
    np.matmul(f.a.transpose(0, 2, 1), dz, out=by_every[:, :, :wide])
    np.matmul(ds.transpose(0, 2, 1), f.q, out=by_every[:, :, wide:])
    own, seen = _sums(ids, inputs[:, CONTEXT:].ravel(), own), _sums(ids, inputs.ravel(), seen)
    near = np.bincount(_DISTANCE.ravel(), ds.sum(axis=0).ravel(), minlength=WINDOW).astype(np.float32)
    return -float(f.logp.sum(dtype=np.float64)) / max(1, n), {
        "q": own[:, wide:] * np.float32(KEY**-0.5), "k": seen[:, wide:], "v": seen[:, :VALUE], "r": own[:, :VALUE], "near": near,
        "rb": own[:, :VALUE].sum(axis=0), "cw": gc[:VALUE], "cb": gc[VALUE], "mw": gm[:, :VALUE], "mb": gm[:, VALUE],
    }


class Trainer:
    """Adam over blocks of windows; the learning rate falls to a tenth over `steps`, or by the root of the steps taken. The
    model's parameters become views of one array."""

    def __init__(self, model: Model, rate: float, steps: int | None = None):
        self.m, self.rate, self.steps, self.step = model, rate, steps, 0
        self.flat = pack(model.p)
        model.p = unpack(self.flat, model.p)
        self.one, self.two, self.work = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)

    def train(self, inputs: np.ndarray, targets: np.ndarray) -> float:
        loss, g = gradients(self.m, inputs, targets)
        self.step += 1
        rate = self.rate * (max(0.1, 1 - 0.9 * self.step / self.steps) if self.steps else (1 + self.step / 100) ** -0.5)
        slope, work = pack(g), self.work
        self.one += np.multiply(np.subtract(slope, self.one, out=work), np.float32(0.1), out=work)
        slope *= slope
        self.two += np.multiply(np.subtract(slope, self.two, out=work), np.float32(0.01), out=work)
        np.sqrt(np.multiply(self.two, np.float32(1 / (1 - 0.99**self.step)), out=work), out=work)
        work += np.float32(1e-8)
        np.divide(self.one, work, out=work)
        work *= np.float32(rate / (1 - 0.9**self.step))
        self.flat -= work
        return loss


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out
