"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are looked up (so the input needs no product), two LSTMs read a window in either direction, a linear layer scores
the tags of each character, and a linear-chain CRF ties neighbouring tags. No entity reaches over a line break, so lines are
scored by themselves, each distinct one once, in batches of like length. Long lines are scored in overlapping windows; the
scores of a character in several windows are averaged, weighted by its distance to the window's ends, and one Viterbi pass
over each whole line settles the tags, so windows are reconciled globally.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
N = len(TAGS)
#: Characters: printable ASCII, line break, tab, other lower, other upper, the rest, padding.
LINE, TAB, LOWER, UPPER, REST, PAD = 95, 96, 97, 98, 99, 100
VOCABULARY = 101
#: Window and stride in characters.
WINDOW, STRIDE = 128, 96
_UP = r"[^\W\d_a-z]"
#: What a line must hold to be scored: an at-sign or word between words, six digits not far apart, a number beside a capital, or
#: two words with a capital not far apart. The forms of all kinds hold one of these.
POSSIBLE = re.compile(rf"\w@\w|[\[({{ ]at[\])}} ].*(?:\.\w|dot)|(?:\d[^\w\n]{{0,3}}){{6}}|\d\w? {_UP}|\d[A-Za-z] \d|(?<!\w){_UP}\w+\.? #?\d|(?<!\w){_UP}[\w'’.-]*,? (?:\w{{2,3}} ){{0,2}}{_UP}")
WEIGHTS = Path(__file__).with_name("tagger.npz")


def codes(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(u), REST, dtype=np.int16)
    plain = (u >= 32) & (u < 127)
    out[plain] = u[plain] - 32
    out[u == 10] = LINE
    out[u == 9] = TAB
    for i in np.flatnonzero(~plain & (u != 10) & (u != 9)):
        c = chr(u[i])
        out[i] = LOWER if c.islower() else UPPER if c.isupper() else REST
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def initial(hidden: int = 24, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.15, (VOCABULARY, 4 * hidden))
        p[f"u{d}"] = rng.normal(0, 0.7 / np.sqrt(hidden), (hidden, 4 * hidden))
        b = np.zeros(4 * hidden)
        b[hidden : 2 * hidden] = 1.0
        p[f"b{d}"] = b
    p["w"] = rng.normal(0, 0.2, (2 * hidden, N))
    p["o"] = np.zeros(N)
    p["t"] = np.zeros((N, N))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: bool = False):
    """Hidden states (length, batch, hidden) over codes (length, batch)."""
    hidden = p[f"u{d}"].shape[0]
    n, batch = x.shape
    table = p[f"x{d}"] + p[f"b{d}"]
    u = p[f"u{d}"]
    h, c = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
    out = np.empty((n, batch, hidden), np.float32)
    memory = []
    inside = (x != PAD).astype(np.float32)[:, :, None]  # padding leaves no trace, so a line's scores don't depend on its batch
    for t in range(n):
        z = table[x[t]]
        z += h @ u
        g = np.tanh(z[:, 3 * hidden :])
        s = _sigmoid(z[:, : 3 * hidden])
        i, f, o = s[:, :hidden], s[:, hidden : 2 * hidden], s[:, 2 * hidden :]
        c_old = c
        c = (f * c + i * g) * inside[t]
        tc = np.tanh(c)
        if keep:
            memory.append((h, c_old, i, f, o, g, tc, inside[t]))
        h = o * tc
        out[t] = h
    return (out, memory) if keep else out


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Tag scores (length, batch, tags)."""
    f = _lstm(p, "f", x)
    b = _lstm(p, "b", x[::-1])[::-1]
    return np.concatenate([f, b], axis=2) @ p["w"] + p["o"]


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def loss_and_gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log likelihood of the tag paths ``y`` (length, batch), and its gradients."""
    n, batch = x.shape
    hf, mf = _lstm(p, "f", x, True)
    hb, mb = _lstm(p, "b", x[::-1], True)
    both = np.concatenate([hf, hb[::-1]], axis=2)
    e = both @ p["w"] + p["o"]
    t = p["t"]
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for k in range(1, n):
        alpha[k] = _logsumexp(alpha[k - 1][:, :, None] + t, 1) + e[k]
    beta = np.zeros_like(e)
    for k in range(n - 2, -1, -1):
        beta[k] = _logsumexp(t[None] + (e[k + 1] + beta[k + 1])[:, None, :], 2)
    z = _logsumexp(alpha[-1], 1)
    rows = np.arange(batch)
    gold = e[np.arange(n)[:, None], rows[None], y].sum(0) + t[y[:-1], y[1:]].sum(0)
    de = np.exp(alpha + beta - z[None, :, None])
    de[np.arange(n)[:, None], rows[None], y] -= 1.0
    dt = np.zeros_like(t)
    for k in range(1, n):
        dt += np.exp(alpha[k - 1][:, :, None] + t[None] + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1.0)
    scale = 1.0 / batch
    de = (de * scale).astype(np.float32)
    g = {"t": (dt * scale).astype(np.float32), "w": both.reshape(-1, both.shape[2]).T @ de.reshape(-1, N), "o": de.sum((0, 1))}
    dboth = de @ p["w"].T
    hidden = p["uf"].shape[0]
    for d, memory, dh_all, xs in (("f", mf, dboth[:, :, :hidden], x), ("b", mb, dboth[::-1, :, hidden:], x[::-1])):
        u = p[f"u{d}"]
        du = np.zeros_like(u)
        all_dz = np.empty((n, batch, 4 * hidden), dh_all.dtype)
        dh, dc = np.zeros((batch, hidden), np.float32), np.zeros((batch, hidden), np.float32)
        for k in range(n - 1, -1, -1):
            h, c_old, i, f, o, gg, tc, inside = memory[k]
            dh = dh + dh_all[k]
            dc = (dc + dh * o * (1 - tc * tc)) * inside
            dz = np.concatenate([dc * gg * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
            du += h.T @ dz
            all_dz[k] = dz
            dh = dz @ u.T
            dc = dc * f
        shown = np.zeros((n * batch, VOCABULARY), all_dz.dtype)
        shown[np.arange(n * batch), xs.reshape(-1)] = 1.0
        dx = shown.T @ all_dz.reshape(n * batch, -1)
        g[f"x{d}"], g[f"u{d}"], g[f"b{d}"] = dx, du, dx.sum(0)
    return float((z - gold).mean()), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.k = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], most: float = 5.0) -> None:
        self.k += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        shrink = min(1.0, most / (norm + 1e-9))
        for k in p:
            x = g[k] * shrink
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.999 * self.v[k] + 0.001 * x * x
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.k)) / (np.sqrt(self.v[k] / (1 - 0.999**self.k)) + 1e-8)).astype(np.float32)


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tag paths (length, batch) of scores (length, batch, tags)."""
    n, batch, _ = e.shape
    best, back = e[0], np.empty((n, batch, N), np.int8)
    for k in range(1, n):
        s = best[:, :, None] + t
        back[k] = s.argmax(1)
        best = s.max(1) + e[k]
    out = np.empty((n, batch), np.int8)
    out[-1] = best.argmax(1)
    rows = np.arange(batch)
    for k in range(n - 1, 0, -1):
        out[k - 1] = back[k, rows, out[k]]
    return out


def load(path: Path | str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _score(p: dict[str, np.ndarray], text: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Averaged scores (characters, tags) of one long code array, read in overlapping windows."""
    size = len(text)
    starts = np.arange(0, max(size - WINDOW + STRIDE, 1), STRIDE)
    padded = np.full(int(starts[-1]) + WINDOW, PAD, np.int16)
    padded[:size] = text
    ramp = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    total, weight = np.zeros((len(padded), N), np.float32), np.zeros(len(padded), np.float32)
    for k in range(0, len(starts), chunk):
        at = starts[k : k + chunk]
        x = padded[at[None, :] + np.arange(WINDOW)[:, None]]
        e = emissions(p, x) * ramp[:, None, None]
        for half in (0, 1):  # windows two apart don't overlap, so each half is added in one go
            sel = np.arange(half, len(at), 2)
            if len(sel):
                pos = (at[sel][None, :] + np.arange(WINDOW)[:, None]).ravel()
                total[pos] += e[:, sel].reshape(-1, N)
                weight[pos] += np.repeat(ramp, len(sel))
    return total[:size] / weight[:size, None]


class Tagger:
    """Spans of texts by one set of weights, with a bounded memory of the lines seen."""

    def __init__(self, p: dict[str, np.ndarray], most: int = 200_000):
        self.p, self.most = p, most
        self.seen: dict[str, tuple[tuple[int, int, str], ...]] = {}

    def __call__(self, texts: Sequence[str], most_chars: int = 4_000_000) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text; texts are taken in blocks of ``most_chars``."""
        out: list[list[tuple[int, int, str]]] = []
        block: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            block.append(t)
            size += len(t)
            if size >= most_chars or i == len(texts) - 1:
                out += self._block(block)
                block, size = [], 0
        return out

    def _block(self, texts: Sequence[str]) -> list[list[tuple[int, int, str]]]:
        where: list[list[tuple[int, str]]] = []
        for t in texts:
            mine, at = [], 0
            for line in t.split("\n"):
                if line and POSSIBLE.search(line):
                    mine.append((at, line))
                at += len(line) + 1
            where.append(mine)
        if len(self.seen) > self.most:
            self.seen.clear()
        fresh = list({line for mine in where for _, line in mine} - self.seen.keys())
        self.seen.update(zip(fresh, tag_lines(self.p, fresh)))
        return [[(at + a, at + b, kind) for at, line in mine for a, b, kind in self.seen[line]] for mine in where]


def tag_lines(p: dict[str, np.ndarray], lines: Sequence[str], cells: int = 400_000) -> list[tuple[tuple[int, int, str], ...]]:
    """Spans of each line; ``cells`` characters, padding included, are scored at once."""
    out: list[tuple[tuple[int, int, str], ...]] = [()] * len(lines)
    order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
    k = 0
    while k < len(order):
        longest, n = len(lines[order[k]]), 1
        if longest > WINDOW:
            x = codes(lines[order[k]])
            out[order[k]] = spans_of(viterbi(_score(p, x)[:, None, :], p["t"])[:, 0])
            k += 1
            continue
        while k + n < len(order) and len(lines[order[k + n]]) <= min(WINDOW, longest + longest // 8 + 2) and n * len(lines[order[k + n]]) < cells:
            n += 1
        group = order[k : k + n]
        k += n
        longest = len(lines[group[-1]])
        x = np.full((longest, n), PAD, np.int16)
        joined, at = codes("".join(lines[i] for i in group)), 0
        for j, i in enumerate(group):
            x[: len(lines[i]), j] = joined[at : at + len(lines[i])]
            at += len(lines[i])
        e = emissions(p, x)
        # a line on which no tag comes near "outside" can't hold anything; the margin covers what transitions can add
        margin = float(p["t"].max() - p["t"][0, 0]) + 1.0
        near = np.flatnonzero((((e[:, :, 1:].max(2) - e[:, :, 0]) > -margin) & (x != PAD)).any(0))
        if not len(near):
            continue
        e, pad = e[:, near], x[:, near] == PAD
        e[pad] = -1e4
        e[pad, 0] = 0.0
        tags = viterbi(e, p["t"])
        for j, i in zip(np.flatnonzero(tags.any(0)), near[tags.any(0)]):
            out[group[i]] = spans_of(tags[: len(lines[group[i]]), j])
    return out


def spans_of(path: np.ndarray) -> tuple[tuple[int, int, str], ...]:
    """The tagged runs of one path; a run also begins where its kind changes."""
    on = np.flatnonzero(path)
    if not len(on):
        return ()
    kind = (path[on] + 1) // 2
    begin = (path[on] % 2 == 1) | (np.diff(on, prepend=-2) != 1) | (np.diff(kind, prepend=0) != 0)
    firsts = np.flatnonzero(begin)
    lasts = np.append(firsts[1:], len(on)) - 1
    return tuple((int(on[a]), int(on[b]) + 1, KINDS[int(kind[a]) - 1]) for a, b in zip(firsts, lasts))
