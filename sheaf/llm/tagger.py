"""A character-level bidirectional LSTM with CRF transitions, in numpy: forward, backward, training and decoding."""

from __future__ import annotations

import numpy as np

#: Kinds in the order of the contract; labels are O, then begin and inside of each kind.
KINDS = ("email", "ip", "card", "phone")
N_LABELS = 1 + 2 * len(KINDS)
_FORBIDDEN = -1e4
#: Characters that get a vector of their own; others share one by kind.
_OWN = " \n\t.@+-_%()[]/:,;!?#\"'="
_LETTERS = len(_OWN) + 10
_CAPITAL, _OTHER, _ABOVE, PAD = range(_LETTERS + 26, _LETTERS + 30)
N_SYMBOLS = PAD + 1


def _symbol_table() -> np.ndarray:
    """Digits and small letters have their own symbols; capitals share one, and so do characters beyond ASCII."""
    table = np.full(1 << 16, _OTHER, dtype=np.int8)
    for k, c in enumerate(_OWN):
        table[ord(c)] = k
    table[ord("0") : ord("9") + 1] = np.arange(len(_OWN), _LETTERS)
    table[ord("a") : ord("z") + 1] = np.arange(_LETTERS, _LETTERS + 26)
    table[ord("A") : ord("Z") + 1] = _CAPITAL
    table[128:] = _ABOVE
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return _TABLE[np.minimum(codes, 0xFFFF)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logistic(minus: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in place."""
    np.minimum(minus, 60, out=minus)
    np.exp(minus, out=minus)
    minus += 1
    return np.reciprocal(minus, out=minus)


def transitions_allowed() -> np.ndarray:
    """Inside k may only follow begin k or inside k."""
    allowed = np.ones((N_LABELS + 1, N_LABELS), dtype=bool)  # the last row is the start
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        allowed[:, inside] = False
        allowed[[inside - 1, inside], inside] = True
    return allowed


class Tagger:
    """Parameters: symbol vectors, two LSTM cells, an output layer and transition scores."""

    #: Places that `outside` looks ahead; fewer only leave more to decode.
    AHEAD = 6

    def __init__(self, hidden: int = 16, width: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.hidden = hidden
        self.p = {"E": r.normal(0, 0.5, (N_SYMBOLS, width)), "O": normal(2 * hidden, N_LABELS), "o": np.zeros(N_LABELS), "T": np.zeros((N_LABELS + 1, N_LABELS))}
        for d in "fb":
            self.p |= {f"W{d}": normal(width + hidden, 4 * hidden), f"c{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.allowed = transitions_allowed()

    def _cell(self, x: np.ndarray, d: str, keep: bool):
        n, length, _ = x.shape
        hidden, w, c0 = self.hidden, self.p[f"W{d}"], self.p[f"c{d}"]
        h, c, out, saved = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), np.zeros((n, length, hidden), np.float32), []
        split = x.shape[2]
        from_input = x @ w[:split] + c0
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = from_input[:, t] + h @ w[split:]
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o, g = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
            before, h_before = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[:, t] = h
            if keep:
                saved.append((t, i, f, o, g, before, squashed, h_before))
        return out, saved

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["E"][ids]
        (forward, sf), (backward, sb) = self._cell(x, "f", keep), self._cell(x, "b", keep)
        both = np.concatenate([forward, backward], 2)
        scores = both @ self.p["O"] + self.p["o"]
        return (scores, (x, both, sf, sb)) if keep else scores

    def scored(self, ids: np.ndarray) -> np.ndarray:
        """The emissions of many sequences for reading, as (labels, length, n): the same sums as `emissions`, laid out so
        that each step works on whole rows; a hyperbolic tangent is taken as a sigmoid of twice its argument."""
        n, length = ids.shape
        hidden, width = self.hidden, self.p["E"].shape[1]
        sign = np.full((4 * hidden, 1), -1, np.float32)
        sign[3 * hidden :] = -2
        vectors, steps = np.ascontiguousarray(self.p["E"].T), np.ascontiguousarray(ids.T).astype(np.intp)
        both, z = np.empty((2 * hidden, length, n), np.float32), np.empty((4 * hidden, n), np.float32)
        for d, order, rows in (("f", range(length), slice(0, hidden)), ("b", range(length - 1, -1, -1), slice(hidden, 2 * hidden))):
            w = np.ascontiguousarray(np.concatenate([self.p[f"W{d}"], self.p[f"c{d}"][None]]).T) * sign
            x, c, out = np.zeros((width + hidden + 1, n), np.float32), np.zeros((hidden, n), np.float32), both[rows]
            x[-1] = 1
            for t in order:
                x[:width] = vectors[:, steps[t]]
                np.matmul(w, x, out=z)
                _logistic(z)
                c *= z[hidden : 2 * hidden]
                c += z[:hidden] * (2 * z[3 * hidden :] - 1)
                squashed = _logistic(-2 * c)
                np.multiply(2 * squashed - 1, z[2 * hidden : 3 * hidden], out=x[width:-1])
                out[:, t] = x[width:-1]
        return (self.p["O"].T @ both.reshape(2 * hidden, -1)).reshape(N_LABELS, length, n) + self.p["o"][:, None, None]

    def scores(self) -> np.ndarray:
        return np.where(self.allowed, self.p["T"], np.float32(_FORBIDDEN))

    def decode(self, emissions: np.ndarray) -> np.ndarray:
        """The best label path of one sequence (length, labels)."""
        t, back = self.scores(), np.zeros(emissions.shape, dtype=np.int8)
        best = t[-1] + emissions[0]
        for k in range(1, len(emissions)):
            step = best[:, None] + t[:-1]
            back[k] = step.argmax(0)
            best = step.max(0) + emissions[k]
        path = np.zeros(len(emissions), dtype=np.int8)
        path[-1] = best.argmax()
        for k in range(len(emissions) - 1, 0, -1):
            path[k - 1] = back[k, path[k]]
        return path

    def outside(self, emissions: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places of sequences laid end to end (labels, length) where every best path has O; `last` flags their ends.

        Were a path to have another label there, O in its place would score higher by more than all transitions that change
        can cost. If the path goes on inside a span, the rest of the span becomes O up to some place, where a span of its
        kind begins instead or its own one ends: `rest` bounds what that can cost from the next place on.
        """
        t, k = self.scores().astype(float), np.arange(len(KINDS))
        starts = np.concatenate([[0], 1 + 2 * k])
        gain = lambda x, y: max(0.0, np.where((x > _FORBIDDEN / 2) & (y > _FORBIDDEN / 2), x - y, 0).max())
        ends = gain(t[1:-1, starts], t[:1, starts])
        most = np.full(emissions.shape[1], ends, np.float32)
        for b in 1 + 2 * k:
            goes_on = max(t[b, b + 1], t[b + 1, b + 1])
            begun = emissions[b + 1] - emissions[b] + np.float32(goes_on - t[0, b] + gain(t[b + 1], t[b]))
            emptied = emissions[b + 1] - emissions[0] + np.float32(goes_on - t[0, 0])
            rest = begun
            for _ in range(self.AHEAD):
                after = np.append(rest[1:], np.float32(0))
                after[last] = 0
                rest = np.minimum(begun, emptied + np.maximum(after, np.float32(ends)))
            after = np.append(rest[1:], np.float32(0))
            after[last] = 0
            most = np.maximum(most, after)
        return emissions[0] - emissions[1:].max(0) > most + np.float32(gain(t[:, 1:], t[:, :1]) + 1e-2)

    def decode_parts(self, parts: list[tuple[np.ndarray, int, int | None]], together: int = 512) -> list[list[int]]:
        """The best paths of many parts (emissions, label before or -1, label after or none), those of like length together."""
        t, out = self.scores().astype(float), [[] for _ in parts]
        order = sorted(range(len(parts)), key=lambda k: len(parts[k][0]))
        while order:
            size = max(1, min(together, 500_000 // len(parts[order[-1]][0])))
            order, own = order[:-size], order[-size:]
            lengths = np.array([len(parts[k][0]) for k in own])
            e = np.zeros((len(own), lengths[-1], N_LABELS))
            for row, k in enumerate(own):
                e[row, : lengths[row]] = parts[k][0]
            best, back = t[[parts[k][1] for k in own]] + e[:, 0], np.zeros(e.shape, np.int8)
            for at in range(1, lengths[-1]):
                row = int(np.searchsorted(lengths, at, "right"))  # shorter parts have ended
                step = best[row:, :, None] + t[:-1]
                back[row:, at] = step.argmax(1)
                best[row:] = step.max(1) + e[row:, at]
            for row, k in enumerate(own):
                n, after = int(lengths[row]), parts[k][2]
                label, ways, path = int((best[row] if after is None else best[row] + t[:-1, after]).argmax()), back[row].tolist(), []
                for at in range(n - 1, -1, -1):
                    path.append(label)
                    label = ways[at][label]
                out[k] = path[::-1]
        return out

    # training

    def _crf(self, e: np.ndarray, y: np.ndarray):
        """Mean negative log likelihood and its gradients to emissions and transitions."""
        n, length, labels = e.shape
        t = self.scores()
        lse = lambda v, axis: (m := v.max(axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = t[-1] + e[:, 0]
        for k in range(1, length):
            alpha[:, k] = lse(alpha[:, k - 1, :, None] + t[None, :-1], 1) + e[:, k]
        for k in range(length - 2, -1, -1):
            beta[:, k] = lse(t[None, :-1] + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        ge = np.exp(alpha + beta - z[:, None, None])
        gt = np.zeros_like(t)
        gt[-1] += ge[:, 0].sum(0)
        for k in range(1, length):
            gt[:-1] += np.exp(alpha[:, k - 1, :, None] + t[None, :-1] + (e[:, k] + beta[:, k])[:, None, :] - z[:, None, None]).sum(0)
        rows = np.arange(n)
        gold = t[-1, y[:, 0]] + e[rows[:, None], np.arange(length)[None], y].sum(1) + t[y[:, :-1], y[:, 1:]].sum(1)
        ge[rows[:, None], np.arange(length)[None], y] -= 1
        np.subtract.at(gt, (labels, y[:, 0]), 1)
        np.subtract.at(gt, (y[:, :-1], y[:, 1:]), 1)
        return (z - gold).mean(), ge / n, np.where(self.allowed, gt / n, 0)

    def _cell_back(self, d: str, x: np.ndarray, saved, gh_all: np.ndarray, grads: dict) -> np.ndarray:
        n, _, width = x.shape
        hidden, w = self.hidden, self.p[f"W{d}"]
        gh, gc, gx = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32), np.zeros_like(x)
        gw, gb = np.zeros_like(w), np.zeros(4 * hidden, np.float32)
        for t, i, f, o, g, before, squashed, h_before in reversed(saved):
            gh = gh + gh_all[:, t]
            gc = gc + gh * o * (1 - squashed**2)
            gz = np.concatenate([gc * g * i * (1 - i), gc * before * f * (1 - f), gh * squashed * o * (1 - o), gc * i * (1 - g**2)], 1)
            gw[:width] += x[:, t].T @ gz
            gw[width:] += h_before.T @ gz
            gb += gz.sum(0)
            back = gz @ w.T
            gx[:, t], gh, gc = back[:, :width], back[:, width:], gc * f
        grads[f"W{d}"], grads[f"c{d}"] = gw, gb
        return gx

    def gradients(self, ids: np.ndarray, y: np.ndarray):
        e, (x, both, sf, sb) = self.emissions(ids, keep=True)
        loss, ge, gt = self._crf(e, y)
        grads = {"T": gt, "O": np.einsum("ntk,ntl->kl", both, ge), "o": ge.sum((0, 1))}
        gboth = ge @ self.p["O"].T
        gx = self._cell_back("f", x, sf, gboth[..., : self.hidden], grads) + self._cell_back("b", x, sb, gboth[..., self.hidden :], grads)
        grads["E"] = np.zeros_like(self.p["E"])
        np.add.at(grads["E"], ids, gx)
        return loss, grads

    def train(self, ids: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 3) -> list[float]:
        """Adam with clipped gradients; the loss of each epoch."""
        r, step, losses = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            for at in range(0, len(ids), batch):
                own = order[at : at + batch]
                loss, grads = self.gradients(ids[own], y[own])
                norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
                step, total = step + 1, total + loss * len(own)
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g**2
                    self.p[k] -= np.float32(rate * 0.7**epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(ids))
        return losses
