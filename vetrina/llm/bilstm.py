"""A character-level bidirectional LSTM with a CRF on top, in numpy.

Sequences are rows of character classes, padded with class 0 at the end.
Training is minibatch Adam on the CRF's log-likelihood; decoding is Viterbi.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    def __init__(self, n_classes: int, n_tags: int, hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {"emit_bias": np.zeros(n_tags), "emit": rng.normal(0, 0.2, (2 * hidden, n_tags)),
                  "move": np.zeros((n_tags, n_tags)), "start": np.zeros(n_tags), "stop": np.zeros(n_tags)}
        for way in ("f", "b"):
            self.p |= {f"{way}_in": rng.normal(0, 0.3, (n_classes, 4 * hidden)),
                       f"{way}_hid": rng.normal(0, 0.3, (hidden, 4 * hidden)), f"{way}_bias": np.zeros(4 * hidden)}
            self.p[f"{way}_bias"][hidden:2 * hidden] = 1.0  # remember at first

    def _lstm(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States over time, (steps, rows, hidden). x, mask: (steps, rows)."""
        n = self.hidden
        h = np.zeros((x.shape[1], n))
        c = np.zeros_like(h)
        out = np.zeros((*x.shape, n))
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        w_in, w_hid = self.p[f"{way}_in"] + self.p[f"{way}_bias"], self.p[f"{way}_hid"]
        for t in steps:
            m = mask[t][:, None]
            z = w_in[x[t]] + h @ w_hid
            gates = _sigmoid(z)
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 3 * n:]
            g = np.tanh(z[:, 2 * n:3 * n])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, i, f, g, o, tc, c, h))
            c, h = m * c_new, m * (o * tc)
            out[t] = h
        return out

    def _back(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list, grad: np.ndarray, into: dict) -> None:
        n = self.hidden
        dh = np.zeros((x.shape[1], n))
        dc = np.zeros_like(dh)
        w = self.p[f"{way}_hid"]
        for t, i, f, g, o, tc, c_old, h_old in reversed(keep):
            m = mask[t][:, None]
            dh = (dh + grad[t]) * m
            dc = dc * m + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c_old * f * (1 - f), dc * i * (1 - g * g), dh * tc * o * (1 - o)), axis=1)
            np.add.at(into[f"{way}_in"], x[t], dz)
            into[f"{way}_hid"] += h_old.T @ dz
            into[f"{way}_bias"] += dz.sum(axis=0)
            dh = dz @ w.T
            dc = dc * f

    def scores(self, x: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission scores (steps, rows, tags), the states they come from, and the mask."""
        x = x.T
        mask = (x > 0).astype(float)
        both = np.concatenate([self._lstm(way, x, mask, keep[k] if keep else None) for k, way in enumerate("fb")], axis=2)
        return both @ self.p["emit"] + self.p["emit_bias"], both, mask

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the rows' tags, and its gradient."""
        keep: tuple[list, list] = ([], [])
        e, both, mask = self.scores(x, keep)
        steps, rows, n = e.shape
        move, m, y = self.p["move"], mask[:, :, None], tags.T
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = self.p["start"] + e[0]
        for t in range(1, steps):
            new = _logsumexp(alpha[t - 1][:, :, None] + move, 1) + e[t]
            alpha[t] = np.where(m[t] > 0, new, alpha[t - 1])
        beta[-1] = self.p["stop"]
        for t in range(steps - 2, -1, -1):
            new = _logsumexp(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(m[t + 1] > 0, new, beta[t + 1])
        log_z = _logsumexp(alpha[-1] + self.p["stop"], 1)
        each, last = np.arange(rows), mask.sum(axis=0).astype(int) - 1
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        at = np.exp(alpha + beta - log_z[:, None]) * m
        gold = self.p["start"][y[0]] + self.p["stop"][y[last, each]] - log_z
        gold += (np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] * mask).sum(axis=0)
        de = at.copy()
        np.subtract.at(de, (np.arange(steps)[:, None], each[None, :], y), mask)
        grad["start"] = at[0].sum(axis=0) - np.bincount(y[0], minlength=n)
        grad["stop"] = at[last, each].sum(axis=0) - np.bincount(y[last, each], minlength=n)
        for t in range(1, steps):
            both_tags = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]) * m[t][:, :, None]
            grad["move"] += both_tags.sum(axis=0)
            np.subtract.at(grad["move"], (y[t - 1], y[t]), mask[t])
            gold += move[y[t - 1], y[t]] * mask[t]
        grad["emit"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, n)
        grad["emit_bias"] = de.sum(axis=(0, 1))
        into = de @ self.p["emit"].T
        for k, way in enumerate("fb"):
            self._back(way, x.T, mask, keep[k], into[:, :, k * self.hidden:(k + 1) * self.hidden], grad)
        return -gold.mean(), {k: v / rows for k, v in grad.items()}

    def fit(self, x: np.ndarray, tags: np.ndarray, steps: int, rows: int = 32, rate: float = 0.05, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), min(rows, len(x)))
            used = max(int((x[pick] > 0).sum(axis=1).max()), 1)
            _, grad = self.gradient(x[pick, :used], tags[pick, :used])
            norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
            speed = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                self.p[k] -= speed * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)

    def decode(self, x: np.ndarray, barred: np.ndarray) -> np.ndarray:
        """Best tags of each row; ``barred`` marks tag pairs that may not follow."""
        e, _, mask = self.scores(x)
        steps, rows, n = e.shape
        move = np.where(barred, -1e9, self.p["move"])
        best = self.p["start"] + e[0] + np.where(barred[0], -1e9, 0)
        back = np.zeros((steps, rows, n), dtype=np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + move
            back[t] = np.where(mask[t][:, None] > 0, options.argmax(axis=1), np.arange(n))
            best = np.where(mask[t][:, None] > 0, options.max(axis=1) + e[t], best)
        tags = np.zeros((rows, steps), dtype=np.int64)
        tags[:, -1] = (best + self.p["stop"]).argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(rows), tags[:, t]]
        return tags
