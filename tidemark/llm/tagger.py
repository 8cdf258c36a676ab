"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from tidemark.llm.common import sigmoid

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAD, OTHER = 0, 1
N_CHARS = 2 + 96


def encode(text: str, length: int) -> np.ndarray:
    """Character codes: printable ASCII one by one, all else as one; padded to ``length``."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    codes = np.where((codes >= 32) & (codes < 128), codes - 30, OTHER)
    return np.pad(codes[:length], (0, max(0, length - len(codes))), constant_values=PAD)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, n_tags: int, embed: int = 12, hidden: int = 20, seed: int = 5):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.hidden, self.n_tags = hidden, n_tags
        self.p = {"E": rng.normal(0, 0.5, (N_CHARS, embed)), "U": start(2 * hidden, n_tags), "c": np.zeros(n_tags),
                  "A": np.zeros((n_tags, n_tags)), "s": np.zeros(n_tags)}
        for d in "fb":
            self.p |= {f"Wx{d}": start(embed, 4 * hidden), f"Wh{d}": start(hidden, 4 * hidden), f"w{d}": np.zeros(4 * hidden)}
            self.p[f"w{d}"][hidden : 2 * hidden] = 1.0  # remember at first

    def _run(self, x: np.ndarray, d: str):
        """Hidden states of one direction, and what the backward pass needs."""
        b, n, _ = x.shape
        h, c, k = np.zeros((b, self.hidden)), np.zeros((b, self.hidden)), self.hidden
        drive = x @ self.p[f"Wx{d}"] + self.p[f"w{d}"]
        out, kept = np.zeros((b, n, k)), []
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = drive[:, t] + h @ self.p[f"Wh{d}"]
            gates, g = sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            kept.append((t, i, f, o, g, tc, before_h, before_c))
        return out, kept

    def unary(self, codes: np.ndarray) -> np.ndarray:
        x = self.p["E"][codes]
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], axis=2)
        return both @ self.p["U"] + self.p["c"]

    def viterbi(self, unary: np.ndarray) -> np.ndarray:
        """The best tags of one sequence of unary scores."""
        best, back = self.p["s"] + unary[0], []
        for u in unary[1:]:
            step = best[:, None] + self.p["A"]
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + u
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])

    def _crf(self, u: np.ndarray, y: np.ndarray):
        """Negative log-likelihood a sequence, and the gradients of u, A and s."""
        b, n, k = u.shape
        a, s, rows = self.p["A"], self.p["s"], np.arange(b)
        alpha, beta = np.zeros((b, n, k)), np.zeros((b, n, k))
        alpha[:, 0] = s + u[:, 0]
        for t in range(1, n):
            alpha[:, t] = _logsum(alpha[:, t - 1, :, None] + a, 1) + u[:, t]
        for t in range(n - 2, -1, -1):
            beta[:, t] = _logsum(a[None] + (u[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsum(alpha[:, -1], 1)
        du = np.exp(alpha + beta - z[:, None, None])
        da = np.zeros_like(a)
        gold = s[y[:, 0]] + u[rows, 0, y[:, 0]]
        for t in range(1, n):
            pair = alpha[:, t - 1, :, None] + a + (u[:, t] + beta[:, t])[:, None, :] - z[:, None, None]
            da += np.exp(pair).sum(axis=0)
            np.add.at(da, (y[:, t - 1], y[:, t]), -1)
            gold += a[y[:, t - 1], y[:, t]] + u[rows, t, y[:, t]]
        np.add.at(du, (rows[:, None], np.arange(n)[None], y), -1)
        return float((z - gold).mean()), du / b, da / b, du[:, 0].sum(axis=0) / b

    def gradients(self, codes: np.ndarray, y: np.ndarray):
        p, k = self.p, self.hidden
        x = p["E"][codes]
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        loss, du, da, ds = self._crf(both @ p["U"] + p["c"], y)
        g = {"U": np.einsum("bnh,bnt->ht", both, du), "c": du.sum(axis=(0, 1)), "A": da, "s": ds}
        dboth, dx = du @ p["U"].T, np.zeros_like(x)
        for d, part in (("f", dboth[:, :, :k]), ("b", dboth[:, :, k:])):
            dz = np.zeros((*x.shape[:2], 4 * k))
            dh, dc, dwh = np.zeros((len(x), k)), np.zeros((len(x), k)), np.zeros_like(p[f"Wh{d}"])
            for t, i, f, o, gg, tc, before_h, before_c in reversed(runs[d][1]):
                dh = dh + part[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                z = np.concatenate([dc * gg * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dz[:, t] = z
                dwh += before_h.T @ z
                dh, dc = z @ p[f"Wh{d}"].T, dc * f
            g |= {f"Wh{d}": dwh, f"Wx{d}": np.einsum("bne,bnz->ez", x, dz), f"w{d}": dz.sum(axis=(0, 1))}
            dx += dz @ p[f"Wx{d}"].T
        g["E"] = np.zeros_like(p["E"])
        np.add.at(g["E"], codes, dx)
        return loss, g

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> list[float]:
        """Adam over shuffled batches; the mean loss of every epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order, total = rng.permutation(len(codes)), 0.0
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(codes[part], y[part])
                total += loss * len(part)
                step += 1
                scale = min(1.0, 5.0 / (np.sqrt(sum((x * x).sum() for x in g.values())) + 1e-9))
                for k, x in g.items():
                    x = x * scale
                    m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / max(len(order), 1))
        return losses
