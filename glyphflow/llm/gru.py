"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Input is a window of tokens; a token is its word embedding beside the mean of
the embeddings of its character trigrams, both by hashing, so every spelling has
an input. Forward and backward states meet in a softmax attention; a logistic
unit on the pooled state gives the window's score.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS, CHARS, DIM, HIDDEN, WINDOW, STRIDE = 8192, 8192, 16, 20, 24, 12


def features(token: str) -> tuple[int, list[int]]:
    """Bucket of the word and buckets of its character trigrams."""
    marked = f"^{token}$"
    grams = [marked[i : i + 3] for i in range(max(1, len(marked) - 2))]
    h = lambda s, seed: xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass"), seed)
    return h(token, 1) % WORDS, [h(g, 2) % CHARS for g in grams]


def sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters, scoring and training. ``p`` maps names to float32 arrays."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *s, k=None: (rng.standard_normal(s) * (k or 1 / np.sqrt(s[0]))).astype(np.float32)
        d, h = 2 * DIM, HIDDEN
        self.p = {"word": f(WORDS, DIM, k=0.1), "char": f(CHARS, DIM, k=0.1), "wx": f(d, 6 * h), "bx": np.zeros(6 * h, np.float32), "va": f(2 * h), "wo": f(2 * h), "bo": np.zeros(1, np.float32)}
        for side in "fb":
            self.p[f"u{side}"] = f(h, 3 * h)

    def embed(self, feats: list[tuple[int, list[int]]]) -> np.ndarray:
        """Token vectors, one row per token; the char part is a mean over its trigrams."""
        out = np.empty((len(feats), 2 * DIM), np.float32)
        out[:, :DIM] = self.p["word"][[w for w, _ in feats]]
        sizes = np.array([len(c) for _, c in feats])
        flat = np.fromiter((x for _, c in feats for x in c), np.int64, sizes.sum())
        out[:, DIM:] = np.add.reduceat(self.p["char"][flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
        return out

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.p["wx"] + self.p["bx"]

    def forward(self, proj: np.ndarray, idx: np.ndarray, keep: bool = False):
        """Scores of windows; ``idx`` (windows x WINDOW) points into ``proj``, -1 where there is no token."""
        n, steps, h = len(idx), idx.shape[1], HIDDEN
        mask = (idx >= 0).astype(np.float32)
        states = np.empty((steps, n, 2 * h), np.float32)
        tape = {}
        for s, side in enumerate("fb"):
            u, now = self.p[f"u{side}"], np.zeros((n, h), np.float32)
            trail = []
            for t in range(steps) if s == 0 else range(steps - 1, -1, -1):
                x = proj[idx[:, t], 3 * h * s : 3 * h * (s + 1)]
                hu = now @ u
                g = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = g[:, :h], g[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                m = mask[:, t : t + 1]
                new = m * ((1 - z) * c + z * now)
                if keep:
                    trail.append((t, now, z, r, c, hu[:, 2 * h :], m))
                now = new
                states[t, :, h * s : h * (s + 1)] = now
            tape[side] = trail
        a = states @ self.p["va"] + (mask.T - 1) * 1e9
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        score = sigmoid(pooled @ self.p["wo"] + self.p["bo"])
        return (score, (states, a, pooled, tape)) if keep else score

    def gradients(self, vectors, idx, target, weight):
        """Gradients of the weighted log loss; returns them with that of the token vectors."""
        proj = self.project(vectors)
        score, (states, a, pooled, tape) = self.forward(proj, idx, True)
        h, g = HIDDEN, {}
        d_out = ((score - target) * weight / max(weight.sum(), 1e-6)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ d_out, d_out.sum(keepdims=True)
        d_pool = d_out[:, None] * self.p["wo"]
        d_a = np.einsum("nh,tnh->tn", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(0))
        g["va"] = np.einsum("tn,tnh->h", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * self.p["va"]
        d_proj = np.zeros_like(proj)
        for s, side in enumerate("fb"):
            u, du = self.p[f"u{side}"], np.zeros_like(self.p[f"u{side}"])
            carry = np.zeros((len(idx), h), np.float32)
            for t, before, z, r, c, hc, m in reversed(tape[side]):
                d = (d_states[t, :, h * s : h * (s + 1)] + carry) * m
                dz = d * (before - c) * z * (1 - z)
                dc = d * (1 - z) * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                d_hu = np.concatenate([dz, dr, dc * r], 1)
                d_x = np.concatenate([dz, dr, dc], 1)
                ok = idx[:, t] >= 0
                np.add.at(d_proj[:, 3 * h * s : 3 * h * (s + 1)], idx[ok, t], d_x[ok])
                du += before.T @ d_hu
                carry = d * z + d_hu @ u.T
            g[f"u{side}"] = du
        g["wx"], g["bx"] = vectors.T @ d_proj, d_proj.sum(0)
        return g, d_proj @ self.p["wx"].T, score

    def train(self, feats: list, idx: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int, seed: int = 0, rate: float = 4e-3, batch: int = 256) -> None:
        """Adam over shuffled batches; ``feats`` are those of the tokens that ``idx`` points to."""
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(idx) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(idx))
            for s in range(0, len(order), batch):
                rows = order[s : s + batch]
                used, local = np.unique(idx[rows], return_inverse=True)
                local = local.reshape(idx[rows].shape)
                if used[0] < 0:
                    used, local = used[1:], local - 1
                some = [feats[i] for i in used]
                g, d_tok, _ = self.gradients(self.embed(some), local, target[rows], weight[rows])
                step += 1
                lr = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in g.items():
                    m, v = moments[k]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    self.p[k] -= lr * m / (np.sqrt(v) + 1e-8)
                sizes = np.array([len(c) for _, c in some])
                flat = np.fromiter((x for _, c in some for x in c), np.int64, sizes.sum())
                for k, at, d in (("word", np.array([w for w, _ in some]), d_tok[:, :DIM]), ("char", flat, np.repeat(d_tok[:, DIM:] / sizes[:, None], sizes, axis=0))):
                    rows_, inv = np.unique(at, return_inverse=True)
                    sums = np.zeros((len(rows_), DIM), np.float32)
                    np.add.at(sums, inv, d)
                    m, v = moments[k]  # only the rows that this batch touches move
                    m[rows_] += 0.1 * (sums - m[rows_])
                    v[rows_] += 0.001 * (sums * sums - v[rows_])
                    self.p[k][rows_] -= lr * m[rows_] / (np.sqrt(v[rows_]) + 1e-8)


def windows(n: int) -> list[tuple[int, int]]:
    """All overlapping windows over n tokens: every STRIDE tokens, the last one flush with the end."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]
