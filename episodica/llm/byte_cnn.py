"""A convolutional network over windows of bytes: embedding, filters of several widths, max pooling, softmax."""

from __future__ import annotations

import numpy as np

WINDOW, WIDTHS, FILTERS, EMBEDDING = 128, (2, 3, 4), 8, 8


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = r.normal(0, 0.3, (256, EMBEDDING)).astype(np.float32)
        self.filters = [r.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        embedded = self.embedding[x]
        pooled, at = [], []
        for f, b in zip(self.filters, self.bias):
            w, n = len(f), WINDOW - len(f) + 1
            z = sum(embedded[:, j : j + n] @ f[j] for j in range(w)) + b
            at.append(z.argmax(1))
            pooled.append(np.take_along_axis(z, at[-1][:, None], 1)[:, 0])
        raw = np.concatenate(pooled, 1)
        hidden = np.maximum(raw, 0)
        z = hidden @ self.out + self.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.out.T) * (raw > 0)
        d_embedding, d_filters, d_bias = np.zeros_like(self.embedding), [], []
        for k, f in enumerate(self.filters):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            d_filter = np.zeros_like(f)
            for j in range(len(f)):
                code = np.take_along_axis(x, at[k] + j, 1)  # the byte under the filter, for each window and filter
                d_filter[j] = np.einsum("bfe,bf->ef", self.embedding[code], d)
                np.add.at(d_embedding, code, d[:, :, None] * f[j].T[None])
            d_filters.append(d_filter)
            d_bias.append(d.sum(0))
        return [d_embedding, *d_filters, *d_bias, hidden.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        weights = self.parameters()
        mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for a in range(0, len(y), batch):
                part = order[a : a + batch]
                step += 1
                for w, m, v, g in zip(weights, mean, square, self.gradients(x[part], y[part])):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def fold(self) -> None:
        """Tables of what a byte, or a pair of bytes, adds to each filter."""
        self.tables = []
        for f in self.filters:
            single = [self.embedding @ f[j] for j in range(len(f))]
            pairs = [(a[:, None] + b[None]).reshape(65536, FILTERS) for a, b in zip(single[::2], single[1::2])]
            self.tables.append((pairs, single[-1] if len(f) % 2 else None))

    def logits(self, x: np.ndarray, at_once: int = 4096) -> np.ndarray:
        found = [np.zeros((0, len(self.labels)), np.float32)]
        for a in range(0, len(x), at_once):
            column = np.ascontiguousarray(x[a : a + at_once].T).astype(np.int32)
            pair = (column[:-1] << 8) | column[1:]
            pooled = []
            for f, b, (pairs, single) in zip(self.filters, self.bias, self.tables):
                best = np.full((column.shape[1], FILTERS), -np.inf, np.float32)
                z, add = np.empty_like(best), np.empty_like(best)
                for i in range(WINDOW - len(f) + 1):
                    np.take(pairs[0], pair[i], axis=0, out=z, mode="clip")
                    for k, table in enumerate(pairs[1:], 1):
                        z += np.take(table, pair[i + 2 * k], axis=0, out=add, mode="clip")
                    if single is not None:
                        z += np.take(single, column[i + len(f) - 1], axis=0, out=add, mode="clip")
                    np.maximum(best, z, out=best)
                pooled.append(best + b)
            found.append(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias)
        return np.concatenate(found)
