"""Small models in numpy, trained on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class FactorizationMachine:
    """y = sigmoid(w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)) over the present features of a document.

    Features are bucket numbers, each once for a document. Trained by AdaGrad over mini-batches, with L2 on what a batch touches.
    """

    def __init__(self, n_features: int, rank: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0 = np.float32(0)
        self.w = np.zeros(n_features, np.float32)
        self.v = rng.normal(0, 0.02, (n_features, rank)).astype(np.float32)
        self.seen = np.zeros(n_features, bool)

    def raw(self, rows: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        """rows: ascending document numbers (0..n-1), one for each entry of feats."""
        out = np.full(n, float(self.w0))
        if len(rows):
            out += np.bincount(rows, self.w[feats], n)
            v = self.v[feats]
            for f in range(v.shape[1]):
                out += 0.5 * (np.bincount(rows, v[:, f], n) ** 2 - np.bincount(rows, v[:, f] ** 2, n))
        return out

    def fit(self, rows: np.ndarray, feats: np.ndarray, y: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.1, l2: float = 1e-4, least_df: int = 3, least_z: float = 2.5, seed: int = 7) -> FactorizationMachine:
        """Features get weights and factors if they are in least_df documents or more and either their shares in both labels differ by least_z standard
        errors, or they are in a pair that the weights alone don't explain (`paired`): the many others would only let the model learn its rows by heart."""
        df = np.bincount(feats, minlength=len(self.w))
        n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
        with_1 = np.bincount(feats[y[rows] > 0], minlength=len(self.w))
        p = df / len(y)
        error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        alone = (df >= least_df) & (np.abs(with_1 / n1 - (df - with_1) / n0) >= least_z * error)
        start = self.v.copy()
        self.v[:] = 0
        self._descend(rows, feats, y, alone, epochs // 4, batch, rate, l2, seed)
        self.seen = alone | paired(rows, feats, y, sigmoid(level(self.raw(rows[alone[feats]], feats[alone[feats]], len(y)), y)), df >= least_df)
        self.w0, self.w[:], self.v = np.float32(0), 0, np.where(self.seen[:, None], start, 0).astype(np.float32)
        return self._descend(rows, feats, y, self.seen, epochs, batch, rate, l2, seed)

    def _descend(self, rows: np.ndarray, feats: np.ndarray, y: np.ndarray, used: np.ndarray, epochs: int, batch: int, rate: float, l2: float, seed: int) -> FactorizationMachine:
        keep = used[feats]
        rows, feats = rows[keep], feats[keep]
        n, k = len(y), self.v.shape[1]
        bounds = np.searchsorted(rows, np.arange(n + 1))
        rng = np.random.default_rng(seed)
        # Balanced classes: each label has half of the weight.
        share = max(y.mean(), 1e-6)
        weight = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-6))
        gw, gv, g0 = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                docs = order[at : at + batch]
                sizes = bounds[docs + 1] - bounds[docs]
                r = np.repeat(np.arange(len(docs)), sizes)
                f = feats[np.repeat(bounds[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
                v = self.v[f]
                sums = np.stack([np.bincount(r, v[:, j], len(docs)) for j in range(k)], 1)
                raw = self.w0 + np.bincount(r, self.w[f], len(docs)) + 0.5 * (sums**2 - np.stack([np.bincount(r, v[:, j] ** 2, len(docs)) for j in range(k)], 1)).sum(1)
                err = (sigmoid(raw) - y[docs]) * weight[docs] / len(docs)
                g0 += err.sum() ** 2
                self.w0 -= np.float32(rate * err.sum() / np.sqrt(g0))
                u, inv = np.unique(f, return_inverse=True)
                dw = np.bincount(inv, err[r], len(u)) + l2 * self.w[u]
                each = err[r][:, None] * (sums[r] - v)
                dv = np.stack([np.bincount(inv, each[:, j], len(u)) for j in range(k)], 1) + l2 * self.v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                self.w[u] -= (rate * dw / np.sqrt(gw[u])).astype(np.float32)
                self.v[u] -= (rate * dv / np.sqrt(gv[u])).astype(np.float32)
        return self


def level(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The raw scores, moved so that their mean probability is the labels' mean."""
    lo, hi = -60.0, 60.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sigmoid(raw + mid).mean() < y.mean() else (lo, mid)
    return raw + lo


PAIR_BLOCK = 512  # columns of a block in which pairs are counted


def paired(rows: np.ndarray, feats: np.ndarray, y: np.ndarray, p: np.ndarray, usable: np.ndarray, least_z: float = 6.0, least_df: int = 30) -> np.ndarray:
    """Which features are in a pair whose documents' labels differ from the probabilities p by least_z standard errors, in sum.

    All pairs of usable features are judged, exactly. A pair's documents are some of those of either feature, so a feature of which no choice of
    documents comes to least_z (`most_z`) is in no such pair; the others are counted in all pairs, by products of blocks of columns, so memory is bounded.
    """
    off, var = y - p, p * (1 - p)
    usable = usable & (np.bincount(feats, minlength=len(usable)) >= least_df)
    keep = usable[feats]
    rows, feats = rows[keep], feats[keep]
    out = np.zeros(len(usable), bool)
    for sign in (1, -1):
        able = np.flatnonzero(most_z(rows, feats, sign * off, var, len(usable)) >= least_z * (1 - 1e-6))
        place = np.full(len(usable), -1)
        place[able] = np.arange(len(able))
        own = place[feats]
        order = np.argsort(own, kind="stable")
        docs, own = rows[order], own[order]

        def columns(lo: int, docs=docs, own=own, width=len(able)) -> np.ndarray:
            hi = min(lo + PAIR_BLOCK, width)
            x = np.zeros((len(y), hi - lo))
            at = slice(*np.searchsorted(own, [lo, hi]))
            x[docs[at], own[at] - lo] = 1
            return x

        for i in range(0, len(able), PAIR_BLOCK):
            a = columns(i).T
            for j in range(i, len(able), PAIR_BLOCK):
                b = columns(j)
                strong = (a @ b >= least_df) & (sign * (a @ (b * off[:, None])) >= least_z * np.sqrt(a @ (b * var[:, None]) + 0.25))
                if i == j:
                    np.fill_diagonal(strong, False)
                out[able[i : i + PAIR_BLOCK][strong.any(1)]] = True
                out[able[j : j + PAIR_BLOCK][strong.any(0)]] = True
    return out


def most_z(rows: np.ndarray, feats: np.ndarray, gain: np.ndarray, var: np.ndarray, n: int) -> np.ndarray:
    """For each of n features the most that sum(gain) / sqrt(sum(var) + 0.25) comes to over any choice of its documents.

    sum(gain) - z * sqrt(sum(var) + 0.25) is convex in both sums, so the best choice is a corner of their hull: the first documents by gain / var.
    """
    best = np.argsort(-gain / np.maximum(var, 1e-300), kind="stable")
    rank = np.empty(len(best), np.int64)
    rank[best] = np.arange(len(best))
    good = gain[rows] > 0
    keys = np.sort(feats[good] * len(best) + rank[rows[good]])
    out = np.zeros(n)
    if len(keys):
        of, docs = keys // len(best), best[keys % len(best)]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        sizes = np.diff(np.r_[starts, len(of)])
        sums = [np.cumsum(x[docs]) - np.repeat(np.cumsum(x[docs])[starts] - x[docs[starts]], sizes) for x in (gain, var)]
        out[of[starts]] = np.maximum.reduceat(sums[0] / np.sqrt(sums[1].clip(0) + 0.25), starts)
    return out


class TwoLayerNet:
    """tanh layer and a logistic output, on standardised inputs; Adam; a temperature fitted on rows kept apart from training."""

    def __init__(self, n_in: int, n_hidden: int = 24, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(0, 1 / np.sqrt(n_in), (n_in, n_hidden))
        self.ab = np.zeros(n_hidden)
        self.b = rng.normal(0, 1 / np.sqrt(n_hidden), n_hidden)
        self.bb = 0.0
        self.mean, self.scale, self.temperature = np.zeros(n_in), np.ones(n_in), 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.a + self.ab) @ self.b + self.bb

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)

    def fit(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray, epochs: int = 60, batch: int = 128, rate: float = 3e-3, l2: float = 1e-4, seed: int = 11) -> TwoLayerNet:
        """apart: which rows only set the temperature."""
        train = ~apart if apart.any() and (~apart).any() else np.ones(len(y), bool)
        xt, yt = x[train], y[train].astype(float)
        self.mean, self.scale = xt.mean(0), np.maximum(xt.std(0), 1e-4)
        z = np.clip((xt - self.mean) / self.scale, -8, 8)
        rng = np.random.default_rng(seed)
        names = ("a", "ab", "b", "bb")
        m = {k: np.zeros_like(np.asarray(getattr(self, k), float)) for k in names}
        s = {k: np.zeros_like(m[k]) for k in names}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(yt))
            for at in range(0, len(yt), batch):
                i = order[at : at + batch]
                h = np.tanh(z[i] @ self.a + self.ab)
                err = (sigmoid(h @ self.b + self.bb) - yt[i]) / len(i)
                back = err[:, None] * self.b[None] * (1 - h**2)
                grads = {"a": z[i].T @ back + l2 * self.a, "ab": back.sum(0), "b": h.T @ err + l2 * self.b, "bb": err.sum()}
                step += 1
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g**2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))
        check = apart if apart.any() else train
        raw, labels = self.logits(x[check]), y[check]
        loss = lambda t: -np.mean(np.where(labels > 0, np.log(sigmoid(raw / t) + 1e-12), np.log(1 - sigmoid(raw / t) + 1e-12)))
        self.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
        return self


class SoftmaxRegression:
    """Multinomial logistic regression over dense features, by full-batch gradient steps with momentum."""

    def __init__(self, n_in: int, n_classes: int):
        self.w = np.zeros((n_in, n_classes))
        self.b = np.zeros(n_classes)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.w + self.b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 1.0, l2: float = 1e-4) -> SoftmaxRegression:
        target = np.eye(self.w.shape[1])[y]
        share = np.maximum(target.mean(0), 1e-9)
        weight = (1 / (share * len(share)))[y][:, None] / len(y)
        vw, vb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(steps):
            err = (self.predict(x) - target) * weight
            vw = 0.9 * vw - rate * (x.T @ err + l2 * self.w)
            vb = 0.9 * vb - rate * err.sum(0)
            self.w += vw
            self.b += vb
        return self
