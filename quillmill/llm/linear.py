"""Logistic regression over hashed character n-grams; used by the toxicity and quality scorers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLOCK = 256
BLOCK_CHARS = 200_000


@dataclass
class Features:
    """Which n-grams of a text are present, hashed into 2**bits columns."""

    lengths: tuple[int, ...]
    bits: int
    lower: bool = True

    def __post_init__(self):
        self._mark = None

    def __getstate__(self):
        return self.__dict__ | {"_mark": None}

    def present(self, text: str | None) -> np.ndarray:
        """Columns, each once. A long text is hashed in blocks of BLOCK_CHARS, so that memory stays bounded."""
        if self._mark is None:
            self._mark = np.zeros(1 << self.bits, np.int32)
        text = f" {(text or '').lower() if self.lower else text or ''} "
        blocks = [self._columns(text[at : at + BLOCK_CHARS + max(self.lengths) - 1], at + BLOCK_CHARS >= len(text)) for at in range(0, len(text), BLOCK_CHARS)]
        return self._once(np.concatenate(blocks)) if len(blocks) > 1 else blocks[0]

    def _columns(self, text: str, last: bool) -> np.ndarray:
        """Columns of the n-grams that begin in the text's first BLOCK_CHARS characters (if last, anywhere)."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = [np.empty(0, np.int64)]
        for n in self.lengths:
            own = c if last else c[: BLOCK_CHARS + n - 1]
            if len(own) >= n:
                h = np.full(len(own) - n + 1, np.uint64(n))
                for i in range(n):
                    h = h * P + own[i : i + len(h)]
                h = (h ^ (h >> np.uint64(31))) * MIX
                out.append((h >> np.uint64(64 - self.bits)).astype(np.int64))
        return self._once(np.concatenate(out))

    def _once(self, columns: np.ndarray) -> np.ndarray:
        place = np.arange(len(columns), dtype=np.int32)
        self._mark[columns] = place
        return columns[self._mark[columns] == place]


@dataclass
class LinearModel:
    """score = sigmoid(bias + scale(number of features) * sum of weights of the features present)."""

    features: Features
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        x = self.features.present(text)
        margin = self.bias + float(self.weights[x].sum(dtype=np.float64)) / max(1.0, len(x)) ** 0.5
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))


def constant(features: Features, score: float) -> LinearModel:
    """For want of two classes to tell apart."""
    return LinearModel(features, np.zeros(1 << features.bits, np.float32), float(np.log(score / (1 - score))))


def log_count_ratios(counts: np.ndarray, totals: tuple[float, float], least: int, slight: float) -> np.ndarray:
    """Naive Bayes: log of the share of a feature in class 1 over that in class 0, 0 for rare and for telltale-less ones."""
    share = (counts + 1) / (np.array(totals)[:, None] + 2)
    ratio = np.log(share[1] / share[0])
    ratio[(counts.sum(axis=0) < least) | (np.abs(ratio) < slight)] = 0.0
    return ratio


def fit(features: Features, texts: list[str], y: np.ndarray, *, naive_bayes: bool, rounds: int = 60, rate: float = 0.15, l2: float = 1e-3, least: int = 5, slight: float = 0.3) -> LinearModel:
    """Full-batch Adam on the mean log loss; both classes weigh the same. y: targets from 0 to 1."""
    y = np.asarray(y, np.float64)
    width = 1 << features.bits
    if not len(y) or y.sum() < 1e-9 or (1 - y).sum() < 1e-9:
        return constant(features, min(0.99, max(0.01, float(y.mean()) if len(y) else 0.01)))
    counts, norms = np.zeros((2, width)), np.empty(len(y))
    for i, (text, target) in enumerate(zip(texts, y, strict=True)):
        x = features.present(text)
        norms[i] = max(1, len(x)) ** -0.5
        counts[1, x] += target
        counts[0, x] += 1 - target
    ratio = log_count_ratios(counts, ((1 - y).sum(), y.sum()), least, slight) if naive_bayes else (counts.sum(axis=0) >= least).astype(np.float64)
    del counts
    # Only the columns that count are fitted; the rest has weight 0.
    used = np.flatnonzero(ratio)
    place = np.full(width, -1, np.int32)
    place[used] = np.arange(len(used))
    rows = [c[c >= 0] for c in (place[features.present(t)] for t in texts)]
    ratio, every, width = ratio[used], width, len(used)
    weight = y / y.sum() / 2 + (1 - y) / (1 - y).sum() / 2
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        grad, effective = np.zeros(width + 1), w * ratio
        for at in range(0, len(rows), BLOCK):
            some = rows[at : at + BLOCK]
            n = np.array([len(x) for x in some])
            flat = np.concatenate(some)
            of = np.repeat(np.arange(len(some)), n)
            margin = bias + np.bincount(of, weights=effective[flat], minlength=len(some)) * norms[at : at + BLOCK]
            pull = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - y[at : at + BLOCK]) * weight[at : at + BLOCK]
            grad[:width] += np.bincount(flat, weights=(pull * norms[at : at + BLOCK])[of], minlength=width)
            grad[width] += pull.sum()
        grad[:width] = grad[:width] * ratio + l2 * w / max(1, width) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:width]
        bias -= step[width]
    weights = np.zeros(every, np.float32)
    weights[used] = w * ratio
    return LinearModel(features, weights, float(bias))
