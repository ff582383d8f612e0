"""Losses of embedding batches with their gradients: cosine, contrastive and supervised contrastive, triplets.

Every loss is a function of the similarities inside one batch, so its gradient is a small matrix of
coefficients on pairs of rows; ``map_gradient`` turns the gradient by the projected rows into that of the linear map.
A loss returns (loss, gradient by the projected rows); None where the batch has nothing to learn from.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from handful.operators.losses import MARGIN, TEMPERATURE

# Fixed value: margin of the losses on labelled pairs.
PAIR_MARGIN = 0.5

Found = tuple[float, np.ndarray] | None


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x / size, size


def _through_units(x: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Gradient by the rows x from that by their unit vectors."""
    unit, size = _units(x)
    return (pull - (pull * unit).sum(axis=1, keepdims=True) * unit) / size


def supcon(x: np.ndarray, labels: np.ndarray, temperature: float = TEMPERATURE, **_) -> Found:
    """Mean over anchors of -log softmax on the rows of their label; anchors alone with their label are left out."""
    unit, _size = _units(x)
    scores = unit @ unit.T / temperature
    np.fill_diagonal(scores, -np.inf)
    same = labels[:, None] == labels[None, :]
    np.fill_diagonal(same, False)
    n = same.sum(axis=1, keepdims=True)
    used = n[:, 0] > 0
    if not used.any():
        return None
    top = scores.max(axis=1, keepdims=True)
    grown = np.exp(scores - top)
    total = grown.sum(axis=1, keepdims=True)
    logs = np.where(same, scores - top - np.log(total), 0.0).sum(axis=1)
    loss = float((-logs[used] / n[used, 0]).mean())
    by_score = np.where(used[:, None], grown / total - same / np.maximum(n, 1), 0.0) / used.sum()
    return loss, _through_units(x, (by_score + by_score.T) @ unit / temperature)


def distance_gradient(x: np.ndarray, by_distance: np.ndarray, distances: np.ndarray, metric: str) -> np.ndarray:
    """Gradient by the rows from that by the (ordered) distances between them."""
    both = by_distance + by_distance.T
    if metric == "cosine":
        return _through_units(x, -both @ _units(x)[0])
    share = np.divide(both, distances, out=np.zeros_like(both), where=distances > 0)
    return share.sum(axis=1, keepdims=True) * x - share @ x


def _distances(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        unit, _ = _units(x)
        return 1.0 - unit @ unit.T
    if metric != "euclidean":
        raise ValueError("metric is 'cosine' or 'euclidean'")
    # From differences, so that near and equal rows keep their digits.
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def triplets(mode: str) -> Callable[..., Found]:
    """Triplet loss by one rule of ``losses.mine_triplets``, mined anew on the given rows."""

    def loss(x: np.ndarray, labels: np.ndarray, metric: str = "cosine", margin: float = MARGIN, **_) -> Found:
        d = _distances(x, metric)
        m = len(x)
        other = labels[:, None] != labels[None, :]
        same = ~other & ~np.eye(m, dtype=bool)
        valid = same.any(axis=1) & other.any(axis=1)
        if not valid.any():
            return None
        by_distance = np.zeros((m, m))
        if mode in ("hard", "hard_soft_margin"):
            anchor = np.flatnonzero(valid)
            far = np.where(same, d, -np.inf).argmax(axis=1)[anchor]
            near = np.where(other, d, np.inf).argmin(axis=1)[anchor]
            gap = d[anchor, far] - d[anchor, near]
            if mode == "hard_soft_margin":
                values, slope = np.logaddexp(0.0, gap), 1.0 / (1.0 + np.exp(-gap))
            else:
                values = np.maximum(gap + margin, 0.0)
                slope = (values > 0).astype(float)
            np.add.at(by_distance, (anchor, far), slope / len(anchor))
            np.add.at(by_distance, (anchor, near), -slope / len(anchor))
            return float(values.mean()), distance_gradient(x, by_distance, d, metric)
        if mode == "semi_hard":
            a, p = np.nonzero(same & valid[:, None])
            beyond = np.where(other[a] & (d[a] > d[a, p][:, None]), d[a], np.inf)
            near, far = beyond.argmin(axis=1), np.where(other[a], d[a], -np.inf).argmax(axis=1)
            negative = np.where(np.isinf(beyond.min(axis=1)), far, near)
            values = np.maximum(d[a, p] - d[a, negative] + margin, 0.0)
            slope = (values > 0) / len(a)
            np.add.at(by_distance, (a, p), slope)
            np.add.at(by_distance, (a, negative), -slope)
            return float(values.mean()), distance_gradient(x, by_distance, d, metric)
        # All triplets, anchor by anchor in one array of m^3 numbers; a batch is small.
        gaps = d[:, :, None] - d[:, None, :] + margin
        values = np.where(same[:, :, None] & other[:, None, :], np.maximum(gaps, 0.0), 0.0)
        live = values > 1e-16
        n = int(live.sum())
        if not n:
            return 0.0, np.zeros_like(x)
        by_distance = (live.sum(axis=2) - live.sum(axis=1)) / n
        return float(values.sum() / n), distance_gradient(x, by_distance, d, metric)

    return loss


BATCH_LOSSES: dict[str, Callable[..., Found]] = {
    "supcon": supcon,
    "batch_hard": triplets("hard"),
    "batch_hard_soft_margin": triplets("hard_soft_margin"),
    "batch_semi_hard": triplets("semi_hard"),
    "batch_all": triplets("all"),
}

PairFound = tuple[float, np.ndarray, np.ndarray]


def _pair_distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 1.0 - (_units(u)[0] * _units(v)[0]).sum(axis=1)


def _pair_gradients(u: np.ndarray, v: np.ndarray, by_cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pull = by_cosine[:, None]
    return _through_units(u, pull * _units(v)[0]), _through_units(v, pull * _units(u)[0])


def cosine_pairs(u: np.ndarray, v: np.ndarray, y: np.ndarray, **_) -> PairFound:
    """Mean squared difference of the cosine and the label."""
    off = (1.0 - _pair_distances(u, v)) - y
    return float((off**2).mean()), *_pair_gradients(u, v, 2.0 * off / len(y))


def contrastive_pairs_loss(u: np.ndarray, v: np.ndarray, y: np.ndarray, margin: float = PAIR_MARGIN, **_) -> PairFound:
    """Half the squared distance of pairs labelled 1, and half the squared lack of distance of the others."""
    d = _pair_distances(u, v)
    lack = np.maximum(margin - d, 0.0)
    values = 0.5 * (y * d**2 + (1 - y) * lack**2)
    return float(values.mean()), *_pair_gradients(u, v, (-y * d + (1 - y) * lack) / len(y))


def online_contrastive(u: np.ndarray, v: np.ndarray, y: np.ndarray, margin: float = PAIR_MARGIN, **_) -> PairFound:
    """The same (not halved, summed) over the hard pairs of the batch alone.

    Hard are pairs labelled 1 farther apart than the nearest other pair, and other pairs nearer than the farthest
    pair labelled 1; with one such pair or none to compare with, those beyond the mean of their own kind.
    """
    d = _pair_distances(u, v)
    one, zero = y > 0.5, y <= 0.5
    far = d[one].max() if one.sum() > 1 else (d[zero].mean() if zero.any() else -np.inf)
    near = d[zero].min() if zero.sum() > 1 else (d[one].mean() if one.any() else np.inf)
    pull, push = one & (d > near), zero & (d < far)
    lack = np.where(push, np.maximum(margin - d, 0.0), 0.0)
    loss = float((d[pull] ** 2).sum() + (lack**2).sum())
    return loss, *_pair_gradients(u, v, np.where(pull, -2.0 * d, 2.0 * lack))


PAIR_LOSSES: dict[str, Callable[..., PairFound]] = {
    "cosine": cosine_pairs,
    "contrastive": contrastive_pairs_loss,
    "online_contrastive": online_contrastive,
}


def step_share(step: int, total: int, warmup: float) -> float:
    """Share of the learning rate at an update: rising from 0 over the warm-up, then falling evenly to 0."""
    rising = int(np.ceil(total * warmup))
    if step < rising:
        return step / max(rising, 1)
    return max(0.0, (total - step) / max(total - rising, 1))
