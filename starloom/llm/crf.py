"""Linear-chain conditional random field over categorical features, in numpy.

A position has a fixed number of slots, each naming one row of a weight table; its emission is
the sum of those rows. Sequences lie end to end, with their lengths beside them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # (rows, labels)
    moves: np.ndarray  # (labels, labels), from and to

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(slots), self.weights.shape[1]))
        for k in range(slots.shape[1]):
            out += self.weights[slots[:, k]]
        return out


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length; their starts; at each step how many are still going."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max()) if len(lengths) else 0
    going = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    return order, starts, going


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """The best labels of every sequence, all advanced together; ties go to the smaller label.

    first, last: what each label adds at a sequence's start and end.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    labels = np.zeros(len(emissions), dtype=np.int8)
    lengths, kept = lengths[lengths > 0], None
    if not len(lengths):
        return labels
    _, starts, going = _layout(lengths)
    ends = starts + np.sort(lengths)[::-1] - 1
    back = np.zeros(emissions.shape, dtype=np.int8)
    score = emissions[starts] + (0 if first is None else first)
    final = np.zeros_like(score)
    for t in range(1, len(going)):
        n = going[t]
        final[n : len(score)] = score[n:]
        step = score[:n, :, None] + moves
        at = starts[:n] + t
        back[at] = step.argmax(axis=1)
        score = step.max(axis=1) + emissions[at]
    final[: len(score)] = score
    kept = (final + (0 if last is None else last)).argmax(axis=1).astype(np.int8)
    labels[ends] = kept
    for t in range(len(going) - 1, 0, -1):
        at = starts[: going[t]] + t
        labels[at - 1] = back[at, labels[at]]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label probabilities of every position, expected moves, log partition sum over sequences."""
    _, starts, going = _layout(lengths)
    size = np.sort(lengths)[::-1]
    ahead, behind = np.zeros_like(emissions), np.zeros_like(emissions)
    ahead[starts] = emissions[starts]
    for t in range(1, len(going)):
        at = starts[: going[t]] + t
        ahead[at] = _log_sum(ahead[at - 1][:, :, None] + moves, 1) + emissions[at]
    whole = _log_sum(ahead[starts + size - 1], 1)
    expected = np.zeros_like(moves)
    for t in range(len(going) - 1, 0, -1):
        at = starts[: going[t]] + t
        right = emissions[at] + behind[at]
        behind[at - 1] = _log_sum(moves + right[:, None, :], 2)
        expected += np.exp(ahead[at - 1][:, :, None] + moves + right[:, None, :] - whole[: going[t], None, None]).sum(axis=0)
    of = np.zeros(len(emissions))
    for s, n, z in zip(starts, size, whole):
        of[s : s + n] = z
    return np.exp(ahead + behind - of[:, None]), expected, float(whole.sum())


def fit(slots: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rows: int, n_labels: int, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 3) -> Chain:
    """Maximum likelihood by Adam over batches of sequences; without any sequence all weights are 0."""
    chain = Chain(np.zeros((rows, n_labels)), np.zeros((n_labels, n_labels)))
    lengths = np.asarray(lengths, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    use = np.flatnonzero(lengths > 0)
    draw = np.random.default_rng(seed)
    moments = [np.zeros_like(x) for x in (chain.weights, chain.weights, chain.moves, chain.moves)]
    step = 0
    for _ in range(epochs):
        order = use[np.argsort(lengths[use] + draw.random(len(use)) * 8, kind="stable")]
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for g in draw.permutation(len(groups)):
            group = groups[g]
            at = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in group])
            own, gold = slots[at], labels[at]
            p, moved, _ = marginals(chain.emissions(own), lengths[group], chain.moves)
            p[np.arange(len(gold)), gold] -= 1
            inside = np.ones(len(gold), dtype=bool)
            inside[np.cumsum(lengths[group]) - lengths[group]] = False
            np.subtract.at(moved, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
            slope = np.zeros_like(chain.weights)
            for k in range(own.shape[1]):
                for y in range(n_labels):
                    slope[:, y] += np.bincount(own[:, k], weights=p[:, y], minlength=rows)
            step += 1
            for k, (value, g) in enumerate(((chain.weights, slope), (chain.moves, moved))):
                g = g / len(group) + decay * value
                moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * g
                moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * g * g
                value -= rate * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
    return chain
