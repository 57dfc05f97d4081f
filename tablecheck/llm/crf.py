"""Linear-chain conditional random fields over ragged batches of sequences, in numpy.

Sequences lie one after another: `em` holds a row of scores for each position, `lens` the length of each
sequence. All sequences advance together, longest first, so a step costs one small matrix product however many
sequences are still active. Sequences of length 0 are allowed.
"""

from __future__ import annotations

import numpy as np


def _plan(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each sequence, longest first, and how many are active at each step."""
    order = np.argsort(-lens, kind="stable")
    by_length = lens[order]
    starts = (np.cumsum(lens) - lens)[order]
    steps = int(by_length[0]) if len(by_length) else 0
    return starts, np.searchsorted(-by_length, -np.arange(steps), side="left")


def _by_step(lens: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each position lies when positions of one step stand together, longest sequence first; where steps start."""
    rank = np.empty(len(lens), np.int64)
    rank[np.argsort(-lens, kind="stable")] = np.arange(len(lens))
    first = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    return first[step] + np.repeat(rank, lens), first


def forward_backward(em: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of each label at each position, the log partition summed, expected transition counts."""
    _, active = _plan(lens)
    place, first = _by_step(lens, active)
    top = em.max(axis=1, keepdims=True) if len(em) else em[:, :1]
    w, move = np.empty_like(em), np.exp(trans)
    w[place] = np.exp(em - top)
    alpha, scale = np.empty_like(w), np.empty(len(w))
    bounds = first.tolist()
    a = np.exp(start)[None, :]
    for t in range(len(active)):
        lo, hi = bounds[t], bounds[t + 1]
        a = (a[: hi - lo] @ move if t else a) * w[lo:hi]
        s = a.sum(axis=1)
        a /= s[:, None]
        alpha[lo:hi], scale[lo:hi] = a, s
    w /= scale[:, None]
    pairs, back = np.zeros_like(move), move.T.copy()
    beta = np.ones((int(active[0]) if len(active) else 0, em.shape[1]))
    for t in range(len(active) - 1, -1, -1):
        lo, hi = bounds[t], bounds[t + 1]
        if t + 1 < len(active):
            m = bounds[t + 2] - hi
            ahead = beta[:m] * w[hi : hi + m]
            pairs += alpha[lo : lo + m].T @ ahead
            beta[:m] = ahead @ back
        alpha[lo:hi] *= beta[: hi - lo]  # alpha of this step has been read for the last time
    post = alpha[place]
    post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
    return post, float(np.log(scale).sum() + top.sum()), pairs * move


def viterbi(em: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of each position; ties go to the smaller label."""
    starts, active = _plan(lens)
    back = np.zeros(em.shape, np.int8)
    score = np.zeros((len(starts), em.shape[1]))
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t == 0:
            score[:n] = em[at] + start
            continue
        options = score[:n, :, None] + trans
        back[at] = options.argmax(axis=1)
        score[:n] = options.max(axis=1) + em[at]
    labels = np.zeros(len(em), np.int8)
    now = np.zeros(len(starts), np.int64)
    for t in range(len(active) - 1, -1, -1):
        n, m = active[t], active[t + 1] if t + 1 < len(active) else 0
        at = starts[:n] + t
        now[m:n] = score[m:n].argmax(axis=1)
        if m:
            now[:m] = back[at[:m] + 1, now[:m]]
        labels[at] = now[:n]
    return labels


def loss_and_gradient(em: np.ndarray, lens: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Negative log likelihood a position, with gradients for em, trans and start."""
    k, n = em.shape[1], max(1, len(em))
    post, logz, pairs = forward_backward(em, lens, trans, start)
    ends = np.cumsum(lens)
    firsts = (ends - lens)[lens > 0]
    inner = np.ones(len(em), bool)
    inner[firsts] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(gold[at - 1] * k + gold[at], minlength=k * k).reshape(k, k)
    value = logz - em[np.arange(len(em)), gold].sum() - (seen * trans).sum() - start[gold[firsts]].sum()
    d_em = post.copy()
    d_em[np.arange(len(em)), gold] -= 1
    d_start = post[firsts].sum(axis=0) - np.bincount(gold[firsts], minlength=k)
    return value / n, d_em / n, (pairs - seen) / n, d_start / n
