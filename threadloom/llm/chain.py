"""A linear-chain conditional random field over outside, begin and inside, for many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
#: Runs up to this length are decoded side by side, longer ones each by itself.
SIDE_BY_SIDE = 256


@dataclass(eq=False)
class Chain:
    """Weights of features by tag, and of pairs of neighbouring tags. No inside starts a sequence or follows an outside."""

    unary: np.ndarray  # feature, tag
    pair: np.ndarray  # tag, next tag

    def best(self, scores: np.ndarray) -> list[int]:
        """The best sequence of tags by Viterbi's algorithm, by each position's scores."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.pair.tolist()
        rows = iter(scores.tolist())
        o, b, _ = next(rows)
        i, back = -1e9, []
        for so, sb, si in rows:
            to_o, to_b = (0, o + oo), (0, o + ob)
            if b + bo > to_o[1]:
                to_o = (1, b + bo)
            if i + io > to_o[1]:
                to_o = (2, i + io)
            if b + bb > to_b[1]:
                to_b = (1, b + bb)
            if i + ib > to_b[1]:
                to_b = (2, i + ib)
            to_i = (1, b + bi) if b + bi >= i + ii else (2, i + ii)
            back.append((to_o[0], to_b[0], to_i[0]))
            o, b, i = to_o[1] + so, to_b[1] + sb, to_i[1] + si
        tags = [int(np.argmax((o, b, i)))]
        for x in reversed(back):
            tags.append(x[tags[-1]])
        return tags[::-1]

    def decode(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tags of sequences in a row, each beginning at one of `starts`; Viterbi's algorithm on the runs left open.

        Where outside is better by more than three changed pairs can cost, and by what the next token loses if it
        has to begin instead of going on, no best sequence has another tag. The runs between are decoded.
        """
        n = len(scores)
        tags = np.full(n, OUTSIDE, np.int8)
        if not n:
            return tags
        first = np.zeros(n, bool)
        first[starts[starts < n]] = True
        last = np.append(first[1:], True)
        bound = np.delete(self.pair.reshape(-1), OUTSIDE * 3 + INSIDE)
        spread = 3 * (max(bound.max(), 0) - min(bound.min(), 0))
        lost = np.where(last, 0, np.append(np.maximum(scores[1:, INSIDE] - scores[1:, BEGIN], 0), 0))
        open_ = scores[:, OUTSIDE] - scores[:, BEGIN:].max(axis=1) <= spread + lost + 1e-9
        begin = np.nonzero(open_ & (first | ~np.append(False, open_[:-1])))[0]
        end = np.nonzero(open_ & (last | ~np.append(open_[1:], False)))[0] + 1
        if not len(begin):
            return tags
        s = np.where(open_[:, None], scores, 0)
        barred = np.where(np.arange(3) == INSIDE, -1e9, self.pair[OUTSIDE])
        s[begin] += np.where(first[begin, None], np.where(np.arange(3) == INSIDE, -1e9, 0), barred)
        s[end - 1] += np.where(last[end - 1, None], 0, self.pair[:, OUTSIDE])
        size = end - begin
        for k in np.nonzero(size > SIDE_BY_SIDE)[0]:
            tags[begin[k] : end[k]] = self.best(s[begin[k] : end[k]])
        short = np.nonzero(size <= SIDE_BY_SIDE)[0]
        short = short[np.argsort(-size[short], kind="stable")]
        begin, size = begin[short], size[short]
        if not len(begin):
            return tags
        pair = self.pair.copy()
        pair[OUTSIDE, INSIDE] = -1e9
        v, back = s[begin], []
        for t in range(1, int(size[0])):
            m = int(np.searchsorted(-size, -t))  # runs longer than t
            ways = v[:m, :, None] + pair
            back.append(ways.argmax(axis=1).astype(np.int8))
            v[:m] = ways.max(axis=1) + s[begin[:m] + t]
        tag = v.argmax(axis=1)
        tags[begin + size - 1] = tag
        for t in range(int(size[0]) - 1, 0, -1):
            m = int(np.searchsorted(-size, -t))
            tag[:m] = back[t - 1][np.arange(m), tag[:m]]
            tags[begin[:m] + t - 1] = tag[:m]
        return tags

    def gradient(self, scores: np.ndarray, tags: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of tags (step, sequence), each position's error (expected less true), and the pairs' error.

        scores: (step, sequence, tag); a sequence has so many steps as `sizes` says, what is beyond doesn't count.
        """
        steps, n, _ = scores.shape
        there = np.arange(steps)[:, None] < sizes
        top = scores.max(axis=2)
        e, pair = np.exp(scores - top[:, :, None]), np.exp(self.pair)
        pair[OUTSIDE, INSIDE] = 0
        e[0, :, INSIDE] = 0
        a, b, size = np.zeros_like(e), np.ones_like(e), np.ones((steps, n))
        for t in range(steps):
            a[t] = e[0] if t == 0 else (a[t - 1] @ pair) * e[t]
            size[t] = a[t].sum(axis=1)
            a[t] /= size[t][:, None]
        for t in range(steps - 2, -1, -1):
            b[t] = np.where(there[t + 1][:, None], (e[t + 1] * b[t + 1]) @ pair.T / size[t + 1][:, None], 1)
        one = a * b * there[:, :, None]
        later = np.where(there[1:, :, None], e[1:] * b[1:] / size[1:, :, None], 0)
        two = pair * (a[:-1].reshape(-1, 3).T @ later.reshape(-1, 3))
        at = np.nonzero(there)
        value = scores[(*at, tags[at])].sum() - (top + np.log(size))[at].sum()
        pairs = there[1:]
        value += self.pair[tags[:-1][pairs], tags[1:][pairs]].sum()
        np.subtract.at(two, (tags[:-1][pairs], tags[1:][pairs]), 1)
        one[(*at, tags[at])] -= 1
        return float(value), one, two
