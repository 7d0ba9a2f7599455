"""A gated recurrent language model over words in numpy: an update-gated unit and a softmax factored by classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Hidden units, classes of words and words of a class.
HIDDEN, CLASSES, CLASS_WORDS = 16, 64, 64
#: Steps of a window in training (gradients stop at its start) and in scoring; streams that are trained side by side.
TRAIN_WINDOW, SCORE_WINDOW, STREAMS = 16, 256, 256
#: Windows of each stream that fewer streams are taken for where texts are few.
TRAIN_STEPS = 200
#: Places on the second half of the way whose weights are averaged.
AVERAGED = 16
STEP = 0.2
#: The largest logit, the least sum of exponentials, and a vector that sums rows.
TOP, TINY, ONES = np.float32(60), np.float32(1e-30), np.ones(CLASSES + CLASS_WORDS, np.float32)


@dataclass
class Model:
    """Symbols are the words by falling count, CLASS_WORDS of them a class, then END and UNKNOWN, a class each.

    The state starts at zero with END as the first input. Each step takes the last symbol, and the state gives the
    next symbol's class and, within it, the word.
    """

    enter: np.ndarray  # symbol, gate and proposal
    recur: np.ndarray  # hidden, gate and proposal
    classes: np.ndarray  # hidden, class
    class_bias: np.ndarray
    words: np.ndarray  # class, hidden, word
    word_bias: np.ndarray  # class, word
    #: Times that an unknown target counts: words that training texts don't hold are to come as well.
    unknown_weight: float = 1.0

    @classmethod
    def new(cls, counts: np.ndarray, ends: float, unknown: float) -> Model:
        """At the start the biases hold the symbols' frequencies, so that the model begins as a unigram model."""
        rng = np.random.default_rng(21)
        size = CLASSES * CLASS_WORDS
        c = np.zeros(size)
        c[: len(counts)] = counts
        c = c.reshape(CLASSES, CLASS_WORDS)
        mass = np.append(c.sum(axis=1), [ends, unknown])
        with np.errstate(divide="ignore"):
            word_bias = np.where(c > 0, np.log(c), -1e4)
            class_bias = np.where(np.append(c.sum(axis=1) > 0, [True, True]), np.log(mass + 0.5), -1e4)
        n = size + 2
        return cls(
            rng.normal(0, 0.3, (n, 2 * HIDDEN)).astype(np.float32), rng.normal(0, 0.2, (HIDDEN, 2 * HIDDEN)).astype(np.float32),
            np.zeros((HIDDEN, CLASSES + 2), np.float32), (class_bias - np.log(mass.sum() + 1)).astype(np.float32),
            np.zeros((CLASSES, HIDDEN, CLASS_WORDS), np.float32), word_bias.astype(np.float32),
        )

    @property
    def end(self) -> int:
        return len(self.enter) - 2

    @property
    def unknown(self) -> int:
        return len(self.enter) - 1

    def tables(self) -> list[np.ndarray]:
        return [self.enter, self.recur, self.classes, self.class_bias, self.words, self.word_bias]

    def step(self, symbols: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next state, with the gate and the proposal that made it."""
        a = np.take(self.enter, symbols, axis=0)
        a += h @ self.recur
        a[:, :HIDDEN] *= 0.5
        np.tanh(a, out=a)
        keep, new = 0.5 + 0.5 * a[:, :HIDDEN], a[:, HIDDEN:]
        out = h - new
        out *= keep
        out += new
        return out, keep, new

    def log_odds(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability after each state."""
        out = np.empty(len(symbols), np.float32)
        order = np.argsort(symbols, kind="stable")
        ends = np.searchsorted(symbols, np.arange(CLASSES + 1) * CLASS_WORDS, sorter=order)
        for at in range(0, len(order), 16384):
            own = order[at : at + 16384]
            z = states[own] @ self.classes
            z += self.class_bias
            out[own] = chosen_log(z, self.class_of(symbols[own]))
        for at in range(0, ends[-1], 16384):
            own = order[at : min(at + 16384, ends[-1])]
            h, of_class = states[own], symbols[own] // CLASS_WORDS
            z = np.empty((len(own), CLASS_WORDS), h.dtype)
            cut = np.searchsorted(of_class, np.arange(CLASSES + 1))
            for c in np.nonzero(np.diff(cut))[0].tolist():
                np.matmul(h[cut[c] : cut[c + 1]], self.words[c], out=z[cut[c] : cut[c + 1]])
            z += self.word_bias[of_class]
            out[own] += chosen_log(z, symbols[own] - of_class * CLASS_WORDS)
        return out

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.end, symbols // CLASS_WORDS, CLASSES + symbols - self.end)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of each text's probability; a text is its symbols, END last.

        Texts step side by side, the longest first; after each window of steps its states are scored and dropped, and
        the last state goes on, so that a text of any length takes the room of a window.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        total = np.zeros(len(texts))
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.zeros(0, np.int64)
        sizes = sizes[order]
        start = np.append(0, np.cumsum(sizes))[:-1]
        h = np.zeros((len(texts), HIDDEN), np.float32)
        last = np.full(len(texts), self.end)
        for t0 in range(0, int(sizes.max(initial=0)), SCORE_WINDOW):
            states, where, owner = [], [], []
            for t in range(t0, t0 + SCORE_WINDOW):
                n = int(np.searchsorted(-sizes, -t))  # texts longer than t
                if not n:
                    break
                h = self.step(last[:n], h[:n])[0]
                states.append(h)
                at = start[:n] + t
                where.append(at)
                owner.append(n)
                last = flat[at]
            odds = self.log_odds(np.concatenate(states), flat[np.concatenate(where)])
            at = 0
            for n in owner:
                total[:n] += odds[at : at + n]
                at += n
        out = np.empty(len(texts))
        out[order] = total
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, list, np.ndarray]:
        """Loss of a window (step, stream), its gradients, and the state after it. A state is zero where END comes in.

        Gradients of tables are (rows, values) for the rows that were used.
        """
        steps, streams = inputs.shape
        olds, keeps, news, outs = [], [], [], []
        goes_on = (inputs != self.end).astype(self.recur.dtype)[:, :, None]
        for t in range(steps):
            h = h * goes_on[t]
            olds.append(h)
            h, keep, new = self.step(inputs[t], h)
            keeps.append(keep)
            news.append(new)
            outs.append(h)
        y = targets.reshape(-1)
        # In the order of targets, those of a class lie together.
        order = np.argsort(y, kind="stable")
        s, y = np.concatenate(outs)[order], y[order]
        z = s @ self.classes
        z += self.class_bias
        loss = -errors(z, self.class_of(y))
        z[np.searchsorted(y, self.unknown) :] *= np.float32(self.unknown_weight)
        g_classes, g_class_bias, back = s.T @ z, z.sum(axis=0), z @ self.classes.T
        ends = np.searchsorted(y, np.arange(CLASSES + 1) * CLASS_WORDS)
        used = np.nonzero(np.diff(ends))[0]
        g_words = np.empty((len(used), *self.words.shape[1:]), s.dtype)
        z = np.empty((ends[-1], CLASS_WORDS), s.dtype)
        for c in used.tolist():
            np.matmul(s[ends[c] : ends[c + 1]], self.words[c], out=z[ends[c] : ends[c + 1]])
        of_class = y[: ends[-1]] // CLASS_WORDS
        z += self.word_bias[of_class]
        loss -= errors(z, y[: ends[-1]] - of_class * CLASS_WORDS)
        for k, c in enumerate(used.tolist()):
            own = slice(ends[c], ends[c + 1])
            np.matmul(s[own].T, z[own], out=g_words[k])
            back[own] += z[own] @ self.words[c].T
        g_bias = np.add.reduceat(z, ends[used], axis=0) if len(used) else np.empty((0, CLASS_WORDS), np.float32)
        placed = np.empty_like(back)
        placed[order] = back
        back = placed.reshape(steps, streams, HIDDEN)
        g_enter = np.empty((steps, streams, 2 * HIDDEN), s.dtype)
        later, turned = np.zeros((streams, HIDDEN), np.float32), np.ascontiguousarray(self.recur.T)
        for t in range(steps - 1, -1, -1):
            g, keep, a = back[t], keeps[t], g_enter[t]
            g += later
            carried = g * keep
            g -= carried  # by the proposal
            a[:, HIDDEN:] = g * (1 - news[t] * news[t])
            a[:, :HIDDEN] = g * keep * (olds[t] - news[t])
            later = a @ turned
            later += carried
            later *= goes_on[t]
        g_recur = np.concatenate(olds).T @ g_enter.reshape(-1, 2 * HIDDEN)
        x = inputs.reshape(-1)
        order = np.argsort(x, kind="stable")
        first = np.nonzero(np.append(True, np.diff(x[order]) > 0))[0]
        summed = np.add.reduceat(g_enter.reshape(-1, 2 * HIDDEN)[order], first, axis=0)
        every = slice(None)
        return loss, [(x[order[first]], summed), (every, g_recur), (every, g_classes), (every, g_class_bias), (used, g_words), (used, g_bias)], h

    def train(self, symbols: np.ndarray, passes: int = 1) -> list[np.ndarray]:
        """Passes over texts in a row, cut into streams, by steps that adapt to each weight (Adagrad).

        Returns how often each first row of each table was used.
        """
        used = [np.zeros(len(t)) for t in self.tables()]
        streams = max(1, min(STREAMS, len(symbols) // (TRAIN_WINDOW * TRAIN_STEPS)))
        length = len(symbols) // streams
        y = symbols[: length * streams].reshape(streams, length).T
        x = np.concatenate([np.full((1, streams), self.end), y[:-1]]) if length else y
        squares = [np.full_like(t, 1e-2) for t in self.tables()]
        starts = list(range(0, length, TRAIN_WINDOW)) * passes
        # The mean of the weights over the second half of the way is less noisy than where it ends.
        stops = set(np.linspace(len(starts) // 2, len(starts) - 1, AVERAGED).astype(int).tolist()) if starts else set()
        means = [np.zeros(t.shape) for t in self.tables()]
        for step, at in enumerate(starts):
            if at == 0:
                h = np.zeros((streams, HIDDEN), np.float32)
            n = y[at : at + TRAIN_WINDOW].size
            _, grads, h = self.gradients(x[at : at + TRAIN_WINDOW], y[at : at + TRAIN_WINDOW], h)
            for table, square, count, (rows, g) in zip(self.tables(), squares, used, grads, strict=True):
                g = g * np.float32(n**-0.5)
                square[rows] += g * g
                table[rows] -= STEP * g / np.sqrt(square[rows] + 1)
                count[rows] += 1
            if step in stops:
                for mean, table in zip(means, self.tables(), strict=True):
                    mean += table / len(stops)
        if stops:
            for mean, table in zip(means, self.tables(), strict=True):
                table[...] = mean
        return used


def chosen_log(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row at one place. Logits are sums of few bounded terms, so they need no shift."""
    np.minimum(z, TOP, out=z)
    own = z[np.arange(len(z)), chosen]
    np.exp(z, out=z)
    return own - np.log(np.maximum(z @ ONES[: z.shape[1]], TINY))


def errors(z: np.ndarray, chosen: np.ndarray) -> float:
    """Turns rows into their softmax less one at the chosen place; the sum of the logarithms at these places."""
    np.minimum(z, TOP, out=z)
    np.exp(z, out=z)
    z /= np.maximum(z @ ONES[: z.shape[1]], TINY)[:, None]
    at = np.arange(len(z)), chosen
    out = float(np.log(np.maximum(z[at], TINY)).sum())
    z[at] -= 1
    return out
