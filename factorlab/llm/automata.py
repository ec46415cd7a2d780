"""Probabilistic automata of credential formats, inferred from labelled examples.

The examples' prefix tree is folded level by level: two states of a level are merged if, at every distance
ahead, the distribution of the symbol that far ahead is the same within Hoeffding's bound. Random keys leave
one example a branch after a few symbols, so branches are compared by all their examples together. States of
different levels stay apart, so an automaton knows at which place a format has which symbols and where it ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Symbols: the bytes of a credential one by one, and the end.
CHARS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
END, SYMBOLS = len(CHARS), len(CHARS) + 1
SYMBOL = np.zeros(256, np.int16)
SYMBOL[list(CHARS)] = np.arange(len(CHARS))
#: Classes that share the probability of unseen symbols; a mark and the end are a class each.
_CLASSES = (b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", b"0123456789", *(bytes([m]) for m in b"+/_.=-"))
_MEMBER = np.zeros((len(_CLASSES) + 1, SYMBOLS))
for _k, _bytes in enumerate(_CLASSES):
    _MEMBER[_k, SYMBOL[list(_bytes)]] = 1
_MEMBER[-1, END] = 1
#: Levels with states of their own; what a longer word has beyond them is one state that loops.
LEVELS = 128
#: Risks of Hoeffding's bound that are tried; the one under which held-out words are likeliest is taken.
RISKS = (0.5, 0.05, 0.005, 0.0005)
#: How far under the lowest hundredth of held-out words a word's mean log probability may lie.
SLACK = 0.5
#: Log probability of a symbol beyond the end of every known word.
LOST = float(np.log(1e-3))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the symbols a row. What unseen symbols get grows with the number of different symbols
    seen (Witten and Bell) and is shared by class as seen, evenly inside a class."""
    n, kinds = counts.sum(1, keepdims=True), np.maximum((counts > 0).sum(1, keepdims=True), 1)
    by_class = (counts @ _MEMBER.T + 0.05) / (n + 0.05 * len(_MEMBER))
    return np.log((counts + kinds * (by_class / _MEMBER.sum(1)) @ _MEMBER) / (n + kinds))


@dataclass
class Automaton:
    """Per state the log probabilities and targets of the symbols. The last state is that of lost words."""

    log: np.ndarray
    to: np.ndarray
    loop: int
    least: float = 0.0  # mean log probability of a symbol that a word of a known format reaches

    def scores(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability of each word symbols[start:end] with its end."""
        total, state, size = np.zeros(len(starts)), np.zeros(len(starts), np.int64), ends - starts
        on = np.arange(len(starts))
        for level in range(LEVELS):
            more = size[on] > level
            a = np.where(more, symbols[np.minimum(starts[on] + level, ends[on] - 1)], END)
            total[on] += self.log[state[on], a]
            state[on] = self.to[state[on], a]
            on = on[more]
            if not len(on):
                return total
        for q in np.unique(state[on]):
            sums = np.concatenate([[0.0], np.cumsum(self.log[q][symbols])])
            x = on[state[on] == q]
            total[x] += sums[ends[x]] - sums[starts[x] + LEVELS] + self.log[q, END]
        return total


def inferred(words: list[bytes], risk: float) -> Automaton:
    """The automaton of the words; the order of the words doesn't matter."""
    words = sorted(words)
    rows = np.full((len(words), LEVELS + 1), -1, np.int64)  # symbols by level, END after the last
    beyond = np.zeros(SYMBOLS)
    for i, w in enumerate(words):
        s = np.append(SYMBOL[np.frombuffer(w, np.uint8)], END)
        rows[i, : min(len(s), LEVELS)] = s[:LEVELS]
        beyond += np.bincount(s[LEVELS:], minlength=SYMBOLS)
    bound = np.sqrt(0.5 * np.log(2 / risk))
    counts, target, state, on, first = [], [], np.zeros(len(words), np.int64), np.arange(len(words)), 0
    for level in range(LEVELS):
        k = int(state.max(initial=0)) + 1
        a = rows[on, level]
        counts.append(np.bincount(state * SYMBOLS + a, minlength=k * SYMBOLS).reshape(k, SYMBOLS))
        target.append(np.full((k, SYMBOLS), -1))
        going = a != END
        branch, of = np.unique(state[going] * SYMBOLS + a[going], return_inverse=True)
        on = on[going]
        if not len(on):
            break
        first += k
        if level == LEVELS - 1:
            target[-1].reshape(-1)[branch] = first
            break
        merged, of_branch = merge(rows[on, level + 1 :], of, len(branch), bound)
        target[-1].reshape(-1)[branch] = first + of_branch
        state = merged
    counts, target = np.concatenate(counts), np.concatenate(target)
    loop = len(counts)
    counts, target = np.concatenate([counts, beyond[None], np.zeros((1, SYMBOLS))]), np.concatenate([target, np.full((1, SYMBOLS), loop), np.full((1, SYMBOLS), loop + 1)])
    log = smoothed(counts)
    log[-1] = LOST
    for q in range(loop):  # an unseen symbol goes on as most of its class do, else as most symbols do
        by_target = {}
        for a in np.flatnonzero(target[q] >= 0):
            for key in (int(_MEMBER[:, a].argmax()), -1):
                by_target.setdefault(key, {}).setdefault(int(target[q, a]), []).append(int(counts[q, a]))
        best = {key: max(t, key=lambda z, t=t: (sum(t[z]), -z)) for key, t in by_target.items()}
        for a in np.flatnonzero(target[q] < 0):
            target[q, a] = best.get(int(_MEMBER[:, a].argmax()), best.get(-1, loop + 1))
    return Automaton(log, target, loop)


def merge(ahead: np.ndarray, of: np.ndarray, branches: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """The state of each word and of each branch, from the words' symbols ahead and the branch each word took."""
    ahead = ahead[:, : int((ahead >= 0).any(0).sum())]
    there = ahead >= 0
    reach = ahead.shape[1]
    cell = (of[:, None] * reach + np.arange(reach)) * SYMBOLS + ahead
    seen = np.bincount(cell[there], minlength=branches * reach * SYMBOLS).reshape(branches, -1).astype(np.float32)
    n = np.bincount(of, minlength=branches)
    states, size, out = np.zeros((0, seen.shape[1]), np.float32), np.zeros(0), np.zeros(branches, np.int64)
    for b in np.lexsort((np.arange(branches), -n)):  # the largest first
        apart = np.abs(states / size[:, None] - seen[b] / n[b]).max(1) if len(size) else np.zeros(0)
        apart = apart / (bound * (1 / np.sqrt(size) + 1 / np.sqrt(n[b])))
        if len(size) and apart.min() <= 1:
            out[b] = apart.argmin()
            states[out[b]] += seen[b]
            size[out[b]] += n[b]
        else:
            out[b] = len(size)
            states, size = np.concatenate([states, seen[b : b + 1]]), np.append(size, n[b])
    return out[of], out


def log_probability(automaton: Automaton, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, and its number of symbols with the end."""
    ends = np.cumsum([len(w) for w in words])
    size = np.array([len(w) for w in words])
    return automaton.scores(SYMBOL[np.frombuffer(b"".join(words), np.uint8)], ends - size, ends), size + 1


def fitted(words: list[bytes]) -> Automaton:
    """The automaton of all words, with the risk that two halves choose for each other and what held-out words reach."""
    words = sorted(words)
    halves = (words[::2], words[1::2])
    if len(words) < 2:
        return inferred(words, RISKS[0])
    tried = []
    for risk in RISKS:
        got = [log_probability(inferred(own, risk), other) for own, other in (halves, halves[::-1])]
        tried.append((float(sum(total.sum() for total, _ in got)), risk, np.sort(np.concatenate([total / size for total, size in got]))))
    _, risk, means = max(tried, key=lambda x: x[:2])
    out = inferred(words, risk)
    out.least = float(means[len(means) // 100]) - SLACK
    return out
