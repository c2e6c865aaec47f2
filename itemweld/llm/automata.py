"""Weighted acyclic automata over words: sets of word sequences with a count each.

States are minimal: two states with the same way on are one. Every state knows how many sequences
start there, so walking a sequence adds up its number in sorted order, and the counts are a plain
array by that number. Labels are numbers of a word list.
"""

import heapq
import pickle
import zlib
from bisect import bisect_right

import numpy as np


class Automaton:
    """words: list of bytes; begin, labels, targets: the arcs of state s lie at
    begin[s]:begin[s + 1]; final: whether a sequence ends there; number: how many start there."""

    __slots__ = ("words", "begin", "labels", "targets", "final", "number", "root", "weights")

    def __init__(self, words, begin, labels, targets, final, number, root, weights):
        self.words, self.begin, self.labels, self.targets = words, begin, labels, targets
        self.final, self.number, self.root, self.weights = final, number, root, weights

    def __len__(self):
        return len(self.weights)

    def dump(self) -> bytes:
        arrays = [np.array(x, "<i8").tobytes() for x in (self.begin, self.labels, self.targets, self.final, self.number, self.weights)]
        return zlib.compress(pickle.dumps((self.words, self.root, arrays)), 1)

    @classmethod
    def load(cls, raw: bytes):
        words, root, arrays = pickle.loads(zlib.decompress(raw))
        begin, labels, targets, final, number, weights = (np.frombuffer(a, "<i8").tolist() for a in arrays)
        return cls(words, begin, labels, targets, final, number, root, weights)

    def items(self):
        """(sequence of words, count) in sorted order."""
        words, labels, targets, begin, final = self.words, self.labels, self.targets, self.begin, self.final
        path, n, weights = [], 0, self.weights
        stack = [(self.root, begin[self.root])]
        if final[self.root]:
            yield (), weights[0]
            n = 1
        while stack:
            state, arc = stack[-1]
            if arc == begin[state + 1]:
                stack.pop()
                if path:
                    path.pop()
                continue
            stack[-1] = state, arc + 1
            path.append(words[labels[arc]])
            to = targets[arc]
            if final[to]:
                yield tuple(path), weights[n]
                n += 1
            stack.append((to, begin[to]))


class Builder:
    """Takes sequences of labels in sorted order and keeps the automaton minimal all along: once a
    branch is left, its states are replaced by equal ones known already."""

    def __init__(self):
        self.known, self.begin, self.labels, self.targets = {}, [0], [], []
        self.final, self.number, self.weights = [], [], []
        self.last, self.branch = (), [[False, []]]      # states of the latest sequence, not settled yet

    def _settle(self, state) -> int:
        final, arcs = state
        sign = (final, *arcs)
        found = self.known.get(sign)
        if found is None:
            found = self.known[sign] = len(self.final)
            count = int(final)
            for label, to in arcs:
                self.labels.append(label)
                self.targets.append(to)
                count += self.number[to]
            self.begin.append(len(self.labels))
            self.final.append(final)
            self.number.append(count)
        return found

    def _cut(self, depth):
        branch, last = self.branch, self.last
        while len(branch) > depth + 1:
            done = self._settle(branch.pop())
            branch[-1][1].append((last[len(branch) - 1], done))

    def add(self, sequence, weight):
        last, depth = self.last, 0
        for x, y in zip(last, sequence):
            if x != y:
                break
            depth += 1
        self._cut(depth)
        for _ in range(len(sequence) - depth):
            self.branch.append([False, []])
        self.branch[-1][0] = True
        self.last = sequence
        self.weights.append(weight)

    def done(self, words) -> Automaton:
        self._cut(0)
        root = self._settle(self.branch[0])
        return Automaton(words, self.begin, self.labels, self.targets, self.final, self.number, root, self.weights)


def from_items(items) -> Automaton:
    """From sorted (sequence of words, count)."""
    ids, builder = {}, Builder()
    for sequence, weight in items:
        builder.add(tuple([ids.setdefault(w, len(ids)) for w in sequence]), weight)
    return builder.done(list(ids))


def from_rows(rows, counts, words) -> Automaton:
    """The same from sorted rows of labels, each filled up with -1, and the words the labels stand for."""
    ids, builder = {}, Builder()
    for row, weight in zip(rows, counts):
        builder.add(tuple([ids.setdefault(x, len(ids)) for x in row if x >= 0]), weight)
    return builder.done([words[x] for x in ids])


def summed(streams, least):
    """(sequence, sum of counts) of sorted streams, in order, sums below ``least`` left out."""
    now, total = None, 0
    for sequence, weight in heapq.merge(*streams):
        if sequence == now:
            total += weight
            continue
        if now is not None and total >= least:
            yield now, total
        now, total = sequence, weight
    if now is not None and total >= least:
        yield now, total


def union(automata, least=1):
    """Sorted (sequence, sum of counts) of several automata, sums below ``least`` left out."""
    return list(summed([a.items() for a in automata], least))


def united(dumps, least=1):
    """The same, one by one, of (first sequence, dump) of many automata. Each is held only between its first and its
    last sequence, so that of a list cut into consecutive automata one is in memory at a time."""

    def opened(first, raw):
        yield first, 0      # nothing is loaded until this one's turn
        yield from Automaton.load(raw).items()

    return summed([opened(first, raw) for first, raw in dumps], least)


def composed(asked: Automaton, counted: Automaton):
    """(number of the asked sequence, its count) for all sequences both hold: both automata are
    walked at once along the words they share."""
    if not len(asked) or not len(counted):
        return
    same = {w: i for i, w in enumerate(counted.words)}
    label = [same.get(w, -1) for w in asked.words]
    todo = [(asked.root, counted.root, 0, 0)]
    while todo:
        p, q, m, n = todo.pop()
        if asked.final[p]:
            if counted.final[q]:
                yield m, counted.weights[n]
            m += 1
        n += counted.final[q]
        arcs, low, high = {}, counted.begin[q], counted.begin[q + 1]
        for arc in range(low, high):
            arcs[counted.labels[arc]] = counted.targets[arc], n
            n += counted.number[counted.targets[arc]]
        for arc in range(asked.begin[p], asked.begin[p + 1]):
            to = asked.targets[arc]
            met = arcs.get(label[asked.labels[arc]])
            if met:
                todo.append((to, met[0], m, met[1]))
            m += asked.number[to]


def pieces(items, bounds, most=None):
    """Cuts sorted items at the bounds (sorted sequences), and into lists of ``most`` items: (number of the range, list of items)."""
    now, held = 0, []
    for sequence, weight in items:
        if len(held) == most or now < len(bounds) and sequence >= bounds[now]:
            if held:
                yield now, held
            held = []
            while now < len(bounds) and sequence >= bounds[now]:
                now += 1
        held.append((sequence, weight))
    if held:
        yield now, held


def range_of(sequence, bounds) -> int:
    """Number of the range a sequence lies in: how many bounds are at or before it."""
    return bisect_right(bounds, sequence)
