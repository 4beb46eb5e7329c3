"""A generalised suffix automaton of word sequences, as arrays, and many texts walked through it at once.

Its states are the classes of stretches that end at the same places of the items; it has at most two states and three
transitions for each word. Reading a text word by word gives, at each word, the longest stretch that ends there and comes
in any item: a state, and the length.

A window is a stretch of `width` words of an item, or a whole shorter item. Of a state at which `width` words or more match,
`home` is the state of its last `width` words, and a shorter item is the longest stretch of the state that it ends in.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from tarnweave.llm import winnow


class Automaton(NamedTuple):
    """hashes: of the known words, sorted; a word is its place there. word_at, word_bytes: the words themselves. keys: state *
    words + word, sorted, with `to`. below: the nearest shorter item that ends every stretch of the state's link, or -1. item_at:
    where the items of a state begin in `items`, places in `names`. pairs: known neighbours. least: words of the shortest window."""

    width: int
    hashes: np.ndarray
    word_at: np.ndarray
    word_bytes: np.ndarray
    keys: np.ndarray
    to: np.ndarray
    length: np.ndarray
    link: np.ndarray
    home: np.ndarray
    whole: np.ndarray
    below: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str | None]
    pairs: np.ndarray
    least: int

    def size(self) -> int:
        return sum(x.nbytes for x in self if isinstance(x, np.ndarray))


def _states(items: list[np.ndarray]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Transitions, lengths and links, one item after another from the first state."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]

    def add(size: int, onward: dict[int, int], back: int) -> int:
        step.append(onward)
        length.append(size)
        link.append(back)
        return len(step) - 1

    def redirect(at: int, word: int, old: int) -> int:
        """A copy of `old` for the stretches that end in the longest one of `at` and the word."""
        new = add(length[at] + 1, dict(step[old]), link[old])
        link[old] = new
        while at >= 0 and step[at].get(word) == old:
            step[at][word] = new
            at = link[at]
        return new

    for words in items:
        last = 0
        for word in words.tolist():
            known = step[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else redirect(last, word, known)
                continue
            new = add(length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in step[at]:
                step[at][word] = new
                at = link[at]
            if at >= 0:
                old = step[at][word]
                link[new] = old if length[old] == length[at] + 1 else redirect(at, word, old)
            last = new
    return step, length, link


def build(names: list[str | None], texts: list[list[bytes]], width: int) -> Automaton:
    """names, texts: the items, each as its words. Items without words have no window."""
    known = {w for words in texts for w in words}
    ordered = sorted(known)
    at = np.concatenate([[0], np.cumsum([len(w) for w in ordered], dtype=np.int64)])
    data = np.frombuffer(b"".join(ordered), np.uint8)
    hashes = winnow.word_units(data, at[:-1], at[1:]) if ordered else np.zeros(0, np.uint64)
    by_hash = np.argsort(hashes)
    if len(np.unique(hashes)) < len(hashes):
        raise ValueError("two words of one hash")
    place = {ordered[k]: j for j, k in enumerate(by_hash.tolist())}
    items = [np.array([place[w] for w in words], np.int64) for words in texts]
    step, length, link = _states(items)
    n_words, n_states = max(1, len(ordered)), len(step)
    keys = np.array([s * n_words + w for s, own in enumerate(step) for w in own], np.int64)
    to = np.array([x for own in step for x in own.values()], np.int32)
    order = np.argsort(keys)
    size, back = np.array(length), np.array(link)
    home, whole, below = np.full(n_states, -1), np.zeros(n_states, bool), np.full(n_states, -1)
    owners: dict[int, set[int]] = {}
    walked = []
    for words in items:
        states, s = [], 0
        for w in words.tolist():
            s = step[s][w]
            states.append(s)
        walked.append(states)
        if 0 < len(states) < width:
            whole[states[-1]] = True  # no longer stretch of an item ends as its first one does
    for s in np.argsort(size, kind="stable")[1:].tolist():
        b = link[s]
        below[s] = b if whole[b] else below[b]
        if size[s] >= width:
            home[s] = s if size[b] < width else home[b]
    for k, states in enumerate(walked):
        for s in {int(home[s]) for s in states[width - 1 :]} if len(states) >= width else set(states[-1:]):
            owners.setdefault(s, set()).add(k)
    item_at = np.concatenate([[0], np.cumsum([len(owners.get(s, ())) for s in range(n_states)])])
    flat = np.array([k for s in range(n_states) for k in sorted(owners.get(s, ()))], np.int32)
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[:-1] * n_words + x[1:] for x in items)]))
    word_at = np.concatenate([[0], np.cumsum([len(ordered[k]) for k in by_hash], dtype=np.int64)])
    word_bytes = np.frombuffer(b"".join(ordered[k] for k in by_hash), np.uint8)
    least = min((min(width, len(x)) for x in items if len(x)), default=width)
    return Automaton(width, hashes[by_hash], word_at, word_bytes, keys[order], to[order], size.astype(np.int32), back.astype(np.int32), home.astype(np.int32), whole, below.astype(np.int32), item_at, flat, names, pairs, least)


def known_words(own: Automaton, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash, or -1."""
    if not len(own.hashes):
        return np.full(len(hashes), -1)
    bits = 1 << 20
    likely = np.zeros(bits, bool)
    likely[own.hashes & np.uint64(bits - 1)] = True
    some = np.flatnonzero(likely[hashes & np.uint64(bits - 1)])
    out = np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(own.hashes, hashes[some]), len(own.hashes) - 1)
    same = own.hashes[at] == hashes[some]
    out[some[same]] = at[same]
    return out


def stretches(own: Automaton, ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last words of the stretches that can hold a window: known words, each two neighbours also neighbours in
    an item, of one text."""
    known = ids >= 0
    both = np.flatnonzero(known[1:] & known[:-1] & (text[1:] == text[:-1]))
    linked = np.zeros(max(0, len(ids) - 1), bool)
    if len(both) and len(own.pairs):
        pair = ids[both] * max(1, len(own.hashes)) + ids[both + 1]
        linked[both] = own.pairs[np.minimum(np.searchsorted(own.pairs, pair), len(own.pairs) - 1)] == pair
    first = np.flatnonzero(known & np.concatenate([[True], ~linked])[: len(ids)])
    last = np.flatnonzero(known & np.concatenate([~linked, [True]])[-len(ids) :]) + 1 if len(ids) else first
    long = last - first >= own.least
    return first[long], last[long]


def walk(own: Automaton, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the stretches: its place, the state after it, and how many words match. All stretches go on at once,
    a word each."""
    order = np.argsort(first - last, kind="stable")
    first, size = first[order], (last - first)[order]
    state, match = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    n_words = max(1, len(own.hashes))
    place, states, matches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -t, "left"))  # those with more than t words
        word = ids[first[:k] + t]
        todo = np.flatnonzero(word >= 0)
        state[:k][word < 0] = match[:k][word < 0] = 0
        while len(todo):
            key = state[todo] * n_words + word[todo]
            at = np.minimum(np.searchsorted(own.keys, key), len(own.keys) - 1)
            there = own.keys[at] == key
            state[todo[there]] = own.to[at[there]]
            match[todo[there]] += 1
            todo = todo[~there]
            top = state[todo] == 0
            match[todo[top]] = 0
            todo = todo[~top]
            state[todo] = own.link[state[todo]]
            match[todo] = own.length[state[todo]]
        place.append(first[:k] + t)
        states.append(state[:k].copy())
        matches.append(match[:k].copy())
    return np.concatenate(place), np.concatenate(states), np.concatenate(matches)


def windows(own: Automaton, state: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each step: words of the longest window that ends there (0: none), the state of a window of `width` words, and that
    of the longest shorter item (-1: none)."""
    full = np.where(match >= own.width, own.home[state], -1)
    short = np.where(own.whole[state] & (match >= own.length[state]), state, own.below[state])
    longest = np.where(full >= 0, own.width, np.where(short >= 0, own.length[short], 0))
    return longest, full, short


def items_of(own: Automaton, full: int, short: int) -> set[int]:
    """The items that have these windows, as places in names."""
    out = set(own.items[own.item_at[full] : own.item_at[full + 1]].tolist()) if full >= 0 else set()
    while short >= 0:
        out.update(own.items[own.item_at[short] : own.item_at[short + 1]].tolist())
        short = int(own.below[short])
    return out
