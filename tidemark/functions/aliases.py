"""Finding all aliases of a dictionary in a text: one pass of an automaton, then the longest alias first."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick

#: Letters beyond ASCII that a match without case takes for i, s or k.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


class Entry(NamedTuple):
    """A line of the dictionary."""

    symbol: str
    name: str
    market: str
    sector: str
    aliases: tuple[str, ...]


def lowered(text: str) -> str:
    """The text in the form that the automaton reads."""
    return text.translate(ALIKE).lower()


class Matcher:
    """Counts of a dictionary's aliases in texts.

    Aliases are taken from the longest on; what one matches is cut out, a blank standing in its place, so a bank's name isn't its parent's. Latin aliases count without case and as whole words,
    others by letter. The automaton finds where any alias may stand, in one pass; only those that may are then settled by the rule, on the places found.
    """

    def __init__(self, dictionary: Iterable[Entry], noise: Iterable[str] = ()):
        pairs = sorted(((alias, e) for e in dictionary for alias in e[4] if alias), key=lambda p: -len(p[0]))
        self.aliases = [alias for alias, _ in pairs]
        self.entries = [e for _, e in pairs]
        self.latin = [all(" " <= c <= "~" for c in a) for a in self.aliases]
        self.noise = [term for term in noise if term]
        self.spaced = [(rank, lowered(a).split(" ")) for rank, a in enumerate(self.aliases) if " " in a]
        self.ranks: dict[str, list[int]] = {}
        for rank, alias in enumerate(self.aliases):
            self.ranks.setdefault(lowered(alias), []).append(rank)
        self.places = all(len(lowered(a)) == len(a) for a in self.aliases)
        self.automaton = ahocorasick.Automaton()
        for word, ranks in self.ranks.items():
            self.automaton.add_word(word, ranks)
        self.automaton.make_automaton()

    def counts(self, text: str) -> Iterator[tuple[int, int]]:
        """(rank, occurrences) of the aliases that a text holds, from the longest on."""
        for term in self.noise:
            text = text.replace(term, " ")
        if not self.ranks:
            return
        low = lowered(text)
        if len(low) != len(text) or not self.places:  # lower-casing has moved places
            yield from self.one_by_one(text, range(len(self.aliases)))
            return
        ends: dict[int, list[int]] = {}
        for end, ranks in self.automaton.iter(low):
            for rank in ranks:
                ends.setdefault(rank, []).append(end + 1)
        if not ends:
            return
        # an alias of several words may come about where something is cut out between them
        for rank, words in self.spaced:
            if rank not in ends and all(w in low for w in words):
                ends[rank] = []
        order, cuts, cut = sorted(ends), [], bytearray(len(text))
        for i, rank in enumerate(order):
            alias = self.aliases[rank]
            if cuts and " " in alias:
                yield from self.one_by_one(without(text, cuts), order[i:])
                return
            found = self.settle(text, cut, cuts, alias, ends[rank], self.latin[rank])
            if found:
                yield rank, found

    def settle(self, text: str, cut: bytearray, cuts: list[tuple[int, int]], alias: str, ends: list[int], whole: bool) -> int:
        """How often an alias stands where it may end; if it does, all that is spelt like it is cut out."""
        edge = lambda i: i < 0 or i >= len(text) or text[i] not in WORD or cut[i]
        count, last, spelt = 0, 0, []
        for end in ends:
            start = end - len(alias)
            if cut.find(1, start, end) >= 0:
                continue
            same = text.startswith(alias, start)
            if start >= last and (edge(start - 1) and edge(end) if whole else same):
                count, last = count + 1, end
            if same and (not spelt or start >= spelt[-1][1]):
                spelt.append((start, end))
        if count:
            for start, end in spelt:
                cut[start:end] = b"\x01" * (end - start)
            cuts += spelt
        return count

    def one_by_one(self, text: str, ranks: Iterable[int]) -> Iterator[tuple[int, int]]:
        """The same, alias after alias over the whole text."""
        for rank in ranks:
            alias = self.aliases[rank]
            n = len(re.findall(rf"(?<![A-Za-z0-9]){re.escape(alias)}(?![A-Za-z0-9])", text, re.I)) if self.latin[rank] else text.count(alias)
            if n:
                text = text.replace(alias, " ")
                yield rank, n

    def matches(self, title: str, body: str, limit: int) -> list[dict]:
        """The symbols that a title and a body mention, best first."""
        counts: dict[int, list[int]] = {}
        for part, text in enumerate((title, body)):
            for rank, n in self.counts(text):
                counts.setdefault(rank, [0, 0])[part] = n
        found: dict[str, dict] = {}
        for rank in sorted(counts):
            in_title, in_body = counts[rank]
            symbol, name, market, sector, _ = self.entries[rank]
            had = found.setdefault(symbol, {"symbol": symbol, "company": name, "market": market, "sector": sector, "mentions": 0, "relevance": 0})
            had["mentions"] += in_title + in_body
            had["relevance"] = max(had["relevance"], min(100, (72 if in_title else 40) + min(6 * (in_title + in_body), 28)))
        return sorted(found.values(), key=lambda m: (-m["relevance"], -m["mentions"]))[:limit]


def without(text: str, cuts: list[tuple[int, int]]) -> str:
    """The text with a blank in place of each cut."""
    parts, last = [], 0
    for start, end in sorted(cuts):
        parts.append(text[last:start])
        last = end
    return " ".join([*parts, text[last:]])
