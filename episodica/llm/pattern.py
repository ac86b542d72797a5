"""The usual split pattern of byte-level BPE, applied to many texts at once as array operations.

A match starts where the class of the character (letter, number, white space,
other) changes, but for three things that the pattern adds: a blank belongs to
the match after it, the last character of a longer run of white space before
something else is on its own, and an English contraction after an apostrophe
that starts a match is a match.

Equal matches of a piece of text are found by a 64-bit hash, compared with the
first of their kind character by character, and handed out once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd

#: Fixed value: the pattern that this module stands for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LETTER, NUMBER, OTHER, SPACE, BREAK, UNSURE = range(6)
#: A code point that no text has; it stands between texts.
_BREAK = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Distinct:
    """What a row of keys consists of: distinct keys, by the position and length of the first of each."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers):
        lengths = ends - starts
        self.codes, first = pd.factorize(powers.hashes(values, starts, ends))
        n = len(first)
        reps = np.zeros(n, np.int64)
        reps[self.codes[::-1]] = np.arange(len(starts) - 1, -1, -1)
        self.starts, self.ends = starts[reps], ends[reps]
        # Equal hashes of unlike keys: those that differ from the first get a number of their own.
        unlike = lengths != lengths[reps][self.codes]
        if len(starts):
            compared = np.where(unlike, 0, lengths)
            at = spread(starts, compared)
            wrong = np.flatnonzero(values[at + np.repeat(self.starts[self.codes] - starts, compared)] != values[at])
            if len(wrong):
                unlike[np.searchsorted(starts, at[wrong], "right") - 1] = True
            own = np.flatnonzero(unlike)
            self.codes = self.codes.copy()
            self.codes[own] = n + np.arange(len(own))
            self.starts, self.ends = np.append(self.starts, starts[own]), np.append(self.ends, ends[own])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of slices from prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))

    def hashes(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.up) < len(values):
            n = max(len(values), 1 << 20)
            for name, by in (("up", _ODD), ("down", self.inverse)):
                row = np.full(n, by, np.uint64)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values + np.uint64(1)) * self.up[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[np.minimum(starts, len(self.down) - 1)]
        return (h ^ (h >> np.uint64(32))) * _ODD


class Splitter:
    """Splits texts by PATTERN.

    sure=True splits only where any version of Unicode would: characters that
    had another class in Unicode 3.2, or none, stay with what they touch,
    unless white space parts them. Such matches are longer, and right for a
    library that splits them itself.
    """

    def __init__(self, sure: bool = False):
        import regex

        every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
        self.classes = np.full(_BREAK + 1, OTHER, np.int8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.classes[slice(*m.span())] = kind
        if sure:
            early = map(unicodedata.ucd_3_2_0.category, every)
            of = {"L": LETTER, "N": NUMBER, "C": UNSURE}
            early = np.fromiter((OTHER if c == "Cc" else of.get(c[0], OTHER) for c in early), np.int8, len(every))
            known = self.classes[:-1]
            known[(known != early) & (known != SPACE)] = UNSURE
        self.classes[_BREAK] = BREAK
        self.sure, self.powers = sure, Powers()

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(characters, start of every match and break, index of each text's break among these)."""
        chars = np.frombuffer(("\0".join(texts) + "\0\0\0").encode("utf-32-le"), np.uint32).copy()
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        chars[breaks] = _BREAK
        chars[breaks[-1] + 1 :] = _BREAK
        kind = self.classes[chars]
        before, space = np.empty_like(kind), kind == SPACE
        before[0], before[1:] = BREAK, kind[:-1]
        start = kind != before
        # The last of a run of white space, if more of the text follows.
        start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & (kind[2:] != BREAK)
        # A blank belongs to what follows.
        blank = np.flatnonzero(chars == 32) + 1
        start[blank[(kind[blank] != SPACE) & (kind[blank] != BREAK)]] = False
        if self.sure:
            unsure = (kind == UNSURE) | (before == UNSURE)
            unsure &= (kind != SPACE) & (before != SPACE) & (kind != BREAK) & (before != BREAK)
            start &= ~unsure
        at = np.flatnonzero(chars[:-2] == 39)
        if len(at):
            one, two = chars[at + 1], chars[at + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            meant = (short | long) & start[at]
            start[at[meant] + 1] = False
            start[at[meant] + np.where(short[meant], 2, 3)] = True
            if self.sure:
                start[at[(short | long) & (before[at] == UNSURE)] + 1] = False
        start[breaks] = True
        start[breaks[-1] + 1 :] = False
        found = np.flatnonzero(start)
        return chars, found, np.searchsorted(found, breaks)

    def words(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct matches, number of each match in order, how many matches come before each text's end)."""
        chars, found, breaks = self.starts(texts)
        ends = np.append(found[1:], breaks[-1:] * 0 + found[-1] + 1)
        keep = np.ones(len(found), bool)
        keep[breaks] = False
        starts, ends = found[keep], ends[keep]
        all_ = Distinct(chars, starts, ends, self.powers)
        whole = "\0".join(texts)
        return [whole[a:b] for a, b in zip(all_.starts.tolist(), all_.ends.tolist())], all_.codes, breaks - np.arange(len(breaks))


def joined(values: list[bytes], codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """For each text, its keys' values in a row; ends counts the keys up to each text's end."""
    of = np.empty(len(values), object)
    of[:] = values
    row, at = of[codes].tolist(), ends.tolist()
    return [b"".join(row[a:b]) for a, b in zip([0, *at], at)]
