"""Burrows-Wheeler transforms of shards, merged by interleave refinement.

A shard is a set of byte strings, each closed by an end mark.  ``Shard`` sorts its suffixes once and
keeps the transform and its last-to-first map.  ``repeats`` merges any number of shards: it starts from the
shards one after the other and refines the interleave; a step takes the suffixes grouped by their first
h bytes, moves each to the suffix up to ``WIDE`` bytes longer (the last-to-first map) and parts each group by what came
(the transform).  Groups have a common prefix of h bytes, so the step in which two members part
bounds their longest common prefix.  A group whose members all got the same bytes stays as it is, so only what parts
is sorted.  A string may stand for several equal ones; a group of one that stands for one
leaves the work, and a group of one that stands for more is repeated as far as it goes.  What is left after ``depth``
bytes are the other repeated intervals.  No suffix is compared with another of a different shard but by its group.
"""

from __future__ import annotations

import numpy as np

WIDE = 8  # bytes of a step, a power of two


class Shard:
    """The transform of strings: ``last`` (byte before each suffix, -1 at a string's start), ``lf`` and ``at``."""

    def __init__(self, strings: list[bytes], times: list[int] | None = None, depth: int = 1 << 30):
        """times: how many equal strings each stands for; depth: bytes that decide the order."""
        self.times = np.minimum(np.array(times if times is not None else [1] * len(strings), np.int64), 2)
        n = [len(s) for s in strings]
        size = sum(n) + len(n)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        ends = np.cumsum(np.array(n, np.int64) + 1) - 1
        self.starts = ends - np.array(n, np.int64)
        # Suffixes are sorted by their first ``depth`` bytes; what is equal so far has any order.
        rank = text.astype(np.uint64)
        for k in (1, 2, 4):  # the first eight bytes at once
            rank <<= np.uint64(8 * k)
            rank[: size - k] |= rank[k:] >> np.uint64(8 * k)
        span = 8
        order = np.argsort(rank)
        key = rank[order]
        slot = np.arange(size)  # of the suffixes whose place is still shared
        part = order
        place = np.zeros(size + 1, np.int64)
        while True:
            new = np.append(True, key[1:] != key[:-1])
            head = np.flatnonzero(new)
            place[part] = slot[head][np.cumsum(new) - 1]
            shared = ~(new & np.append(new[1:], True))
            if span >= depth or not shared.any():
                break
            slot, part = slot[shared], part[shared]
            key = place[part] * (size + 1) + place[np.minimum(part + span, size)]
            again = np.argsort(key)
            part, key, span = part[again], key[again], span * 2
            order[slot] = part
        place[order] = np.arange(size)
        place = place[:size]
        first = place[self.starts]
        self.at = order.astype(np.int32)  # text offset by rank
        self.last = text.take(self.at - 1).astype(np.int16)
        self.lf = place.take(self.at - 1).astype(np.int32)
        self.last[first] = self.lf[first] = -1
        self.string = np.repeat(np.arange(len(n), dtype=np.int32), np.array(n, np.int64) + 1)  # by text offset

    def strings(self) -> np.ndarray:
        """The string of each suffix, by rank."""
        return self.string.take(self.at)

    def offsets(self) -> np.ndarray:
        """Offset of each suffix in its string, by rank."""
        return self.at - self.starts[self.strings()]

    def wide(self, depth: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The 1, 2, 4 and 8 bytes before each suffix, the farthest one first, and the suffix that begins with them.

        Nothing is meant where a string has fewer.  Of more bytes than ``depth`` there is none.
        """
        came, back = [np.maximum(self.last, 0).astype(np.uint8)], [np.maximum(self.lf, 0)]
        while (n := 1 << len(came)) <= min(WIDE, depth):
            near, last = came[-1].astype(f"u{n}"), back[-1]
            came.append(near.take(last) << near.dtype.type(4 * n) | near)
            back.append(last.take(last))
        return came, back


def repeats(shards: list[Shard], depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each shard the string, offset and common prefix of every suffix whose first ``depth`` bytes occur again.

    The common prefix is ``depth``, or the step at which the suffix was alone and stood for several strings.
    """
    sizes = [len(s.last) for s in shards]
    base = np.cumsum(sizes) - sizes
    text = np.concatenate([s.at for s in shards])
    several = np.concatenate([s.times[s.strings()] > 1 for s in shards])
    wide = [s.wide(depth) for s in shards]
    came = [np.concatenate(x) for x in zip(*(c for c, _ in wide), strict=True)]
    back = [np.concatenate([r + np.int32(b) for r, b in zip(x, base, strict=True)]) for x in zip(*(r for _, r in wide), strict=True)]
    # Ranks by group; a window of ``depth`` bytes grows leftwards from the suffix at its end.
    here = np.concatenate([b + np.flatnonzero(s.offsets() >= depth) for s, b in zip(shards, base, strict=True)]).astype(np.int32)
    new = np.arange(len(here)) == 0  # where a group begins
    found: list[tuple[np.ndarray, int]] = []
    step = 0
    while step < depth and len(here):
        k = min(len(came), (depth - step).bit_length()) - 1
        c = came[k].take(here)  # a suffix in ``here`` has ``depth`` bytes before it
        here = back[k].take(here)
        apart = (c[1:] != c[:-1]) & ~new[1:]
        first, step = step == 0, step + (1 << k)
        if apart.any():
            group = np.cumsum(new) - 1
            parted = np.zeros(group[-1] + 1, bool)
            parted[group[1:][apart]] = True
            at = np.flatnonzero(parted[group])
            own, c = group[at], c[at]
            order = np.argsort(c) if len(parted) == 1 else np.lexsort((c, own))
            here[at], c = here[at[order]], c[order]
            new[at[1:]] |= c[1:] != c[:-1]  # groups keep their places, so where one begins is marked already
        elif not first:
            continue
        alone = new & np.append(new[1:], True)
        many = several.take(here)
        if step < depth:
            found.append((here[alone & many], step))
        keep = ~alone if step < depth else ~alone | many
        here, new = here[keep], new[keep]
    found.append((here, depth))
    rank = np.concatenate([x for x, _ in found])
    common = np.repeat([n for _, n in found], [len(x) for x, _ in found])
    owner = np.searchsorted(base, rank, side="right") - 1
    at = text[rank].astype(np.int64) - (depth - common)  # the window's start, where the refinement stopped early
    out = []
    for k, s in enumerate(shards):
        mine = owner == k
        string = s.string.take(at[mine])
        out.append((string, at[mine] - s.starts[string], common[mine]))
    return out
