"""States of scans that chain rows: what may go on, in structures that find the best of a range."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from heapq import heappop, heappush

from contigua.operators.scan import Chain, first

#: Chains in a block of a range structure; it splits at twice as many.
BLOCK = 256


class Best:
    """Chains by a number, in sorted blocks that know their best one: a range costs its blocks and two blocks' chains."""

    def __init__(self):
        self.blocks: list[list[tuple]] = []
        self.lows: list[tuple] = []
        self.tops: list[Chain] = []

    def _top(self, block: list[tuple]) -> Chain:
        top = None
        for _, _, c in block:
            if first(c, top):
                top = c
        return top

    def add(self, at: int, c: Chain) -> None:
        item = (at, c.at, c)
        if not self.blocks:
            self.blocks, self.lows, self.tops = [[item]], [item[:2]], [c]
            return
        i = max(0, bisect_right(self.lows, item[:2]) - 1)
        block = self.blocks[i]
        insort(block, item)
        self.lows[i] = block[0][:2]
        if len(block) > 2 * BLOCK:
            halves = [block[:BLOCK], block[BLOCK:]]
            self.blocks[i : i + 1] = halves
            self.lows[i : i + 1] = [h[0][:2] for h in halves]
            self.tops[i : i + 1] = [self._top(h) for h in halves]
        elif first(c, self.tops[i]):
            self.tops[i] = c

    def remove(self, at: int, c: Chain) -> None:
        i = bisect_right(self.lows, (at, c.at)) - 1
        block = self.blocks[i]
        del block[bisect_left(block, (at, c.at))]
        if not block:
            del self.blocks[i], self.lows[i], self.tops[i]
            return
        self.lows[i] = block[0][:2]
        if self.tops[i] is c:
            self.tops[i] = self._top(block)

    def of(self, low: int, high: int) -> Chain | None:
        """The best chain from ``low`` to ``high``, both counted in."""
        top = None
        i = max(0, bisect_right(self.lows, (low,)) - 1)
        while i < len(self.blocks) and self.lows[i][0] <= high:
            block = self.blocks[i]
            if block[0][0] >= low and block[-1][0] <= high:
                if first(self.tops[i], top):
                    top = self.tops[i]
            else:
                for j in range(bisect_left(block, (low,)), bisect_left(block, (high + 1,))):
                    if first(block[j][2], top):
                        top = block[j][2]
            i += 1
        return top


class HitChain:
    """The heaviest chain of hits (ts, qs, te, qe, w): the next starts 0 to ``limit`` after, on both sides.

    What is held: chains whose end is at most ``limit`` before the start of the present hit.
    """

    def __init__(self, limit: int, members: bool):
        self.limit, self.members = limit, members
        self.at, self.top = 0, None
        self.near, self.later, self.ends = Best(), [], deque()

    def step(self, ts, qs, te, qe, w):
        while self.later and self.later[0][0] <= ts:
            end, _, q, c = heappop(self.later)
            self.near.add(q, c)
            self.ends.append((end, q, c))
        while self.ends and self.ends[0][0] < ts - self.limit:
            _, q, c = self.ends.popleft()
            self.near.remove(q, c)
        before = self.near.of(qs - self.limit, qs)
        c = Chain(before if before and before.loss < 0 else None, w, self.at, (ts, qs, te, qe, w))
        heappush(self.later, (te, self.at, qe, c))
        self.at += 1
        if first(c, self.top):
            self.top = c
        return []

    def end(self):
        if not self.members:
            return [(-self.top.loss,)]
        rows = self.top.rows()
        return [(-self.top.loss, self.top.n, rows[0][0], rows[-1][2], rows[0][1], rows[-1][3], [dict(zip(("ts", "qs", "te", "qe", "w"), r, strict=True)) for r in rows])]


class MarkerRun:
    """The longest run of markers (pos, start, end): positions rise, places don't overlap.

    What is held: the chains that no other beats with an end as small, one for each length or tie.
    """

    def __init__(self, members: bool):
        self.members, self.at, self.top = members, 0, None
        self.ends, self.chains, self.same, self.pos = [], [], [], None

    def _settle(self):
        for end, c in self.same:
            i = bisect_right(self.ends, end)
            if i and not first(c, self.chains[i - 1]):
                continue
            if i and self.ends[i - 1] == end:
                i -= 1
            j = i
            while j < len(self.ends) and not first(self.chains[j], c):
                j += 1
            self.ends[i:j], self.chains[i:j] = [end], [c]
        self.same = []

    def step(self, pos, start, end):
        if pos != self.pos:
            self._settle()
            self.pos = pos
        i = bisect_right(self.ends, start)
        c = Chain(self.chains[i - 1] if i else None, 1, self.at, (pos, start, end))
        self.same.append((end, c))
        self.at += 1
        if first(c, self.top):
            self.top = c
        return []

    def end(self):
        if not self.members:
            return [(self.top.n,)]
        return [(self.top.n, [dict(zip(("pos", "start", "end"), r, strict=True)) for r in self.top.rows()])]


class Tiling:
    """The longest tiling by hits (ts, te, forced): the next starts 0 to ``limit`` after the last's end, no forced one is left out.

    What is held: chains since the last forced hit whose end is at most ``limit`` back, but for those that a later one beats.
    """

    def __init__(self, limit: int, members: bool):
        self.limit, self.members = limit, members
        self.at, self.open, self.top = 0, True, None
        self.near, self.later = deque(), []

    def step(self, ts, te, forced):
        while self.later and self.later[0][0] <= ts:
            end, _, c = heappop(self.later)
            while self.near and not first(self.near[-1][1], c):
                self.near.pop()
            self.near.append((end, c))
        while self.near and self.near[0][0] < ts - self.limit:
            self.near.popleft()
        before = self.near[0][1] if self.near else None
        c = Chain(before, te - ts, self.at, (ts, te, forced)) if before or self.open else None
        self.at += 1
        if forced:
            # Only a tiling that has this hit goes on.
            self.near, self.later, self.open, self.top = deque(), [], False, None
        if c:
            heappush(self.later, (te, self.at, c))
            if first(c, self.top):
                self.top = c
        return []

    def end(self):
        if not self.members:
            return [(-self.top.loss if self.top else None,)]
        return [(-self.top.loss, [dict(zip(("ts", "te", "f"), r, strict=True)) for r in self.top.rows()])] if self.top else []
