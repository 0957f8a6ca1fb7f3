"""Adaptive window over a stream of errors (published as ADWIN, Bifet and Gavalda 2007).

Keeps an exponential histogram: level ``i`` holds at most ``max_buckets``
buckets of ``2**i`` values, so memory is logarithmic in the window.
"""

import math


class AdaptiveWindow:
    def __init__(self, min_width: int, delta: float, max_buckets: int = 2, min_side: int = 10):
        self.min_width, self.delta = min_width, delta
        self.max_buckets, self.min_side = max_buckets, min_side
        self.levels = [[]]
        self.width, self.total, self.spread = 0, 0.0, 0.0

    def add(self, value: float):
        """Take one value; ``(newer, older)`` side lengths if the mean changed, else None."""
        if self.width:
            off = value - self.total / self.width
            self.spread += off * off * self.width / (self.width + 1)
        self.width += 1
        self.total += value
        self.levels[0].append((value, 0.0))
        self._merge()
        return self._cut() if self.width > self.min_width else None

    def _merge(self):
        for i, level in enumerate(self.levels):
            if len(level) <= self.max_buckets:
                return
            (s0, v0), (s1, v1) = level[0], level[1]
            del level[:2]
            size = 1 << i
            gap = (s0 - s1) / size
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append((s0 + s1, v0 + v1 + gap * gap * size / 2.0))

    def _cut(self):
        width, total, least = self.width, self.total, self.min_side
        d = math.log(2.0 * math.log(width) / self.delta)
        deviation, rest = 2.0 * d * self.spread / width, 2.0 / 3.0 * d
        older, older_sum = 0, 0.0
        for i in range(len(self.levels) - 1, -1, -1):
            size = 1 << i
            level = self.levels[i]
            for s, _ in (level if i else level[:-1]):
                older += size
                older_sum += s
                newer = width - older
                if newer < least:
                    return None
                if older < least:
                    continue
                m = 1.0 / (older - 4) + 1.0 / (newer - 4)
                gap = abs(older_sum / older - (total - older_sum) / newer)
                if gap > math.sqrt(max(deviation, 0.0) * m) + rest * m:
                    self._drop_oldest()
                    return newer, older
        return None

    def _drop_oldest(self):
        size = 1 << (len(self.levels) - 1)
        s, v = self.levels[-1].pop(0)
        self.width -= size
        self.total -= s
        gap = s / size - self.total / self.width
        self.spread -= v + gap * gap * size * self.width / (size + self.width)
        while len(self.levels) > 1 and not self.levels[-1]:
            self.levels.pop()

    def dump(self) -> dict:
        return {"levels": self.levels, "width": self.width, "total": self.total, "spread": self.spread}

    def restore(self, kept: dict) -> "AdaptiveWindow":
        self.levels = [[tuple(b) for b in level] for level in kept["levels"]]
        self.width, self.total, self.spread = kept["width"], kept["total"], kept["spread"]
        return self
