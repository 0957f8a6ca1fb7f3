"""The loop once more, row by row and with plain lists, straight from its rules.

Slow and simple on purpose: the tests compare the block-wise loop with it.
"""

import math

import numpy as np

from driftpool.functions import linalg


def r2(y, p):
    y, p = np.asarray(y, dtype=float), np.asarray(p, dtype=float)
    res = ((y - p) ** 2).sum()
    if y.min() == y.max():
        return 1.0 if res == 0 else 0.0
    return 1 - res / ((y - y.mean()) ** 2).sum()


class Buckets:
    """Adaptive window as a flat list of (size, values), newest last; all sums recomputed."""

    def __init__(self, width, delta, per_level=2, side=10):
        self.width, self.delta, self.per_level, self.side = width, delta, per_level, side
        self.items = []

    def add(self, v):
        self.items.append([v])
        size = 1
        while True:
            same = [i for i, b in enumerate(self.items) if len(b) == size]
            if len(same) <= self.per_level:
                break
            i, j = same[0], same[1]
            self.items[i:j + 1] = [self.items[i] + self.items[j]]
            size *= 2
        values = [v for b in self.items for v in b]
        n = len(values)
        if n <= self.width:
            return None
        spread = np.var(values)
        d = math.log(2 * math.log(n) / self.delta)
        for cut in range(1, len(self.items)):
            old = [v for b in self.items[:cut] for v in b]
            new = values[len(old):]
            if len(old) < self.side or len(new) < self.side:
                continue
            m = 1 / (len(old) - 4) + 1 / (len(new) - 4)
            if abs(np.mean(old) - np.mean(new)) > math.sqrt(2 * m * spread * d) + 2 / 3 * d * m:
                self.items.pop(0)
                return len(new)
        return None


class Rowwise:
    def __init__(self, cfg):
        self.cfg = cfg
        self.X, self.y = [], []
        self.fits, self.used, self.moves, self.runs = {}, {}, {}, []
        self.current, self.temp = None, None
        self.window, self.collect = [], None
        self.buckets = Buckets(cfg.window, cfg.delta, cfg.max_buckets, cfg.min_side)
        self.p, self.model_ids, self.log = [], [], []

    def fit(self, rows):
        X, y = np.array([self.X[i] for i in rows]), np.array([self.y[i] for i in rows])
        w, b = linalg.LEARNERS[self.cfg.learner](X, y)
        return np.asarray(w), b

    def predict(self, fit, rows):
        return [float(np.dot(self.X[i], fit[0]) + fit[1]) for i in rows]

    def fits_rows(self, k, rows):
        return r2([self.y[i] for i in rows], self.predict(self.fits[k], rows))

    def step(self, x, y):
        c, w = self.cfg, self.cfg.window
        i = len(self.y)
        self.X.append(np.asarray(x, dtype=float)), self.y.append(float(y))
        seq = i + 1
        if seq <= w:
            self.p.append(c.default), self.model_ids.append(None)
            return
        if seq == w + 1:
            self.fits["0"], self.used["0"], self.moves["0"] = self.fit(range(w)), 0, {}
            self.current, self.runs = "0", [["0", w + 2, None]]
            self.log.append(("learn", seq, "0"))
        fit = self.temp or self.fits[self.current]
        value = self.predict(fit, [i])[0]
        self.p.append(value)
        self.model_ids.append(self.current)
        if seq == w + 1:
            return
        getattr(self, "detect_" + c.detector)(i, abs(value - y))

    def detect_windowed(self, i, error):
        c = self.cfg
        if self.window or error > c.eps:
            self.window.append(i)
        if len(self.window) == c.window:
            fit = self.fits[self.current]
            if r2([self.y[k] for k in self.window], self.predict(fit, self.window)) < c.acc:
                self.log.append(("drift", i + 1, self.current))
                self.change(self.window, i + 1)
            fit = self.fits[self.current]
            errors = {k: abs(v - self.y[k]) for k, v in zip(self.window, self.predict(fit, self.window))}
            while self.window and (len(self.window) >= c.window or errors[self.window[0]] <= c.eps):
                self.window.pop(0)

    def detect_adaptive(self, i, error):
        self._adaptive(i, error, combined=False)

    def detect_combined(self, i, error):
        self._adaptive(i, error, combined=True)

    def _adaptive(self, i, error, combined):
        w = self.cfg.window
        if self.collect is not None:
            self.collect.append(i)
            if len(self.collect) >= w:
                rows, self.collect = self.collect, None
                self.change(rows, i + 1)
            elif combined and len(self.collect) == w // 2:
                self.temporary(self.collect, i + 1)
            return
        newer = self.buckets.add(error)
        if newer is None:
            return
        self.log.append(("drift", i + 1, self.current))
        if newer >= w:
            self.change(list(range(i - w + 1, i + 1)), i + 1)
            return
        rows = list(range(i - newer + 1, i + 1))
        if combined and newer >= w / 2:
            if max([self.fits_rows(k, rows) for k in self.half()] + [0]) >= self.cfg.acc:
                self.change(rows, i + 1)
                return
            self.temporary(rows, i + 1)
        self.collect = rows

    def half(self):
        return [k for k in self.fits if self.used[k] >= self.cfg.stable / 2]

    def close(self, seq):
        last = self.runs[-1]
        last[2] = seq - 1
        length = last[2] - last[1]
        self.used[last[0]] += length
        source, back = last[0], len(self.runs) - 1
        while length < self.cfg.stable and back > 0:
            back -= 1
            source = self.runs[back][0]
            row = self.moves[source]
            if row.get(last[0], 0) > 0:
                row[last[0]] -= 1
            length = self.used[source]
        return source

    def temporary(self, rows, seq):
        self.close(seq)
        self.temp, self.current = self.fit(rows), f"temp{seq}"
        self.log.append(("temporary", seq, self.current))

    def change(self, rows, seq):
        c = self.cfg
        source = str(len(self.fits) - 1) if self.temp is not None else self.close(seq)
        pick = None if c.detector == "adaptive" else self.pick(source, rows)
        if pick is None:
            pick = str(len(self.fits))
            self.fits[pick], self.used[pick], self.moves[pick] = self.fit(rows), 0, {}
            self.moves[source][pick] = 1
            self.log.append(("learn", seq, pick))
        else:
            self.moves[source][pick] = self.moves[source].get(pick, 0) + 1
            self.log.append(("reuse", seq, pick))
        self.runs.append([pick, seq, None])
        self.current, self.temp = pick, None
        self.buckets = Buckets(c.window, c.delta, c.max_buckets, c.min_side)

    def pick(self, source, rows):
        c = self.cfg

        def top(ids):
            found, best = None, 0.0 if c.detector == "combined" else -math.inf
            for k in ids:
                v = self.fits_rows(k, rows)
                if v > best:
                    found, best = k, v
            return found if best >= c.acc else None
        row = self.moves[source]
        total = sum(row.values())
        if total == 0:
            return top(self.half())
        most = max(row.values())
        likely = [k for k, n in row.items() if n == most and n / total >= c.prob]
        if likely:
            found = top([k for k in likely if self.used[k] >= c.stable])
            if found is not None or c.detector == "combined":
                return found
        return top(self.half())

    def finish(self):
        if self.runs and self.runs[-1][2] is None:
            last = self.runs[-1]
            last[2] = len(self.y)
            self.used[last[0]] += last[2] - last[1]
