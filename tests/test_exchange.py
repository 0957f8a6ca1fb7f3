"""Streams that exchange models: against row-by-row rules and plain lists, and over splits."""

import json

import numpy as np
import pytest

from driftpool.functions import linalg
from driftpool.operators import exchange, loop
from driftpool.plans.config import LoopConfig
from tests.rowwise import Rowwise, r2


class Plain(Rowwise):
    """The row-by-row loop with received models, groups and substitution."""

    def __init__(self, cfg, rule):
        super().__init__(cfg)
        self.rule, self.offered, self.pool = rule, {}, {}
        self.group, self.since = [], 0
        self.foreign, self.replaced, self.own = set(), {}, 0
        self.sent, self.known, self.waiting, self.due = [], set(), False, None
        self.out = []

    def similar(self, names, rows):
        base = np.array([[float(np.dot(self.X[i], f[0]) + f[1]) for f in map(self.of, names)] for i in rows])
        if self.rule == "all":
            close = [True] * len(names)
        elif self.rule == "distance":
            close = [np.mean(abs(base[:, k] - base[:, 0])) <= self.cfg.eps for k in range(len(names))]
        else:
            close = [v > 0.2 for v in linalg.information_matrix(base, 16)[0]]
        return [n for k, n in enumerate(names) if k == 0 or close[k]]

    def of(self, name):
        return self.fits.get(name) or self.pool[name]

    def half(self):
        return [k for k in self.fits if k in self.foreign
                or (self.used[k] >= self.cfg.stable / 2 and k not in self.replaced)]

    def pick(self, source, rows):
        c = self.cfg

        def top(ids):
            found, best = None, 0.0 if c.detector == "combined" else -np.inf
            for k in ids:
                v = self.fits_rows(k, rows)
                if v > best:
                    found, best = k, v
            return found, best
        row = self.moves.get(source, {})
        total = sum(row.values())
        found = (None, 0.0)
        if total == 0:
            found = top(self.half())
            return found[0] if found[1] >= c.acc else None
        most = max(row.values())
        likely = [k for k, n in row.items() if n == most and n / total >= c.prob and k not in self.replaced]
        proven = lambda ids: [k for k in ids if k in self.fits and (k in self.foreign or self.used[k] >= c.stable)]
        if likely:
            found = top(proven(likely))
        if not likely or (found[1] < c.acc and c.detector != "combined"):
            found = top(self.half())
        if found[1] < c.acc and proven(list(self.replaced)):
            found = top(proven([k for k in self.fits if k in self.replaced]))
        return found[0] if found[0] is not None and found[1] >= c.acc else None

    def ask(self, rows, seq):
        for k in sorted(self.offered):
            self.out.append(("receive", seq, k))
        self.pool.update(self.offered)
        self.offered, self.group = {}, []
        stable = [k for k in self.fits if k not in self.foreign and k not in self.replaced
                  and self.used[k] >= self.cfg.stable and k not in (self.current, *self.pool)]
        names = [self.current] + [k for k in sorted(self.pool) if k != self.current] + stable
        if len(names) > 1 and len(rows) >= min(20, self.cfg.window):
            names = self.similar(names, rows)
        self.group = names if len(names) > 1 else []
        self.since = seq + 1

    def drifted(self, seq, newer):
        group, w = self.group, self.cfg.window
        self.group = []
        if not group or self.temp is not None:
            return
        rows = list(range(self.since, seq - newer + 1))
        if newer > w:       # whole windows go
            old = list(range(self.since, seq - w + 1))
            keep = len(old)
            while keep > 0 and len(old) - keep < newer - w:
                keep = (keep - 1) // w * w
            rows = old[:keep]
        if len(rows) < w:
            return
        truth = [self.y[k - 1] for k in rows]
        score = [r2(truth, self.predict(self.of(n), [k - 1 for k in rows])) for n in group]
        best = group[int(np.argmax(score))]
        self.waiting = False
        if best == self.current:
            self.out.append(("confirm", seq, self.current))
            return
        old = self.current
        self.out.append(("substitute", seq, old, best))
        if best not in self.fits:
            self.fits[best], self.used[best], self.moves[best] = self.pool[best], 0, {}
            self.foreign.add(best)
        merged = {}
        for a, row in self.moves.items():
            for b, n in row.items():
                merged.setdefault(best if a == old else a, {}).setdefault(best if b == old else b, 0)
                merged[best if a == old else a][best if b == old else b] += n
        self.moves = {k: merged.get(k, {}) for k in self.fits}
        self.replaced[old], self.used[old] = best, 0
        self.pool.pop(old, None)

    def detect_windowed(self, i, error):
        c = self.cfg
        if self.window or error > c.eps:
            self.window.append(i)
        if len(self.window) == c.window:
            fit = self.fits[self.current]
            if r2([self.y[k] for k in self.window], self.predict(fit, self.window)) < c.acc:
                self.log.append(("drift", i + 1, self.current))
                self.drifted(i + 1, c.window)
                self.change(self.window, i + 1)
            fit = self.fits[self.current]
            errors = {k: abs(v - self.y[k]) for k, v in zip(self.window, self.predict(fit, self.window))}
            while self.window and (len(self.window) >= c.window or errors[self.window[0]] <= c.eps):
                self.window.pop(0)

    def _adaptive(self, i, error, combined):
        if self.collect is None:
            newer = self.buckets.add(error)
            if newer is not None:
                self.drifted(i + 1, newer)
            self.buckets.add = lambda e: newer      # what was found is not added twice
            now = self.buckets
            super()._adaptive(i, error, combined)
            del now.add
            return
        super()._adaptive(i, error, combined)

    def close(self, seq):
        last = self.runs[-1]
        last[2] = seq - 1
        length = last[2] - last[1]
        self.used[last[0]] += length
        source, back = last[0], len(self.runs) - 1
        while length < self.cfg.stable and back > 0:
            back -= 1
            source = self.runs[back][0]
            row = self.moves.get(source, {})
            if row.get(last[0], 0) > 0:
                row[last[0]] -= 1
            length = self.used[source]
        return source

    def change(self, rows, seq):
        c = self.cfg
        source = str(self.own - 1) if self.temp is not None else self.close(seq)
        pick = None if c.detector == "adaptive" else self.pick(source, rows)
        left = self.replaced.get(source, source)
        if pick is None:
            pick = str(self.own)
            self.own += 1
            self.fits[pick], self.used[pick], self.moves[pick] = self.fit(rows), 0, {}
            self.moves.setdefault(left, {})[pick] = 1
            self.log.append(("learn", seq, pick))
        else:
            row = self.moves.setdefault(left, {})
            row[pick] = row.get(pick, 0) + 1
            self.replaced.pop(pick, None)
            self.log.append(("reuse", seq, pick))
        self.runs.append([pick, seq, None])
        self.current, self.temp = pick, None
        self.buckets = type(self.buckets)(c.window, c.delta, c.max_buckets, c.min_side)
        used = 0 if c.detector == "windowed" else self.used[pick]
        self.due = None
        if pick not in self.known and pick not in self.foreign:
            self.due = seq + 1 + max(c.stable - used, 0)
        self.ask(rows, seq)

    def temporary(self, rows, seq):
        super().temporary(rows, seq)
        self.due, self.group = None, []

    def step(self, x, y):
        seq, w = len(self.y) + 1, self.cfg.window
        if seq == w + 1:
            self.own = 1
            self.X.append(np.asarray(x, float)), self.y.append(float(y))
            self.fits["0"], self.used["0"], self.moves["0"] = self.fit(range(w)), 0, {}
            self.current, self.runs = "0", [["0", w + 2, None]]
            self.log.append(("learn", seq, "0"))
            self.p.append(self.predict(self.fits["0"], [w])[0]), self.model_ids.append("0")
            self.ask(range(w), w)
            self.due = seq + 1 + self.cfg.stable
        elif seq <= w:
            super().step(x, y)
        else:
            i = seq - 1
            self.X.append(np.asarray(x, float)), self.y.append(float(y))
            value = self.predict(self.temp or self.fits[self.current], [i])[0]
            self.p.append(value), self.model_ids.append(self.current)
            if self.due is not None and seq >= self.due and not self.waiting:
                self.send(self.due)     # due before what the row itself brings
            getattr(self, "detect_" + self.cfg.detector)(i, abs(value - y))

    def send(self, seq):
        self.known.add(self.current)
        self.due = None
        if len(self.sent) > 1:
            rows = range(max(0, seq - self.cfg.window), seq)
            if len(self.similar([self.current, *self.sent], rows)) > 2:
                self.out.append(("suppress", seq, self.current))
                return
        self.sent.append(self.current)
        self.out.append(("publish", seq, self.current, tuple(self.group[1:])))


def full(source, k):
    return k if "-" in k else f"{source}-{k}"


def played(streams, edges, cfg, rule, epoch_rows):
    """All streams epoch by epoch, with the exchange as plain lists."""
    state = {d: Plain(cfg, rule) for d in streams}
    held, queue, sent, fits, log = set(), [], set(), {}, []
    told = {d: ([], []) for d in streams}
    for epoch in range(max(int(s[-1] - 1) // epoch_rows for s, _, _ in streams.values()) + 1):
        happened, running = [], set()
        for d, (given, X, y) in streams.items():
            p = state[d]
            mine = [k for k in range(len(given)) if (given[k] - 1) // epoch_rows == epoch]
            for k, fit in told[d][0]:
                if k not in p.pool:
                    p.offered[k] = fit
            for old, new in told[d][1]:
                if p.offered.pop(old, None) or p.pool.pop(old, None):
                    p.out.append(("discard", len(p.y), old, new))
                if old in p.group and old != p.current:
                    p.group.remove(old)
            waits = any(q[1] == d for q in queue)
            if p.waiting and not waits and p.due is not None:
                p.due = max(p.due, len(p.y) + 1)
            p.waiting = waits
            told[d] = ([], [])
            p.out = [e for e in p.out if e[0] == "discard"]
            for k in mine:
                p.step(X[k], y[k])
            if len(p.y) < len(given):
                running.add(d)
            happened += [(d, *e) for e in p.out]
            p.out = []
        before = set(held)
        publishes = [e for e in happened if e[1] == "publish"]
        deliveries = []
        for d, _, seq, k, similar in publishes:
            name = full(d, k)
            sent.add(name)
            fits[name] = state[d].fits[k]
            log.append((d, "published", name, None))
            for a, b in edges:
                if a == d:
                    close = [full(d, s) for s in similar]
                    if any((b, s) in before or s.split("-")[0] == b for s in close if s != name):
                        queue.append((b, d, name, seq))
                        log.append((d, "delayed", name, b))
                    else:
                        deliveries.append((b, d, name, "sent"))
        left = []
        for b, d, name, seq in queue:
            ends = sorted((e[2], e[1]) for e in happened if e[1] in ("confirm", "substitute")
                          and full(e[0], e[3]) == name and e[2] > seq)
            if not ends:
                left.append((b, d, name, seq))
            elif ends[0][1] == "confirm":
                deliveries.append((b, d, name, "released"))
            else:
                log.append((d, "dropped", name, b))
        queue = left
        deliveries = [x for x in dict.fromkeys(deliveries) if (x[0], x[2]) not in before]
        held |= {(b, name) for b, _, name, _ in deliveries}
        swaps = {}
        for e in sorted((e for e in happened if e[1] == "substitute"), key=lambda e: e[2]):
            if full(e[0], e[3]) in sent:
                swaps[(e[0], full(e[0], e[3]))] = full(e[0], e[4])
                fits.setdefault(full(e[0], e[4]), state[e[0]].fits[e[4]])
        subs = {}
        for (d, old), new in swaps.items():
            log.append((d, "replaced", old, new))
            for a, b in edges:
                if a == d:
                    if (b, old) in held:
                        told[b][1].append((old, new))
                        log.append((b, "discarded", old, new))
                    if (b, new) not in held and new.split("-")[0] != b:
                        subs.setdefault((b, new), (b, d, new, "replacement"))
        deliveries += list(subs.values())
        held |= set(subs)
        for b, d, name, kind in deliveries:
            log += [(d, kind, name, b), (b, "received", name, d)]
            if b in running:
                told[b][0].append((name, fits[name]))
        log += [(e[0], "suppressed", full(e[0], e[3]), None) for e in happened if e[1] == "suppress"]
        told = {d: t if d in running else ([], []) for d, t in told.items()}
    return state, log, queue


def concepts(seed, n, first, order):
    """Rows that follow the same few concepts in each stream, one after another."""
    rng = np.random.default_rng(seed)
    X = rng.random((n, 3))
    kind = np.array([order[k // 130 % len(order)] for k in range(n)])
    y = np.select([kind == 0, kind == 1, kind == 2], [X[:, 0], 1 - X[:, 1], X[:, 2] * 0.5 + X[:, 0] * 0.4], 0.3 * X[:, 0] - 0.2 * X[:, 2])
    return np.arange(first, first + n), X, y + rng.normal(0, 0.03, n)


CASES = [("windowed", "distance", 1), ("windowed", "information", 2), ("combined", "distance", 3), ("adaptive", "all", 4)]


def streams_of(seed):
    return {"a": concepts(seed, 900, 1, [0, 1, 0, 2]), "b": concepts(seed + 10, 700, 201, [0, 0, 1, 2]),
            "c": concepts(seed + 20, 800, 101, [1, 0, 2]), "d": concepts(seed + 30, 60, 1, [0])}


EDGES = [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a"), ("a", "d")]


@pytest.mark.parametrize("detector, rule, seed", CASES)
def test_matches_rows_and_lists(spark, detector, rule, seed):
    cfg = LoopConfig(detector=detector, window=30, eps=0.1, acc=0.6)
    streams = streams_of(seed)
    rows = [(d, int(s), x.tolist(), float(v)) for d, (given, X, y) in streams.items() for s, x, v in zip(given, X, y)]
    table = spark.createDataFrame(rows, "domain string, seq long, features array<double>, y double")
    result, book = exchange.run(table, spark.createDataFrame(EDGES, "src string, dst string"), cfg, 100, rule)
    state, log, queue = played(streams, EDGES, cfg, rule, 100)
    got = result.collect()
    for d, p in state.items():
        mine = sorted((r.seq, r.model_id, r.p) for r in got if r.domain == d and r.kind == "row")
        assert [m for _, m, _ in mine] == p.model_ids, d
        np.testing.assert_allclose([v for *_, v in mine], p.p, rtol=1e-8, atol=1e-8)
    counted = sorted((r.domain, r.kind, r.model_id, r.other or "") for r in book.counted.upto(1000).collect())
    assert counted == sorted((a, b, c, d or "") for a, b, c, d in log)
    assert sorted((r.target, r.source, r.model_id) for r in book.queue.collect()) == sorted(q[:3] for q in queue)
    kinds = {k for _, k, *_ in log}
    assert {"published", "sent", "received"} <= kinds


def test_cases_reach_every_rule():
    """The cases above delay, release, drop, suppress, replace and discard."""
    seen = set()
    for detector, rule, seed in CASES:
        cfg = LoopConfig(detector=detector, window=30, eps=0.1, acc=0.6)
        _, log, _ = played(streams_of(seed), EDGES, cfg, rule, 100)
        seen |= {k for _, k, *_ in log}
    assert {"delayed", "released", "dropped", "suppressed", "replaced", "discarded"} <= seen, seen


@pytest.mark.parametrize("detector", ["windowed", "combined", "adaptive"])
def test_splits_do_not_matter(detector):
    cfg = LoopConfig(detector=detector, window=30, eps=0.1, acc=0.6)
    given, X, y = concepts(5, 900, 1, [0, 1, 0, 2])
    offered = {"arrived": {"model_id": "z-1", "coef": [0.95, 0.0, 0.05], "intercept": 0.0}}

    def events(size):
        state, out = exchange.ExchangeLoop(cfg, "distance"), []
        state.obey(offered)
        for at in range(0, len(y), size):
            state.feed(X[at:at + size], y[at:at + size])
            out += [(e["kind"], e["seq"], e["model_id"], e.get("state")) for e in state.events]
            state.events = []
            state = exchange.ExchangeLoop(cfg, "distance", state.dump())
        return out
    whole = events(len(y))
    assert events(1) == events(37) == whole
    assert any(k in ("confirm", "substitute") for k, *_ in whole)


def test_no_rows_and_no_edges(spark):
    empty = spark.createDataFrame([], "domain string, seq long, features array<double>, y double")
    edges = spark.createDataFrame([], "src string, dst string")
    result, book = exchange.run(empty, edges, LoopConfig(), 100)
    assert result.count() == 0 and book.counted.upto(1000).count() == 0
    given, X, y = concepts(1, 300, 1, [0, 1])
    rows = spark.createDataFrame([("a", int(s), x.tolist(), float(v)) for s, x, v in zip(given, X, y)], empty.schema)
    cfg = LoopConfig(window=30, eps=0.1)
    alone, book = exchange.run(rows, edges, cfg, 50)
    plain = loop.run(rows, cfg)
    want = sorted((r.seq, r.model_id, r.p) for r in plain.filter("kind = 'row'").collect())
    assert sorted((r.seq, r.model_id, r.p) for r in alone.filter("kind = 'row'").collect()) == want
    assert exchange.counters(book, edges).count() == 0
    assert json.loads(exchange.ExchangeLoop(cfg).dump())["pool"] == {}
