"""Concept memory of one stream: models, transitions between them, model in use.

All methods work on a handful of models; the rows they test on are at most one
window.
"""

from bisect import bisect_left
from dataclasses import asdict, dataclass, field

import numpy as np

from driftpool.functions.linalg import r2_score


@dataclass(slots=True)
class Model:
    coef: list
    intercept: float
    used_for: int = 0
    substituted: bool = False
    sub_id: str | None = None
    local: bool = True
    pcs: list | None = None

    def predict(self, X):
        return X @ np.asarray(self.coef) + self.intercept


FEW = 8             # models that are tried one by one without a look at their moments


class Index:
    """What the rules ask of all models, kept up with every change, so that a change costs no search through the memory.

    Places of runs count on when runs are dropped.
    """

    def __init__(self, memory: "Memory", stable: int):
        self.memory, self.stable = memory, stable
        self.born, self.next = {}, 0            # order of arrival
        self.half, self.listed = {}, []         # row of each model that may be tried again, and the model of each row
        self.coef, self.bias = None, np.zeros(0)
        self.replaced = set()
        self.places, self.at, self.anchor = [*range(len(memory.runs))], {}, None    # places of runs, those of a model, last stable run but one
        self.rows, self.into, self.zeros = {}, {}, set()    # counts of a row, models that lead to a model, counts gone to 0
        self.loose = set(memory.models)         # models that may be beyond reach
        for k in memory.models:
            self.arrived(k)
        for place, (k, _) in enumerate(memory.runs):
            self.at.setdefault(k, []).append(place)
            if place < len(memory.runs) - 1 and memory.models[k].used_for >= stable:
                self.anchor = place
        for a, row in memory.moves.items():
            for b, n in row.items():
                self.into.setdefault(b, set()).add(a)
                if n == 0:
                    self.zeros.add((a, b))

    # -- models -----------------------------------------------------------

    def arrived(self, k: str) -> None:
        self.born[k] = self.next
        self.next += 1
        self.changed(k)

    def changed(self, k: str) -> None:
        m = self.memory.models[k]
        (self.replaced.add if m.substituted else self.replaced.discard)(k)
        fit = not m.local or (m.used_for >= self.stable / 2 and not m.substituted)
        if fit and k not in self.half:
            if self.coef is None:
                self.coef, self.bias = np.zeros((FEW, len(m.coef))), np.zeros(FEW)
            elif len(self.half) == len(self.bias):
                self.coef = np.vstack([self.coef, np.zeros_like(self.coef)])
                self.bias = np.append(self.bias, np.zeros_like(self.bias))
            self.half[k] = len(self.listed)
            self.coef[len(self.listed)], self.bias[len(self.listed)] = m.coef, m.intercept
            self.listed.append(k)
        elif not fit and k in self.half:
            self._unlist(k)

    def _unlist(self, k: str) -> None:
        place, last = self.half.pop(k), self.listed.pop()
        if last != k:
            self.listed[place], self.half[last] = last, place
            self.coef[place], self.bias[place] = self.coef[len(self.listed)], self.bias[len(self.listed)]

    def gone(self, k: str) -> None:
        if k in self.half:
            self._unlist(k)
        self.replaced.discard(k)
        for held in (self.born, self.rows, self.into):
            held.pop(k, None)

    def in_order(self, ids) -> list:
        return sorted(ids, key=self.born.__getitem__)

    def candidates(self, X, y) -> list:
        """The models to try, in order of arrival: those whose error by the moments of the rows may be the least.

        The bound on rounding is far wider than the rounding, so the best of them is the best of all.
        """
        m = len(self.listed)
        if m <= FEW:
            return self.in_order(self.listed)
        w, b = self.coef[:m], self.bias[:m]
        mean_x, mean_y = X.mean(axis=0), y.mean()
        xs, ys = X - mean_x, y - mean_y
        a, c, spread = xs.T @ xs, xs.T @ ys, ys @ ys
        shift = mean_y - w @ mean_x - b
        left = spread - 2.0 * (w @ c) + ((w @ a) * w).sum(axis=1) + len(y) * shift * shift
        size = np.abs(w)
        wide = abs(mean_y) + size @ np.abs(mean_x) + np.abs(b)
        doubt = 1e-11 * (spread + 2.0 * (size @ np.abs(c)) + ((size @ np.abs(a)) * size).sum(axis=1) + len(y) * wide * wide)
        if y.min() == y.max():
            # a constant label knows right and wrong only, and wrong ones are equal: the first goes for all
            first = min(self.listed, key=self.born.__getitem__)
            return self.in_order({first, *(self.listed[i] for i in np.flatnonzero(~(left > doubt)))})
        return self.in_order(self.listed[i] for i in np.flatnonzero(~(left - doubt > np.nanmin(left + doubt))))

    # -- runs -------------------------------------------------------------

    def closed(self, k: str) -> None:
        self.changed(k)
        places = self.at[k]
        if self.memory.models[k].used_for >= self.stable and len(places) > 1:
            self.anchor = max(-1 if self.anchor is None else self.anchor, places[-2])

    def started(self, k: str) -> None:
        runs = self.memory.runs
        self.places.append(self.places[-1] + 1 if self.places else 0)
        self.at.setdefault(k, []).append(self.places[-1])
        if len(runs) > 1:
            before = runs[-2][0]
            if self.memory.models[before].used_for >= self.stable:
                self.anchor = self.places[-2]
            self.loose.add(before)

    def drop_runs(self) -> None:
        """Leave the runs from the last stable one before the present run on."""
        runs, gone = self.memory.runs, self.stop()
        if not gone:
            return
        for k in {k for k, _ in runs[:gone]}:
            places = self.at[k]
            del places[:bisect_left(places, self.anchor)]
            if not places:
                del self.at[k]
                self.loose.add(k)
        del runs[:gone]
        del self.places[:gone]

    def stop(self) -> int:
        """Number of the run at which a walk back ends."""
        return 0 if self.anchor is None else bisect_left(self.places, self.anchor)

    def passed(self, k: str) -> bool:
        """Whether no walk back can end at a model that is out of use, or undo a transition that leaves from it.

        The model has less than half the stable use and is not the newest, so it is no source of transitions again.
        """
        places = self.at.get(k)
        if places is None:
            return True
        return (self.memory.models[k].sub_id is None and places[0] != self.places[0] and places[-1] != self.places[-1]
                and not any(self.memory.moves.get(k, {}).values()))

    def drop_runs_of(self, k: str) -> None:
        for place in self.at.pop(k, ()):
            at = bisect_left(self.places, place)
            del self.places[at], self.memory.runs[at]

    # -- transitions ------------------------------------------------------

    def row(self, a: str):
        """Sum of the counts of a row, the greatest, and the models of each count."""
        if a not in self.rows:
            by = {}
            row = self.memory.moves.get(a, {})
            for b, n in row.items():
                by.setdefault(n, {})[b] = None
            self.rows[a] = [sum(row.values()), max(by, default=0), by]
        return self.rows[a]

    def counted(self, a: str, b: str, old: int | None, n: int) -> None:
        if n > 0:
            self.into.setdefault(b, set()).add(a)
        else:
            self.zeros.add((a, b))
            self.loose.add(a)
        if a in self.rows:
            row = self.rows[a]
            self._leave(row, b, old)
            row[0] += n - (old or 0)
            row[2].setdefault(n, {})[b] = None
            row[1] = n if n > row[1] else row[1] if row[1] in row[2] else max(row[2])

    @staticmethod
    def _leave(row, b: str, n: int | None) -> None:
        if n is not None:
            del row[2][n][b]
            if not row[2][n]:
                del row[2][n]

    def drop_zeros(self) -> None:
        for a, b in self.zeros:
            row = self.memory.moves.get(a)
            if row is not None and row.get(b) == 0:
                del row[b]
                if a in self.rows:
                    self._leave(self.rows[a], b, 0)
        self.zeros.clear()


@dataclass
class Memory:
    """``runs`` lists ``[model, start]`` from the last run a walk back can reach; those that change nothing may be missing."""

    models: dict = field(default_factory=dict)
    moves: dict = field(default_factory=dict)
    runs: list = field(default_factory=list)
    own: int = 0
    open: bool = False

    def dump(self) -> dict:
        return {"models": {k: asdict(m) for k, m in self.models.items()}, "moves": self.moves,
                "runs": self.runs, "own": self.own, "open": self.open}

    @classmethod
    def restore(cls, kept: dict) -> "Memory":
        return cls({k: Model(**m) for k, m in kept["models"].items()}, kept["moves"], kept["runs"],
                   kept["own"], kept["open"])

    _index = None

    def _indexed(self, stable: int) -> Index:
        if self._index is None or self._index.stable != stable:
            self._index = Index(self, stable)
        return self._index

    # -- runs -------------------------------------------------------------

    def start(self, model_id: str, seq: int) -> None:
        self.runs.append([model_id, seq])
        self.open = True
        if self._index:
            self._index.started(model_id)

    def close(self, end: int):
        """End the open run: its length counts as use. Returns ``(model, start, length)``."""
        model_id, start = self.runs[-1]
        length = max(end - start, 0)
        self.models[model_id].used_for += length
        self.open = False
        if self._index:
            self._index.closed(model_id)
        return model_id, start, length

    def settle(self, length: int, stable: int) -> str:
        """Model that the next transition leaves from.

        A run that was too short does not count: transitions into it are
        undone while walking back to the last model with enough use.
        """
        index = self._indexed(stable)
        here, last = len(self.runs) - 1, self.runs[-1][0]
        if length >= stable or not here:
            return last
        stop = index.stop()
        leading = index.into.get(last, set())
        if here - stop <= len(leading):
            for prior, _ in self.runs[stop:here]:
                self._undo(prior, last, 1)
        else:
            for prior in list(leading):
                places = index.at.get(prior, [])
                self._undo(prior, last, bisect_left(places, index.places[here]) - bisect_left(places, index.places[stop]))
                if not self.moves.get(prior, {}).get(last, 0):
                    leading.discard(prior)
        return self.runs[stop][0]

    def _undo(self, source: str, model_id: str, times: int) -> None:
        n = self.moves.get(source, {}).get(model_id, 0)
        if n > 0 and times:
            self._count(source, model_id, max(n - times, 0))

    def forget(self, stable: int) -> None:
        """Drop what no later rule can reach, so state stays bounded.

        Walks back stop at a stable model; a model with less than half the
        stable use is never tried again once it is out of use. Its runs go as
        well where no transition leaves from it, so a stream without any stable
        model does not keep all its models.
        """
        index = self._indexed(stable)
        index.drop_runs()
        for k in index.loose:
            m = self.models.get(k)
            if (m and k != str(self.own - 1) and m.local and not m.substituted
                    and m.used_for < stable / 2 and index.passed(k)):
                index.drop_runs_of(k)
                del self.models[k]
                self.moves.pop(k, None)
                index.gone(k)
        index.loose.clear()
        index.drop_zeros()

    # -- transitions ------------------------------------------------------

    def _left(self, source: str) -> str:
        model = self.models[source]
        return model.sub_id if model.substituted else source

    def _count(self, source: str, model_id: str, n: int) -> None:
        row = self.moves.setdefault(source, {})
        old, row[model_id] = row.get(model_id), n
        if self._index:
            self._index.counted(source, model_id, old, n)

    def learn(self, model: Model, source: str | None) -> str:
        model_id = str(self.own)
        if self._index:
            self._index.loose.add(str(self.own - 1))
        self.own += 1
        self.models[model_id] = model
        self.moves[model_id] = {}
        if self._index:
            self._index.arrived(model_id)
        if source is not None:
            self._count(self._left(source), model_id, 1)
        return model_id

    def repeat(self, model_id: str, source: str) -> None:
        left = self._left(source)
        self._count(left, model_id, self.moves.get(left, {}).get(model_id, 0) + 1)
        self.models[model_id].substituted = False
        if self._index:
            self._index.changed(model_id)

    def substitute(self, old: str, new: str, model: Model | None = None) -> None:
        """Let ``new`` take over the transitions of ``old``."""
        if new not in self.models:
            self.models[new] = Model(model.coef, model.intercept, pcs=model.pcs, local=False)
            self.moves[new] = {}
        merged = {}
        for a, row in self.moves.items():
            target = merged.setdefault(new if a == old else a, {})
            for b, n in row.items():
                b = new if b == old else b
                target[b] = target.get(b, 0) + n
        self.moves = merged
        gone = self.models[old]
        gone.substituted, gone.sub_id, gone.used_for = True, new, 0
        self._index = None

    # -- choice -----------------------------------------------------------

    def best(self, ids, X, y, floor: float | None):
        """Most accurate of ``ids`` on the rows, the first one on ties."""
        found = (None, -np.inf if floor is None else floor)
        for k in ids:
            value = r2_score(y, self.models[k].predict(X))
            if value > found[1]:
                found = (k, value)
        return found

    def choose(self, source: str, X, y, cfg):
        """Known model that fits the rows, or None if a new one must be learned.

        Order of trials: likely successors, all models with half the stable
        use, replaced models. The combined detector does not widen the search
        when there are likely successors, and never takes a negative R2.
        """
        index = self._indexed(cfg.stable)
        careful = cfg.detector == "combined"
        floor = 0.0 if careful else None
        total, top, by = index.row(source)
        if total == 0:
            found = self.best(index.candidates(X, y), X, y, floor)
            return found[0] if found[1] >= cfg.acc else None
        likely = []
        if top / total >= cfg.prob:
            likely = [k for k in by[top] if not (k in self.models and self.models[k].substituted)]
            if len(likely) > 1:
                likely = [k for k in self.moves[source] if k in set(likely)]

        def proven(ids):
            return [k for k in ids if k in self.models
                    and (not self.models[k].local or self.models[k].used_for >= cfg.stable)]

        found = (None, 0.0)
        if likely:
            found = self.best(proven(likely), X, y, floor)
        if not likely or (found[1] < cfg.acc and not careful):
            found = self.best(index.candidates(X, y), X, y, floor)
        if found[1] < cfg.acc:
            replaced = proven(index.in_order(index.replaced))
            if replaced:
                found = self.best(replaced, X, y, floor)
        return found[0] if found[0] is not None and found[1] >= cfg.acc else None

    def reusable(self, X, y, cfg) -> bool:
        return self.best(self._indexed(cfg.stable).candidates(X, y), X, y, 0.0)[1] >= cfg.acc
