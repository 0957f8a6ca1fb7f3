"""The concept memory finds what a search through all models and runs would find, without one."""

import numpy as np

from driftpool.operators import memory
from driftpool.operators.loop import StreamLoop
from driftpool.operators.memory import Memory, Model
from driftpool.plans.config import LoopConfig


def test_best_of_many_models_without_trying_each(monkeypatch):
    rng = np.random.default_rng(5)
    known = Memory()
    for _ in range(2000):
        known.learn(Model(rng.normal(size=3).round(1).tolist(), round(float(rng.normal()), 1), used_for=100), None)
    tried = []
    plain = memory.r2_score
    monkeypatch.setattr(memory, "r2_score", lambda y, p: tried.append(1) or plain(y, p))
    for k in range(40):
        x = rng.normal(size=(90, 3))
        y = known.models[str(37 * k)].predict(x) + (k % 2) * rng.normal(size=90)
        best = (None, -np.inf)
        for name, m in known.models.items():
            value = plain(y, m.predict(x))
            if value > best[1]:
                best = (name, value)
        cfg = LoopConfig(acc=0.2)
        assert known.choose("0", x, y, cfg) == (best[0] if best[1] >= cfg.acc else None)
    assert len(tried) < 40 * 20


def test_constant_labels_take_the_first_right_model():
    known = Memory()
    for k in range(30):
        known.learn(Model([0.0], 1.0 if k in (12, 20) else 2.0, used_for=100), None)
    assert known.choose("0", np.ones((90, 1)), np.ones(90), LoopConfig()) == "12"
    assert known.choose("0", np.ones((90, 1)), np.full(90, 7.0), LoopConfig()) is None


class Counted(dict):
    """Counts how often a row of transitions is looked up."""

    looks = 0

    def get(self, *key):
        Counted.looks += 1
        return super().get(*key)


def test_unstable_runs_are_not_walked_again_at_each_change():
    """Every model is too short-lived to end the walk back, and has one predecessor."""
    rng = np.random.default_rng(8)
    x, y = rng.random((4000, 2)), rng.random(4000)
    loop = StreamLoop(LoopConfig(eps=0.1, learner="mean"), registered={"mean": lambda x, y: (np.zeros(2), float(y.mean()))})
    loop.memory.moves, Counted.looks = Counted(), 0
    loop.feed(x, y)
    assert loop.memory.own > 1000
    assert Counted.looks <= 10 * loop.memory.own


def test_a_stream_without_stable_models_keeps_few():
    """What is forgotten changes no event and no transition, with each detector and with models of any length."""
    rng = np.random.default_rng(10)
    x = rng.random((6000, 3))
    w = np.array([[1, 0, 0], [0, 1, 0], [-1, 0, 1]])[(np.arange(len(x)) // 300) % 3]
    learners = {"mean": lambda x, y: (np.zeros(3), float(y.mean()))}
    for learner, label, most in (("mean", rng.random(6000), 10), ("mean", (x * w).sum(axis=1), 10), ("ridge", (x * w).sum(axis=1), 40),
                                 ("ridge", (x * w).sum(axis=1) + rng.normal(0, 0.3, 6000), 40)):
        for detector in ("windowed", "combined"):
            cfg = LoopConfig(detector=detector, eps=0.1, learner=learner)
            loop, whole = StreamLoop(cfg, registered=learners), StreamLoop(cfg, registered=learners)
            whole.memory.forget = lambda stable: None
            for one in (loop, whole):
                for at in range(0, 6000, 1000):
                    one.feed(x[at:at + 1000], label[at:at + 1000])
                one.finish()
            assert loop.events == whole.events
            assert len(loop.memory.models) <= most and len(loop.memory.runs) <= most
            kept = {a: {b: n for b, n in row.items() if n} for a, row in loop.memory.moves.items()}
            full = {a: {b: n for b, n in row.items() if n} for a, row in whole.memory.moves.items()}
            assert kept == {a: row for a, row in full.items() if a in kept}


def test_a_restored_memory_goes_on_as_the_kept_one():
    rng = np.random.default_rng(9)
    x = rng.random((12_000, 3))
    w = np.array([[1, 0, 0], [0, 1, 0], [-1, 0, 1]])[(np.arange(len(x)) // 300) % 3]
    y = (x * w).sum(axis=1)
    for detector in ("windowed", "combined"):
        cfg = LoopConfig(detector=detector, eps=0.1)
        whole, cut = StreamLoop(cfg), StreamLoop(cfg)
        for at in range(0, len(x), 700):
            whole.feed(x[at:at + 700], y[at:at + 700])
            cut.feed(x[at:at + 700], y[at:at + 700])
            events, cut = cut.events, StreamLoop(cfg, cut.dump())
            cut.events = events
        assert [(e["kind"], e["seq"], e["model_id"]) for e in whole.events] == [(e["kind"], e["seq"], e["model_id"]) for e in cut.events]
        assert whole.memory.dump() == cut.memory.dump()
