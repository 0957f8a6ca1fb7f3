"""Settings of the keyed loop and the ensembles."""

from dataclasses import dataclass

# Defaults of the experiments this library reproduces.
WINDOW = 90
LEAST_R2 = 0.5
LEAST_PROBABILITY = 0.5
ADAPTIVE_DELTA = 0.02
PERF_CULL = 0.0
MI_CULL = 2.0
ANGLE_CULL = 1.0
LEFT_OUT_VARIANCE = 0.05
MAX_ENSEMBLE = 10
ADD_WEIGHT = 0.1
DECAY = 0.8
NEIGHBOURS_ENSEMBLE = 7
NEIGHBOURS_CULL = 3
SIMILAR_MI = 0.2
RIDGE_CV_ALPHAS = (0.1, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0)
LEAST_HISTORY = 20


@dataclass(frozen=True)
class Workload:
    """What differs between the three kinds of input."""

    name: str
    label: str
    eps: float
    drop: tuple[str, ...]
    default_value: float | None = None
    default_column: str | None = None


# Label, opening error, dropped fields and default prediction by workload.
WORKLOADS = {
    "following": Workload("following", "FollowingTime", 0.1, ("Time",), default_value=3.0),
    "heating": Workload("heating", "dTemp", 0.5, ("date", "year", "month", "day", "heatingOn"),
                        default_column="oTemp"),
    "hyperplane": Workload("hyperplane", "y", 0.01, (), default_value=0.5),
}

DETECTORS = ("windowed", "adaptive", "combined")


@dataclass(frozen=True)
class LoopConfig:
    detector: str = "windowed"
    window: int = WINDOW
    acc: float = LEAST_R2
    prob: float = LEAST_PROBABILITY
    delta: float = ADAPTIVE_DELTA
    eps: float = 0.01
    learner: str = "ridge"
    default: float = 0.5
    components: bool = False
    left_out: float = LEFT_OUT_VARIANCE
    max_buckets: int = 2
    min_side: int = 10

    @classmethod
    def of(cls, workload: str, learner: str = "ridge", **settings) -> "LoopConfig":
        """Settings of a kind of input: opening error, default prediction and its form of the learner.

        A workload with a default column leaves the value to the stream's ``default`` column.
        """
        known = WORKLOADS[workload]
        values = {"eps": known.eps, "learner": learner if workload == "hyperplane" else f"{learner}_{workload}"}
        if known.default_value is not None:
            values["default"] = known.default_value
        return cls(**(values | settings))

    def __post_init__(self):
        if self.detector not in DETECTORS:
            raise ValueError(f"detector must be one of {DETECTORS}")
        if self.window < 4:
            raise ValueError("window must hold at least 4 rows")

    @property
    def stable(self) -> int:
        return 2 * self.window
