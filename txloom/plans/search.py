"""Seeded random search over model parameters, shared by any number of runs, with resume and a time budget."""

from __future__ import annotations

import hashlib
import math
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import append_trials, claim_trial, claimed_trials, read_trials


@dataclass(frozen=True)
class Range:
    """A parameter range: kind 'int', 'uniform' or 'loguniform', both ends included."""

    low: float
    high: float
    kind: str = "uniform"

    def at(self, share: float):
        """The value at a share of the range, from 0 up to but not including 1."""
        if self.kind == "int":
            return int(self.low) + int(share * (int(self.high) - int(self.low) + 1))
        if self.kind == "loguniform":
            return self.low * (self.high / self.low) ** share
        return self.low + share * (self.high - self.low)


# The ranges that are searched for each kind of booster.
SPACES = {
    "gbdt": {
        "num_leaves": Range(10, 1500, "int"),
        "max_depth": Range(10, 1000, "int"),
        "subsample_for_bin": Range(1000, 5000000, "int"),
        "min_child_samples": Range(200, 100000, "int"),
        "reg_alpha": Range(1e-11, 10.0, "loguniform"),
        "colsample_bytree": Range(1e-4, 1.0, "loguniform"),
        "learning_rate": Range(1e-5, 2.0, "loguniform"),
        "n_estimators": Range(500, 2000, "int"),
    },
    "dart": {
        "threshold": Range(1, 200, "int"),
        "num_leaves": Range(10, 1500, "int"),
        "subsample_for_bin": Range(1000, 5000000, "int"),
        "min_child_samples": Range(200, 100000, "int"),
        "reg_alpha": Range(1e-11, 10.0, "loguniform"),
        "colsample_bytree": Range(1e-4, 1.0, "loguniform"),
        "learning_rate": Range(1e-5, 2.0, "loguniform"),
    },
    "xgb": {
        "max_depth": Range(3, 1000, "int"),
        "learning_rate": Range(0.01, 0.5, "loguniform"),
        "min_child_weight": Range(3, 500, "int"),
        "subsample": Range(0.01, 0.99),
        "n_estimators": Range(500, 2000, "int"),
    },
    "cat": {
        "n_estimators": Range(1000, 3000, "int"),
        "learning_rate": Range(0.001, 1.0, "loguniform"),
        "od_wait": Range(100, 2000, "int"),
        "depth": Range(5, 12, "int"),
        "l2_leaf_reg": Range(1, 200, "int"),
    },
}
SPACES["goss"] = SPACES["dart"]

#: Spark ML grows trees no deeper than this.
DEEPEST = 30


def tree_params(drawn: dict) -> dict:
    """A drawn set in terms of Spark ML trees.

    Rounds, step, rows per leaf, rows and columns per tree carry over; leaves
    become the depth of a full tree with as many.  Depths end at ``DEEPEST``
    and steps at 1, the most Spark ML takes.  Parameters of engine internals
    (bin samples, leaf penalties, patience) and the selector's threshold have
    no counterpart in a tree ensemble and are left out.
    """
    out = {}
    if "n_estimators" in drawn:
        out["maxIter"] = int(drawn["n_estimators"])
    if "learning_rate" in drawn:
        out["stepSize"] = min(1.0, float(drawn["learning_rate"]))
    depths = [int(drawn[n]) for n in ("max_depth", "depth") if n in drawn]
    if "num_leaves" in drawn:
        depths.append(math.ceil(math.log2(drawn["num_leaves"])))
    if depths:
        out["maxDepth"] = min(DEEPEST, *depths)
    for name in ("min_child_samples", "min_child_weight"):
        if name in drawn:
            out["minInstancesPerNode"] = int(drawn[name])
    if "subsample" in drawn:
        out["subsamplingRate"] = float(drawn["subsample"])
    if "colsample_bytree" in drawn:
        out["featureSubsetStrategy"] = f"{drawn['colsample_bytree']:.6f}"
    return out


def share_of(seed: int, trial: int, name: str) -> float:
    """32 bits of a digest as a number from 0 up to 1; any SQL with md5 can repeat it."""
    return int(hashlib.md5(f"{seed}:{trial}:{name}".encode()).hexdigest()[:8], 16) / 2**32


def sample_params(space: dict[str, Range], trial: int, seed: int = 0) -> dict:
    """Parameters of a trial; they depend on seed and trial number only, so a resumed search goes on as before."""
    return {name: space[name].at(share_of(seed, trial, name)) for name in sorted(space)}


@dataclass
class Study:
    """A named search whose trials are kept in a shared history.

    Runs claim trial numbers before they work on them, so several runs, each
    with several trials at once, share one history without doing a trial twice.
    """

    spark: SparkSession
    path: str
    name: str
    space: dict[str, Range]
    seed: int = 0
    minimize: bool = True

    @property
    def history(self) -> DataFrame:
        return read_trials(self.spark, self.path, self.name)

    def open_trials(self) -> list[int]:
        """Claimed numbers without a score: trials under way in some run, or lost with it."""
        done = {r["trial"] for r in self.history.select("trial").collect()}  # one number per trial
        return [t for t in claimed_trials(self.spark, self.path, self.name) if t not in done]

    def run_trial(self, trial: int, objective: Callable[[dict], float]) -> float:
        params = sample_params(self.space, trial, self.seed)
        score = float(objective(params))
        append_trials(self.spark, self.path, [(self.name, trial, {k: float(v) for k, v in params.items()}, score)])
        return score

    def optimize(self, objective: Callable[[dict], float], trials: int | None = None, seconds: float | None = None,
                 parallelism: int = 1, finish_open: bool = False) -> None:
        """Run trials until a number is reached or a wall-clock budget is used up; each is saved when done.

        Up to ``parallelism`` trials run at once.  ``finish_open`` first runs
        the open trials, for when the runs that claimed them are gone; where
        one is not, its trial is computed twice and still stands once.
        """
        if trials is None and seconds is None:
            raise ValueError("give trials or seconds")
        started, lock = time.monotonic(), threading.Lock()
        left = self.open_trials() if finish_open else []
        done = 0

        def take() -> int | None:
            nonlocal done
            with lock:
                if (trials is not None and done >= trials) or (seconds is not None and time.monotonic() - started >= seconds):
                    return None
                number = left.pop(0) if left else claim_trial(self.spark, self.path, self.name)
                done += 1
                return number

        def work(_: int) -> None:
            while (trial := take()) is not None:
                self.run_trial(trial, objective)

        if parallelism <= 1:
            work(0)
            return
        pool = ThreadPool(processes=parallelism)
        try:
            pool.map(inheritable_thread_target(self.spark)(work), range(parallelism), chunksize=1)
        finally:
            pool.close()

    def best_params(self) -> dict:
        order = "score" if self.minimize else "-score"
        row = self.history.selectExpr("*", f"{order} as _o").orderBy("_o", "trial").drop("_o").first()
        if row is None:
            raise ValueError("no finished trial")
        return {k: int(v) if self.space[k].kind == "int" else v for k, v in row["params"].items()}
