"""Property graphs and gather-apply-scatter programs on Spark DataFrames."""

from sparkgas.graph import PropertyGraph
from sparkgas.functions.reducers import Builtin, Fold, Members, Mex, Reducer
from sparkgas.plans.gas import GasResult, NotConverged, Program, run_gas, signal_frontier, superstep
from sparkgas.plans.rounds import iterate_blocked, iterate_fixed

__all__ = [
    "Builtin",
    "Fold",
    "GasResult",
    "Members",
    "Mex",
    "NotConverged",
    "Program",
    "PropertyGraph",
    "Reducer",
    "iterate_blocked",
    "iterate_fixed",
    "run_gas",
    "signal_frontier",
    "superstep",
]
