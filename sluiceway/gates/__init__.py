"""Gates: typed assertions on the tables of a stage."""

from sluiceway.gates.model import (
    BusinessRule, Freshness, Gate, GateResult, NotNull, Quarantine, ReferentialIntegrity, RowCountBounds,
    SchemaContract, StageOutcome, Unique, gate_from_dict,
)
from sluiceway.gates.fused import run_gates
from sluiceway.gates.sequential import run_gates_one_by_one

__all__ = [
    "BusinessRule", "Freshness", "Gate", "GateResult", "NotNull", "Quarantine", "ReferentialIntegrity",
    "RowCountBounds", "SchemaContract", "StageOutcome", "Unique", "gate_from_dict", "run_gates",
    "run_gates_one_by_one",
]
