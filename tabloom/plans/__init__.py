"""Plans: model, checks, rewrites, execution."""

from .execute import PlanError, Report, check_output, execute, fill_empty
from .model import ColumnSpec, Plan, Step
from .sanitize import sanitize
from .validate import Validation, validate_plan

__all__ = ["ColumnSpec", "Plan", "PlanError", "Report", "Step", "Validation", "check_output", "execute", "fill_empty", "sanitize", "validate_plan"]
