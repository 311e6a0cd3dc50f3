"""keyfathom: translation-catalog liveness and corpus operators as Spark plans."""

from keyfathom.plans.engine import Outcome, run

__all__ = ["Outcome", "run"]
