"""Connected components, which ``sondage.plans.components`` finds, for the operators here."""

from sondage.plans.components import components

__all__ = ["components"]
