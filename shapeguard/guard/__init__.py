"""Who may learn what: budgets, minimum group sizes and the guard that applies them."""

from shapeguard.guard.guard import Guard, GuardConfig

__all__ = ["Guard", "GuardConfig"]
