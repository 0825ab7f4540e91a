"""The states of one build."""

from __future__ import annotations

# The order of states.
ORDER = ("pending", "scanning", "parsing", "chunking", "embedding", "graphing", "storing", "complete")
TERMINAL = ("complete", "error")


class StateError(RuntimeError):
    """A step that isn't allowed."""


class BuildState:
    """Forward one state at a time; `error` from any state that isn't terminal."""

    def __init__(self) -> None:
        self.state, self.history, self.wrote = ORDER[0], [ORDER[0]], False

    def to(self, state: str) -> None:
        if self.state in TERMINAL:
            raise StateError(f"{self.state} is terminal")
        if state != "error" and (state not in ORDER or ORDER.index(state) != ORDER.index(self.state) + 1):
            raise StateError(f"no step from {self.state} to {state}")
        self.state = state
        self.history.append(state)
        self.wrote = self.wrote or state == "storing"
