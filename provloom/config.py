"""Settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Where a stored graph lies, and a name for the session."""

    graph: str = field(default_factory=lambda: os.environ.get("PROVLOOM_GRAPH", ""))
    app: str = field(default_factory=lambda: os.environ.get("PROVLOOM_APP", "provloom"))

    def missing(self) -> list[str]:
        return [n for n, v in (("PROVLOOM_GRAPH", self.graph), ("PROVLOOM_APP", self.app)) if not v]

    def check(self) -> None:
        """ValueError that names what isn't set."""
        if self.missing():
            raise ValueError(f"not set: {', '.join(self.missing())}")
