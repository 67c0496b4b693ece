"""Failures that a caller can act on. What went wrong is a kind; the kind alone decides what a command line returns."""

from __future__ import annotations

# Exit code of a command line, by kind of failure.
EXIT_CODES = {"prediction": 1, "input": 2, "bundle": 3}


class LoadlensError(Exception):
    """A failure of a kind, with a short code for programs and a text for people."""

    kind = "prediction"

    def __init__(self, reason: str, text: str = "", **facts):
        self.reason, self.text, self.facts = reason, text, facts
        super().__init__(f"{reason}: {text}" if text else reason)

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.kind]

    def as_row(self) -> dict[str, str]:
        """For a table of failures."""
        return {"kind": self.kind, "reason": self.reason, "text": self.text}


class InputError(LoadlensError):
    """History, plan or target day break their contract."""

    kind = "input"


class BundleError(LoadlensError):
    """A bundle is not there, was changed, or does not fit."""

    kind = "bundle"


class PredictionError(LoadlensError):
    """Models gave something unusable."""
