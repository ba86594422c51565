"""Errors with the numeric codes that clients of the engine rely on."""

from __future__ import annotations

#: Code of each error; fixed values.
CODES = {
    "OK": 0, "NOT_FOUND": 1, "ALREADY_EXISTS": 2, "DIM_MISMATCH": 3, "DIM_TOO_LARGE": 4, "DIM_TOO_SMALL": 5,
    "INVALID_NAME": 6, "IO_ERROR": 7, "SERIALIZE_ERROR": 8, "CORRUPTED_SEGMENT": 9, "INTERNAL_ERROR": 10, "INVALID_METRIC": 11,
}


class VectorError(Exception):
    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.code = kind, CODES[kind]


class FilterSyntaxError(ValueError):
    """A metadata filter that the grammar doesn't accept."""
