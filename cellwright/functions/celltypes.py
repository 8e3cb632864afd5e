"""Cell types (int, float, bool, date, str) over Arrow arrays, and a column's type by majority.

The Spark-side twin for single columns is :func:`cellwright.functions.infer.cell_type`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Codes in rising order of generality; a tie in a column's majority goes to the more general type.
BLANK, BOOL, DATE, INT, FLOAT, STR = range(6)
NAMES = np.array(["blank", "bool", "date", "int", "float", "str"])

# The words and patterns of each cell type.
BOOL_WORDS = ("true", "false", "yes", "no", "y", "n")
INT_PATTERN = r"^(?:[+-]?\d{1,3}(?:,\d{3})*|[+-]?\d+)$"
FLOAT_PATTERN = r"^(?:[+-]?\d+(?:,\d{3})*(?:\.\d+)?|[+-]?\d*\.\d+)$"
DATE_PATTERN = r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})$"


def strip(values: pa.Array) -> pa.Array:
    """Without white space at the ends, NULL as empty."""
    return pc.utf8_trim_whitespace(pc.fill_null(values, ""))


def cell_codes(values: pa.Array) -> np.ndarray:
    """The type code of each cell; NULL and blank cells are BLANK."""
    if len(values) == 0:
        return np.zeros(0, np.int8)
    v = strip(values)
    flag = lambda mask: mask.to_numpy(zero_copy_only=False)
    codes = np.full(len(v), STR, np.int8)
    for code, pattern in ((DATE, DATE_PATTERN), (FLOAT, FLOAT_PATTERN), (INT, INT_PATTERN)):
        codes[flag(pc.match_substring_regex(v, pattern))] = code
    codes[flag(pc.is_in(pc.utf8_lower(v), pa.array(BOOL_WORDS)))] = BOOL
    codes[flag(pc.equal(v, ""))] = BLANK
    return codes


class Grids:
    """A batch of ``ARRAY<ARRAY<STRING>>`` grids as flat numpy arrays: one entry a grid, a row or a cell."""

    def __init__(self, cells: pa.Array):
        rows = cells.flatten()
        lengths = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n = len(cells)
        self.grid_rows = lengths
        self.row_grid = np.repeat(np.arange(self.n), lengths)
        self.first_row = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.row_index = np.arange(len(self.row_grid)) - self.first_row[self.row_grid]
        self.width = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = rows.flatten()
        self.cell_row = np.repeat(np.arange(len(self.width)), self.width)
        start = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.cell_col = np.arange(len(self.cell_row)) - start[self.cell_row]
        self.row_start = start
        self.header_width = np.zeros(self.n, np.int64)
        has = lengths > 0
        self.header_width[has] = self.width[self.first_row[has]]
        self.is_header = self.row_index == 0
        self.right_width = ~self.is_header & (self.width == self.header_width[self.row_grid])
        self.codes = cell_codes(self.values)
        self.column_base = np.concatenate([[0], np.cumsum(self.header_width)])
        inside = self.right_width[self.cell_row]
        key = self.column_base[self.row_grid[self.cell_row]] + self.cell_col
        counted = inside & (self.codes != BLANK)
        counts = np.bincount(key[counted] * 6 + self.codes[counted], minlength=self.column_base[-1] * 6).reshape(-1, 6)
        # the last maximum wins: more general types have higher codes
        self.column_type = np.where(counts.sum(1) > 0, 5 - np.argmax(counts[:, ::-1], axis=1), BLANK)
        self.cell_column = np.where(inside, key, 0)

    def bad_cells(self) -> np.ndarray:
        """Cells, in rows of the right width, whose type does not fit their column."""
        if not len(self.cell_row):
            return np.zeros(0, bool)
        of = self.column_type[self.cell_column] if len(self.column_type) else np.zeros(len(self.codes), np.int64)
        fits = (self.codes == BLANK) | (of == STR) | (self.codes == of) | ((of == FLOAT) & (self.codes == INT))
        return self.right_width[self.cell_row] & ~fits
