"""Columns of numbers that grow row by row and are read as arrays."""

from __future__ import annotations

import numpy as np


class Growing:
    """New rows wait in a list and are appended to arrays of doubling size when these are asked for."""

    def __init__(self, *kinds: type):
        self.arrays, self.size, self.waiting = [np.zeros(1024, k) for k in kinds], 0, []

    def __len__(self) -> int:
        return self.size + len(self.waiting)

    def add(self, *row) -> int:
        self.waiting.append(row)
        return self.size + len(self.waiting) - 1

    def read(self) -> list[np.ndarray]:
        if self.waiting:
            end = len(self)
            for i, values in enumerate(zip(*self.waiting, strict=True)):
                if end > len(self.arrays[i]):
                    self.arrays[i] = np.concatenate([self.arrays[i], np.zeros(max(end, len(self.arrays[i])), self.arrays[i].dtype)])
                self.arrays[i][self.size : end] = np.array(values, self.arrays[i].dtype)
            self.size, self.waiting = end, []
        return [a[: self.size] for a in self.arrays]


class GrowingRow:
    """One column that grows by many values at a time."""

    def __init__(self, kind: type):
        self.array, self.size, self.waiting = np.zeros(4096, kind), 0, []
        self.extend = self.waiting.extend

    def read(self) -> np.ndarray:
        if self.waiting:
            end = self.size + len(self.waiting)
            if end > len(self.array):
                self.array = np.concatenate([self.array, np.zeros(max(end, len(self.array)), self.array.dtype)])
            self.array[self.size : end] = self.waiting
            self.size = end
            self.waiting.clear()
        return self.array[: self.size]
