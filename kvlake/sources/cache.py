"""Least recently used runs in executor memory."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class RunCache:
    """Runs that reads keep at hand, up to a number of bytes of entries; larger runs pass by."""

    def __init__(self, capacity: int):
        self.capacity, self.used = capacity, 0
        self.hits = self.misses = 0
        self._held: OrderedDict[int, tuple[DataFrame, int]] = OrderedDict()

    def get(self, number: int, size: int, load: Callable[[], DataFrame]) -> DataFrame:
        if number in self._held:
            self.hits += 1
            self._held.move_to_end(number)
            return self._held[number][0]
        self.misses += 1
        if size > self.capacity:
            return load()
        while self.used + size > self.capacity:
            self.drop(next(iter(self._held)))
        frame = load().persist(StorageLevel.MEMORY_AND_DISK)
        self._held[number] = (frame, size)
        self.used += size
        return frame

    def drop(self, number: int) -> None:
        frame, size = self._held.pop(number, (None, 0))
        self.used -= size
        if frame is not None:
            frame.unpersist()

    def clear(self) -> None:
        for number in list(self._held):
            self.drop(number)

    def __contains__(self, number: int) -> bool:
        return number in self._held
