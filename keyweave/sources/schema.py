"""Schema files: a line with the number of attributes and the join key's index, then a line `name type size` for each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

#: Type codes of a schema file. Fixed values.
INT, UINT, FLOAT, STRING, DATE = 1, 2, 3, 4, 5
DATE_BYTES = 10


@dataclass(frozen=True)
class Attribute:
    name: str
    code: int
    size: int

    @property
    def spark(self) -> T.DataType:
        if self.code == INT and self.size in (4, 8):
            return T.IntegerType() if self.size == 4 else T.LongType()
        if self.code == UINT and self.size in (4, 8):
            return T.LongType()
        if self.code == FLOAT and self.size in (4, 8):
            return T.FloatType() if self.size == 4 else T.DoubleType()
        if self.code == STRING and self.size > 0:
            return T.StringType()
        if self.code == DATE and self.size == DATE_BYTES:
            return T.DateType()
        raise ValueError(f"{self.name}: no type {self.code} of {self.size} bytes")

    @property
    def numpy(self) -> np.dtype:
        letter = {INT: "i", UINT: "u", FLOAT: "f"}.get(self.code, "S")
        return np.dtype(f"{'<' if letter != 'S' else ''}{letter}{self.size}")


@dataclass(frozen=True)
class Layout:
    """Attributes as they lie in a record: the join key first, the others in their order."""

    attributes: tuple[Attribute, ...]

    @property
    def key(self) -> str:
        return self.attributes[0].name

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.spark, metadata={"size": a.size}) for a in self.attributes])

    @property
    def record(self) -> np.dtype:
        return np.dtype([(a.name, a.numpy) for a in self.attributes])

    @property
    def text(self) -> str:
        return "\n".join([f"{len(self.attributes)} 0", *(f"{a.name} {a.code} {a.size}" for a in self.attributes)])

    def joined(self, other: Layout) -> Layout:
        """A result's record: this one's attributes and the other's without its key."""
        return Layout(self.attributes + other.attributes[1:])


def parse(text: str) -> Layout:
    lines = [x.split() for x in text.splitlines() if x.strip()]
    n, key = int(lines[0][0]), int(lines[0][1])
    attributes = [Attribute(name, int(code), int(size)) for name, code, size in lines[1 : n + 1]]
    if len(attributes) != n or not 0 <= key < n:
        raise ValueError(f"{n} attributes with key {key} were announced, {len(attributes)} follow")
    layout = Layout((attributes[key], *attributes[:key], *attributes[key + 1 :]))
    layout.struct  # noqa: B018  unknown types fail here
    return layout
