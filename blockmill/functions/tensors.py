"""Tensor descriptions as columns and as values."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from blockmill.errors import External, Invalid

#: fixed names of the element types, and their bytes
DTYPE_BYTES = {"F64": 8, "F32": 4, "Flex32": 4, "F16": 2, "BF16": 2, "I64": 8, "I32": 4, "I16": 2, "I8": 1, "U64": 8, "U32": 4, "U16": 2, "U8": 1, "Bool": 1}
#: fixed names of the tensor kinds
KINDS = ("Bool", "Float", "Int")
SEQUENCES = ("Vec", "Array", "Tuple")


def shape_to_text(shape: list[int]) -> str:
    return " ".join(map(str, shape))


def shape_from_text(text: str) -> list[int]:
    parts = text.split()
    if not all(re.fullmatch(r"\+?\d+", p) for p in parts):
        raise External(f"Invalid shape: {text}")
    return [int(p) for p in parts]


def parse_dtype(text: str) -> str:
    if text not in DTYPE_BYTES:
        raise External(f"Invalid dtype: {text}")
    return text


def parse_kind(text: str) -> str:
    if text not in KINDS:
        raise External(f"Invalid kind: {text}")
    return text


def parse_container(name: str) -> tuple[str, str]:
    """(class, element name): what stands before the first colon, in lower case, and what follows; builtin without a colon."""
    kind, colon, rest = name.partition(":")
    return (kind.lower(), rest) if colon else ("builtin", name)


def is_sequence(name: str) -> bool:
    return name in SEQUENCES


@dataclass(frozen=True)
class TensorDesc:
    kind: str
    dtype: str
    shape: tuple[int, ...]

    def __post_init__(self):
        parse_kind(self.kind), parse_dtype(self.dtype)
        if any(d < 0 for d in self.shape):
            raise Invalid(f"negative dimension in {self.shape}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def num_elements(self) -> int:
        n = 1
        for d in self.shape:
            n *= d
        return n

    @property
    def size_estimate(self) -> int:
        return self.num_elements * DTYPE_BYTES[self.dtype]


@dataclass(frozen=True)
class ParamDesc:
    param_id: str
    tensor: TensorDesc


def shape_text(shape: Column) -> Column:
    return F.array_join(F.transform(shape, lambda d: d.cast("string")), " ")


def shape_array(text: Column) -> Column:
    """Fails the query on anything but whole numbers, none of them negative."""
    parts = F.filter(F.split(text, r"\s+"), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\+?\d+$"))
    return F.when(bad, F.raise_error(F.concat(F.lit("Invalid shape: "), text)).cast("array<bigint>")).otherwise(F.transform(parts, lambda p: p.cast("long")))


def rank(shape: Column) -> Column:
    return F.size(shape)


def num_elements(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, d: a * d)


def dtype_bytes(dtype: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in DTYPE_BYTES.items() for x in kv))
    return F.coalesce(F.element_at(known, dtype), F.raise_error(F.concat(F.lit("Invalid dtype: "), dtype)).cast("int"))


def size_estimate(dtype: Column, shape: Column) -> Column:
    return dtype_bytes(dtype) * num_elements(shape)


def container_class(name: Column) -> Column:
    return F.when(F.instr(name, ":") > 0, F.lower(F.substring_index(name, ":", 1))).otherwise(F.lit("builtin"))


def container_name(name: Column) -> Column:
    return F.when(F.instr(name, ":") > 0, F.substr(name, F.instr(name, ":") + 1)).otherwise(name)


def node_id(pre: Column) -> Column:
    return F.concat(F.lit("n:"), F.hex(pre.cast("long")))
