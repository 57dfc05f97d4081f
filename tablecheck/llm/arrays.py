"""SQL text for work on arrays in whole-table expressions: values computed once, and running sums."""

from __future__ import annotations

#: Elements of a block of running sums: an array that grows by one element at a time is copied each time.
BLOCK = 256


def bound(value: str, name: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, kind: str = "int") -> str:
    """The sum of what stands before each element of an array of numbers of a kind. Sums are gathered in blocks, and sums of blocks in turn."""
    none = f"named_struct('s', cast(0 as {kind}), 'all', cast(array() as array<{kind}>))"
    add = "named_struct('s', x.s + {0}, 'all', array_append(x.all, x.s))"
    block = f"aggregate(slice(_l, k * {BLOCK} + 1, {BLOCK}), {none}, (x, y) -> {add.format('y')})"
    blocks = f"transform(sequence(0, greatest(cast(ceil(size(_l) / {BLOCK}) as int) - 1, 0)), k -> {block})"
    before = f"aggregate(_b, {none}, (x, y) -> {add.format('y.s')}, x -> x.all)"
    return bound(values, "_l", bound(blocks, "_b", f"flatten(zip_with(_b, {before}, (x, o) -> transform(x.all, v -> v + o)))"))


def literal(text: str) -> str:
    """An expression for a string that needs no knowledge of how the parser reads escapes."""
    return f"decode(unhex('{text.encode().hex()}'), 'UTF-8')"
