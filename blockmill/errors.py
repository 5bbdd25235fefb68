"""The library's errors."""


class BlockmillError(Exception):
    """Base of the errors below."""


class ResourceNotFound(BlockmillError):
    """A shard or an attribute that is not there."""


class ParseError(BlockmillError):
    """An expression that cannot be parsed; with its text and the place of the fault, rendered with the part that is meant."""

    code = "XPST0003"

    def __init__(self, message: str, source: str | None = None, at: int = 0, end: int | None = None, note: str | None = None):
        self.message, self.source, self.note = message, source, note
        self.span = (at, len(source) if end is None else end) if source is not None else None
        super().__init__(self.render())

    def render(self) -> str:
        out = f"{self.code}: {self.message}"
        if self.note:
            out += f"\nnote: {self.note}"
        if self.span:
            a, b = self.span
            out += f"\n  {self.source}\n  {' ' * a}{'^' * max(1, b - a)}"
        return out


class Invalid(BlockmillError):
    """A value outside of its domain."""


class External(BlockmillError):
    """A text that is no value of the type it is read as."""


class DuplicateParamId(BlockmillError):
    def __init__(self, param_id: str, first: tuple[int, int], second: tuple[int, int]):
        super().__init__(f"parameter {param_id} is in group {first} and in group {second}")
        self.param_id, self.first, self.second = param_id, first, second
