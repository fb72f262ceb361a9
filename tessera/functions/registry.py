"""Named extension points: tasks, representation and search strategies, metrics, result adapters, loaders by suffix."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


class Registry:
    """Objects by normalised name; a name is taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, object] = {}

    @staticmethod
    def normal(name: str) -> str:
        return name.strip().lower().replace("_", "-")

    def register(self, name: str, entry: object | None = None):
        """Use as a call or as a decorator."""
        key = self.normal(name)

        def add(x):
            if key in self._entries:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._entries[key] = x
            return x

        return add if entry is None else add(entry)

    def get(self, name: str):
        try:
            return self._entries[self.normal(name)]
        except KeyError:
            raise KeyError(f"no {self.kind} {name!r}; there are {sorted(self._entries)}") from None

    def is_available(self, name: str) -> bool:
        return self.normal(name) in self._entries

    def names(self) -> list[str]:
        return sorted(self._entries)


tasks, representations, searches, adapters, tissue_loaders = (Registry(k) for k in ("task", "representation", "search", "adapter", "tissue loader"))


@dataclass
class Metrics:
    """Metric functions by a name that may hold parameters, such as hit_at_{k}."""

    entries: list[tuple[re.Pattern, tuple[str, ...], Callable]] = field(default_factory=list)

    def metric(self, pattern: str, *tasks: str):
        """Decorator; {k} in the pattern stands for a positive whole number, given to the function by that name."""
        compiled = re.compile(re.sub(r"\\{(\w+)\\}", r"(?P<\1>[1-9][0-9]*)", re.escape(pattern)))

        def add(f: Callable) -> Callable:
            if any(c.pattern == compiled.pattern and set(t) & set(tasks) for c, t, _ in self.entries):
                raise ValueError(f"metric {pattern!r} is registered already")
            self.entries.append((compiled, tasks, f))
            return f

        return add

    def resolve(self, task: str, name: str) -> tuple[Callable, dict[str, int]]:
        for pattern, tasks, f in self.entries:
            if task in tasks and (m := pattern.fullmatch(name.strip().lower())):
                return f, {k: int(v) for k, v in m.groupdict().items()}
        raise KeyError(f"no metric {name!r} for {task}")


metrics = Metrics()


@dataclass(frozen=True)
class Parameter:
    """A declared parameter: cast, checked against choices, clamped into its range."""

    kind: type = float
    default: object = None
    choices: tuple | None = None
    low: float | None = None
    high: float | None = None

    def resolve(self, name: str, given: dict):
        value = given.get(name, self.default)
        if value is None:
            return None
        value = self.kind(value)
        if self.choices is not None and value not in self.choices:
            raise ValueError(f"{name}: {value!r} is none of {list(self.choices)}")
        if self.low is not None:
            value = max(self.kind(self.low), value)
        return min(self.kind(self.high), value) if self.high is not None else value


def parameters(cls: type) -> dict[str, Parameter]:
    """Declared parameters of a class and its bases; the nearest declaration of a name counts."""
    found: dict[str, Parameter] = {}
    for base in reversed(cls.__mro__):
        found |= {k: v for k, v in vars(base).items() if isinstance(v, Parameter)}
    return found


def _fill() -> None:
    from tessera.operators import keyed, retrieval_metrics, search, select

    for name, strategy in select.REGISTRY.items():
        representations.register(name, strategy)
    for name, strategy in (("yottixel", search.Barcodes), ("pbss", search.Prototypes), ("cosine", search.Cosine), ("retccl", search.retccl), ("sish", keyed.sish)):
        searches.register(name, strategy)
    for name in ("hit", "precision", "map", "mmv", "macro_f1"):
        metrics.metric(f"{name}_at_{{k}}", "slide-retrieval")(getattr(retrieval_metrics, f"{name}_at_k"))


_fill()
