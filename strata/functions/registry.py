"""Target generators by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Generator = Callable[[DataFrame], DataFrame]
_generators: dict[str, Generator] = {}


def register(name: str, generator: Generator) -> Generator:
    """Register a generator; a name registered again takes the new one."""
    _generators[name] = generator
    return generator


def get_generator(name: str) -> Generator:
    if name not in _generators:
        raise KeyError(f"no target generator {name}; there are {', '.join(all_names())}")
    return _generators[name]


def all_names() -> list[str]:
    return sorted(_generators)


def run_all(inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The targets of every generator that has an input of its name."""
    return {name: _generators[name](inputs[name]) for name in all_names() if name in inputs}
