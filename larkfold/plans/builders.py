"""Feature and label builders by dotted path: ``package.module:function``, looked up when a dataset is compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import import_module
from inspect import Parameter, signature

from pyspark.sql import DataFrame

Builder = Callable[..., DataFrame]


@dataclass(frozen=True)
class Step:
    """A builder, the parameters it gets, and the columns it needs and promises (none: not checked)."""

    ref: str
    params: dict = field(default_factory=dict)
    needs: tuple[str, ...] = ()
    makes: tuple[str, ...] = ()


def resolve(ref: str, allowed: tuple[str, ...] = ("larkfold.",)) -> Builder:
    """The function of a dotted path. Paths outside ``allowed`` packages, modules or names that don't exist, and what can't be called are errors that name the path."""
    module, _, name = ref.partition(":")
    if not name or not module.startswith(allowed):
        raise ValueError(f"{ref}: expected package.module:function within {', '.join(allowed)}")
    try:
        found = getattr(import_module(module), name)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"{ref} can't be found: {e}") from e
    if not callable(found):
        raise ValueError(f"{ref} is no function")
    return found


def build(df: DataFrame, steps: list[Step], allowed: tuple[str, ...] = ("larkfold.",)) -> DataFrame:
    """Applies the builders in turn. All paths and parameters are looked up before the first is applied; a step whose columns are missing, or that doesn't
    make what it promises, is an error. Plans only: no job runs here."""
    made = []
    for step in steps:
        f = resolve(step.ref, allowed)
        known = signature(f).parameters.values()
        unknown = set(step.params) - {p.name for p in known}
        if unknown and not any(p.kind is Parameter.VAR_KEYWORD for p in known):
            raise ValueError(f"{step.ref} has no parameters {', '.join(sorted(unknown))}")
        made.append((step, f))
    for step, f in made:
        if missing := [c for c in step.needs if c not in df.columns]:
            raise ValueError(f"{step.ref} needs {', '.join(missing)}")
        df = df.transform(f, **step.params)
        if missing := [c for c in step.makes if c not in df.columns]:
            raise ValueError(f"{step.ref} didn't make {', '.join(missing)}")
    return df
