"""The providers that are known, and their rules folded into one expression over ``provider`` and a model's name.

A provider that is registered is read, named, skipped and priced like the others, without a change elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.rate_table import RATES

if TYPE_CHECKING:
    from tallyspark.sources.providers import Provider

_PROVIDERS: dict[str, Provider] = {}


def register(provider: Provider) -> Provider:
    """Make a provider known by its id and aliases, none of which another may have."""
    names = {provider.id, *provider.aliases}
    for other in _PROVIDERS.values():
        if other.id != provider.id and (taken := names & {other.id, *other.aliases}):
            raise ValueError(f"{', '.join(sorted(taken))} is {other.id}'s name already")
    _PROVIDERS[provider.id] = provider
    return provider


def forget(id_: str) -> None:
    _PROVIDERS.pop(id_, None)


def known() -> tuple[Provider, ...]:
    """In the order in which they were registered; the library's own first."""
    import tallyspark.sources.providers  # noqa: F401  registers the library's own

    return tuple(_PROVIDERS.values())


def named(name: str) -> Provider:
    """By id or alias, in any case."""
    for p in known():
        if name.lower() in (p.id, *p.aliases):
            return p
    raise ValueError(f"no provider is named {name!r}; there are {', '.join(p.id for p in known())}")


def folded(rule: Callable[[Provider], Column], other: Column, provider: str = "provider") -> Column:
    """The rule of each row's provider; ``other`` for providers that aren't known."""
    return reduce(lambda rest, p: F.when(F.col(provider) == p.id, rule(p)).otherwise(rest), reversed(known()), other)


def skipped(model: str = "model") -> Column:
    """Whether a call's model is none that counts."""
    return F.coalesce(folded(lambda p: p.skip_model(F.col(model)), F.lit(False)), F.lit(False))


def shown(model: str = "model") -> Column:
    return folded(lambda p: p.normalize_model(F.col(model)), F.col(model))


def feed_names(model: str = "model") -> Column:
    """The names under which a price feed may have a model, in order."""
    return folded(lambda p: p.rate_candidates(F.col(model)), F.array(model))


def builtin_names(model: str = "model") -> Column:
    """The names under which the built-in table may have it; none for providers that aren't in it."""
    none = F.array().cast("array<string>")
    return folded(lambda p: p.builtin_candidates(F.col(model)), none)


RATES_TYPE = f"struct<{','.join(f'{r}:decimal(18,8)' for r in RATES)}>"


def family(model: str = "model") -> Column:
    """The rates of the first family whose part the name holds; null for none."""

    def rule(p: Provider) -> Column:
        rates = lambda values: F.struct(*(F.lit(v).cast("decimal(18,8)").alias(r) for r, v in zip(RATES, values)))
        none = F.lit(None).cast(RATES_TYPE)
        return reduce(lambda rest, f: F.when(F.col(model).contains(f[1]), rates(f[2:])).otherwise(rest), reversed(p.family_rates()), none)

    return folded(rule, F.lit(None).cast(RATES_TYPE))
