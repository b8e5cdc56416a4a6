"""Platform adapters: which addresses a platform owns, and how its payloads become bundles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.payloads import BUNDLE, SHAPES, Shape, bundles_of, payload_of

# The addresses each built-in adapter accepts.
MATCHERS = {
    "chatgpt": r"^https://chatgpt\.com/",
    "deepseek": r"(?i)^https://chat\.deepseek\.com/",
    "gemini": r"^https://gemini\.google\.com/app(?:/|\z)",
    "aistudio": r"^https://aistudio\.google\.com/prompts/(?!new_chat)[^/?#]+",
}


@dataclass
class AdapterRegistry:
    adapters: dict[str, tuple[Callable[[Column], Column], Shape]] = field(default_factory=dict)

    def register(self, platform: str, matches: Callable[[Column], Column], shape: Shape) -> None:
        """``matches``: url column to boolean column; ``shape``: the columns of a payload row to a struct of `BUNDLE`."""
        self.adapters[platform] = (matches, shape)

    def platform_of(self, url: Column) -> Column:
        """The first registered platform whose matcher accepts the address."""
        return F.coalesce(*[F.when(matches(url), name) for name, (matches, _) in self.adapters.items()])

    def parse(self, payloads: DataFrame) -> DataFrame:
        """Bundles of all payloads whose address some adapter owns: one scan, and each row goes through its own shape."""
        if not self.adapters:
            raise ValueError("no adapter registered")
        owned = payloads.withColumn("platform", self.platform_of(F.col("url"))).where(F.col("platform").isNotNull())
        row, bundle = payload_of(owned), F.lit(None).cast(BUNDLE)
        for name, (_, shape) in reversed(self.adapters.items()):
            bundle = F.when(F.col("platform") == name, shape(row)).otherwise(bundle)
        return bundles_of(owned, bundle)


def default_registry() -> AdapterRegistry:
    registry = AdapterRegistry()
    for name, shape in SHAPES.items():
        registry.register(name, lambda url, pattern=MATCHERS[name]: url.rlike(pattern), shape)
    return registry
