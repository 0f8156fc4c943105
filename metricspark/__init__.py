"""Auditable business metrics on Spark: definitions as texts, values or typed refusals as columns."""

from importlib import import_module

#: What the library exports, by module. Workers that need one module don't load the others.
EXPORTS = {
    "expressions": ("Unreadable", "condition", "fields", "formula"),
    "intent": ("answers", "claims", "intents"),
    "metrics": ("CODES", "computed_metrics", "metric_inputs", "metric_values"),
    "registry": ("compiled", "fingerprints", "gate", "load", "names", "resolved", "vocabulary"),
    "review": ("comparable",),
    "rules": ("findings",),
}
__all__ = [name for names in EXPORTS.values() for name in names]


def __getattr__(name: str):
    for module, names in EXPORTS.items():
        if name in names:
            return getattr(import_module(f"metricspark.operators.{module}"), name)
    raise AttributeError(name)
