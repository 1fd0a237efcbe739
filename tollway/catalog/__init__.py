"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations


def load():
    """Imports every query module and returns the filled registry."""

    from tollway.catalog import (  # noqa: F401
        baselines, folds, learned, ledgers, logs, prices, prompts, registry, streams,
    )

    return registry
