"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from sparkloom.plans.primitives import PRIMITIVES
from sparkloom.plans.programs import BASE

ALL = BASE | PRIMITIVES


def queries() -> dict:
    return {name: run for name, (run, _) in ALL.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
