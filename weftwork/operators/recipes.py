"""Named chains of steps: a lazy pipeline whose results later steps read by name."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

MOST_STEPS, MOST_NESTED, MOST_TASKS = 20, 3, 50
Step = tuple[str, Callable[..., DataFrame], dict]


class Recipes:
    """A registry of step functions and of presets made of them; presets are checked when they are added."""

    def __init__(self) -> None:
        self.steps: dict[str, Callable[..., DataFrame]] = {}
        self.presets: dict[str, list[tuple[str, str, dict]]] = {}

    def step(self, name: str, f: Callable[..., DataFrame]) -> None:
        self.steps[name] = f

    def preset(self, name: str, plan: list[tuple[str, str, dict]]) -> None:
        unknown = [s for _, s, _ in plan if s not in self.steps and s not in self.presets]
        if unknown or len(plan) > MOST_STEPS:
            raise ValueError(f"{name}: unknown steps {unknown}" if unknown else f"{name}: more than {MOST_STEPS} steps")
        self.presets[name] = plan

    def run(self, plan: str | list[tuple[str, str, dict]], depth: int = 1, **given: DataFrame) -> dict[str, DataFrame]:
        """Results by key. A step's argument ``"${key}"`` is the result of that key; an unknown key is empty (None)."""
        if depth > MOST_NESTED:
            raise ValueError(f"presets nest more than {MOST_NESTED} deep")
        out = dict(given)
        for key, name, arguments in self.presets[plan] if isinstance(plan, str) else plan:
            bound = {k: out.get(v[2:-1]) if isinstance(v, str) and v.startswith("${") and v.endswith("}") else v for k, v in arguments.items()}
            if name in self.presets:
                nested = self.run(name, depth + 1, **bound)
                out[key] = nested[self.presets[name][-1][0]]
            else:
                out[key] = self.steps[name](**bound)
        return out


def in_parallel(tasks: dict[str, Callable[[], object]], workers: int = 8) -> dict[str, tuple[bool, object]]:
    """Runs actions side by side in one application; (True, result) or (False, error) of each, in their order."""
    if len(tasks) > MOST_TASKS:
        raise ValueError(f"more than {MOST_TASKS} tasks")

    def one(f):
        try:
            return True, f()
        except Exception as e:  # a task's failure is its own
            return False, e

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(tasks, pool.map(one, tasks.values()), strict=True))
