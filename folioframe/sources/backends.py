"""Backends by stage: their registry, the file that orders them, and chains in which a row goes on to the next backend."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stages with their backends, in the order of automatic choice (fixed values).
REGISTERED = {"document": ("pdf",), "ocr": ("paddle", "tesseract", "noop"), "layout": ("doclaynet", "paddle-layout", "text"), "table": ("table-transformer", "text")}
AUTO = "auto"


def read_order(content: str | None, registered: dict[str, tuple[str, ...]] = REGISTERED) -> dict[str, tuple[str, ...]]:
    """The order of backends per stage that a JSON file's text asks for (None: no file, the registered order).

    Only ``version`` (1) and ``auto_order`` are known; a stage's order is a list of registered names, each once and
    at least one. Anything else raises ValueError, which says what is wrong.
    """
    whole = {} if content is None else json.loads(content)
    if not isinstance(whole, dict) or not isinstance(asked := whole.get("auto_order", {}), dict):
        raise ValueError("the file and auto_order must be objects")
    if strange := [*(whole.keys() - {"version", "auto_order"}), *(asked.keys() - registered.keys())]:
        raise ValueError(f"unknown field or stage: {', '.join(sorted(strange))}")
    if (version := whole.get("version", 1)) != 1:
        raise ValueError(f"unsupported version: {version}")
    for stage, names in asked.items():
        if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            raise ValueError(f"the order of {stage} must be a list of names")
        if not names or len(set(names)) < len(names):
            raise ValueError(f"the order of {stage} is empty or repeats a name")
        if wrong := [n for n in names if n == AUTO or n not in registered[stage]]:
            raise ValueError(f"unregistered backends of {stage}: {', '.join(wrong)}")
    return registered | {stage: tuple(names) for stage, names in asked.items()}


def select_backends(stage: str, name: str, order: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """The chain of a stage: its whole order for ``auto``, else the one backend."""
    return order[stage] if name == AUTO else (name,)


def chain(backends: list[tuple[str, Column]]) -> Column:
    """struct(result, backend, failed): the first result that is not null, its backend, and the backends before it.

    A backend is a column (it may be a pandas UDF) that is null where it fails. If all fail, result and backend are
    null and failed names them all. Results of all backends must have one type.
    """
    works = [result.isNotNull() for _, result in backends]
    names = [name for name, _ in backends]
    tried, used = F.array(*[F.lit(n) for n in names]), F.lit(None).cast("string")
    for i in reversed(range(len(backends))):
        before = F.array(*[F.lit(n) for n in names[:i]]).cast("array<string>")
        tried, used = F.when(works[i], before).otherwise(tried), F.when(works[i], F.lit(names[i])).otherwise(used)
    return F.struct(F.coalesce(*[result for _, result in backends]).alias("result"), used.alias("backend"), tried.alias("failed"))
