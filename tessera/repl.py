"""The prompt: one statement a line."""

from __future__ import annotations

import sys
from typing import TextIO

from .engine import Engine, column
from .errors import EngineError
from .types import BOOL, INT64, render, varchar

PROMPT = "DB: "
CELL = 12
ROWS_SHOWN = 1000


def demo(engine: Engine) -> None:
    """The two demonstration tables; one has three rows."""
    columns = [column("id", INT64, False), column("name", varchar(255), False), column("age"), column("is_active", BOOL)]
    for name in ("users", "customers"):
        engine.create_table(name, columns)
    engine.insert("users", [(1, "Alice", 30, None), (2, "Bob", None, False), (3, "Charlie", 35, True)])


def grid(engine: Engine, text: str, limit: int = ROWS_SHOWN) -> str:
    """A statement's first rows as a numbered grid. A screen's worth: what the driver takes in has a bound."""
    rows = engine.rows(text, limit + 1)
    if not rows:
        return "Empty set (0 rows)\n"
    line = lambda first, cells: f"{first:<8}" + "".join(f" | {c:<{CELL}}" for c in cells)
    lines = [line("Row #", names := rows[0].__fields__), "-" * (8 + 15 * len(names))]
    lines += [line(i, map(render, r)) for i, r in enumerate(rows[:limit])]
    if len(rows) > limit:
        lines.append(f"(more than {limit} rows; the rest is not shown)")
    return "\n".join(lines) + "\n"


def loop(engine: Engine, source: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Read statements until ``exit``, ``:q`` or the end of input; an error is printed and the loop goes on."""
    while True:
        out.write(PROMPT)
        out.flush()
        text = source.readline()
        if not text or text.strip() in ("exit", ":q"):
            return
        if not text.strip():
            continue
        try:
            out.write(grid(engine, text))
        except EngineError as e:
            out.write(f"{e}\n")
