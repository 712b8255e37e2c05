"""``python -m tessera``: a prompt over the demonstration tables, or over the Parquet files of a folder."""

import sys
from pathlib import Path

from .engine import Engine
from .repl import demo, loop
from .session import local_session


def main() -> None:
    engine = Engine(local_session())
    if len(sys.argv) > 1:
        for path in sorted(Path(sys.argv[1]).glob("*.parquet")):
            engine.register_parquet(path.stem, str(path))
    else:
        demo(engine)
    loop(engine)


if __name__ == "__main__":
    main()
