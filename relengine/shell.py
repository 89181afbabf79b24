"""Results as text, and a line-by-line shell."""

from __future__ import annotations

import sys
from itertools import islice

from pyspark.sql import DataFrame

from relengine.plans.ast import SqlError
from relengine.session import Result, Session
from relengine.types import text_of

#: Rows that are printed of a result; of the others their number is.
SHOWN = 10_000


def _rows(n: int, more: str = "") -> str:
    return f"{n} {more}row" + "s" * (n != 1)


def render(rows: DataFrame, most: int = SHOWN) -> str:
    """Rows as lines of `a | b`, with a footer that counts them; NULL is empty. Rows come from the cluster a partition at a time.

    Beyond `most` rows a line says how many more there are; write the DataFrame to a table to have all.
    """
    texts = rows.toDF(*(f"_{i}" for i in range(len(rows.columns))))
    texts = texts.select(*(text_of(texts[c], f.dataType).alias(c) for c, f in zip(texts.columns, texts.schema.fields, strict=True)))
    found = texts.limit(most + 1).toLocalIterator()
    lines = [" | ".join((v or "").strip() for v in r) for r in islice(found, most + 1)]
    n = len(lines) if len(lines) <= most else rows.count()
    more = [f"... {_rows(n - most, 'more ')} not shown"] if n > most else []
    return "".join(x + "\r\n" for x in [*lines[:most], *more, _rows(n)])


def answer(result: Result) -> str:
    if result.counted:
        return f"{result.rows.first()[0]}\r\n"
    if result.rows is not None:
        return render(result.rows)
    return f"{result.count} {result.verb}\r\n" if result.count is not None else f"{result.verb}\r\n"


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    argv = sys.argv[1:] if argv is None else argv
    if len(argv) != 1:
        print("usage: python -m relengine.shell ROOT")
        return 2
    session = Session(SparkSession.builder.getOrCreate(), argv[0])
    while True:
        name = session.database.name if session.database else ""
        try:
            line = input(f"{name}> ")
        except (EOFError, KeyboardInterrupt):
            return 0
        if not line.strip():
            continue
        try:
            print(answer(session.execute(line)), end="")
        except SqlError as e:
            print(f"error: {e}")


if __name__ == "__main__":
    sys.exit(main())
