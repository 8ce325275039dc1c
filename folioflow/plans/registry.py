"""Registers queries under their names, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: When the next embedding run starts; also the day whose validity counts.
NEXT_RUN, AS_OF = "2031-05-01 00:00:00", "2031-05-01"
CURRENT = "(select * from chunks qualify row_number() over (partition by chunk_id order by updated_at desc nulls last) = 1)"
STRIP = "trim({}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def query(sql: str | None = None):
    def register(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run

    return register
