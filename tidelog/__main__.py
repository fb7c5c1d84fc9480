"""``python -m tidelog --dir FOLDER``: one command a line from standard input, one answer a line."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from .errors import StoreError
from .options import from_args
from .plans.store import Store


def split(line: str) -> tuple[str, str, str]:
    """Command, key and value of a line, or ValueError; the same rules as in :mod:`.commands`."""
    word, *more = line.strip().split(None, 1)
    rest = more[0] if more else ""
    word = {"delete": "del", "quit": "exit"}.get(word.lower(), word.lower())
    if word == "put":
        parts = rest.split(None, 1)
        if len(parts) < 2:
            raise ValueError("expected: put <key> <value>")
        return word, parts[0], parts[1]
    if word in ("get", "del"):
        if not rest or len(rest.split()) != 1:
            raise ValueError(f"expected: {word} <key>")
        return word, rest, ""
    if word in ("stats", "exit"):
        return word, "", ""
    raise ValueError(f"unknown command: {word}")


def answers(store: Store, lines: Iterable[str]) -> Iterator[str]:
    for line in lines:
        if not line.strip():
            continue
        try:
            command, key, value = split(line)
            if command == "exit":
                return
            if command == "put":
                store.put(key.encode(), value.encode())
                yield "OK"
            elif command == "del":
                store.delete(key.encode())
                yield "OK"
            elif command == "get":
                found = store.get(key.encode())
                yield "(None)" if found is None else found.decode("utf-8", "replace")
            else:
                yield str(store.stats())
        except (ValueError, StoreError) as error:
            yield f"error: {error}"


def main() -> None:
    folder, options = from_args(sys.argv[1:])
    spark = SparkSession.builder.appName("tidelog").getOrCreate()
    store = Store(spark, folder if "://" in folder else f"file://{os.path.abspath(folder)}", options)
    try:
        for answer in answers(store, sys.stdin):
            print(answer, flush=True)
    finally:
        store.close()


if __name__ == "__main__":
    main()
