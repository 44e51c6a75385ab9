"""What a folder holds, as a list that is published after the data are complete.

A writer puts its files into a folder of their own and then publishes a new state, a small JSON
file under the next number. Its name appears in one step, so a reader sees the state before
or the one after and never a part of it; what a failed writer left is in no state.
One writer at a time is assumed; a second one is refused where it finds its number taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

STATES = "_states"
#: Earlier states, and the data that only they name, stay for readers that began with them.
KEPT = 2


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, which need not exist; by the session's file system."""
    files, place = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


def fresh() -> str:
    """The name of a folder for new data."""
    return f"data-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in children(spark, f"{path}/{STATES}") if n.isdigit())


def _read(spark: SparkSession, path: str, number: int) -> dict:
    files, place = _files(spark, f"{path}/{STATES}/{number:012d}")
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> dict | None:
    """The last state of a folder; None where nothing was published."""
    numbers = _numbers(spark, path)
    return _read(spark, path, numbers[-1]) if numbers else None


def publish(spark: SparkSession, path: str, state: dict, replaced: dict | None) -> None:
    """Publish ``state`` after ``replaced``, the state it was made from."""
    numbers = _numbers(spark, path)
    now = _read(spark, path, numbers[-1]) if numbers else None
    if now != replaced:
        raise RuntimeError(f"{path} was changed by another writer")
    number = numbers[-1] + 1 if numbers else 1
    files, target = _files(spark, f"{path}/{STATES}/{number:012d}")
    _, draft = _files(spark, f"{path}/{STATES}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    stream.close()
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise RuntimeError(f"{path} was changed by another writer")


def named(state: dict | list | str | None) -> set[str]:
    """All folders of new data that a state names, at any depth."""
    if isinstance(state, str):
        first = state.partition("/")[0]
        return {first} if first.startswith("data-") else set()
    parts = state.values() if isinstance(state, dict) else state if isinstance(state, list) else ()
    return set().union(*map(named, parts))


def tidy(spark: SparkSession, path: str, kept: int = KEPT) -> None:
    """Remove states but for the last ``kept`` ones, and the data that no state left names.

    What a failed writer left goes too, so no other writer may be at work.
    """
    numbers = _numbers(spark, path)
    for number in numbers[:-kept]:
        remove(spark, f"{path}/{STATES}/{number:012d}")
    live = set().union(*(named(_read(spark, path, n)) for n in numbers[-kept:]))
    for name in children(spark, path):
        if name.startswith("data-") and name not in live:
            remove(spark, f"{path}/{name}")
