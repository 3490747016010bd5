"""Model clients: what a client must do, and how a frame of conversations is sent to one.

A client is made once a task by a factory, so it is never shipped with a connection. A call is one retry,
then an empty answer with its error in a column; a failed call never fails the job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = "struct<role:string,content:string>"
HISTORY = f"array<{MESSAGE}>"


class ModelClient(Protocol):
    def chat(self, member: str, history: list[dict], row: dict) -> str:
        """The answer to a conversation."""

    def samples(self, row: dict, n: int) -> list[tuple[str, list[float]]]:
        """n answers with the log probabilities of their tokens."""

    def continued(self, history: list[dict], prefix: str) -> str:
        """The answer that begins with prefix, which is part of it."""

    def filled(self, before: str, after: str) -> str:
        """What stands between two texts."""


class Scripted:
    """A client that answers by functions; for tests and dry runs."""

    def __init__(self, say=None, draw=None) -> None:
        self.say, self.draw = say, draw

    def chat(self, member: str, history: list[dict], row: dict) -> str:
        return self.say(member, history, row)

    def samples(self, row: dict, n: int) -> list[tuple[str, list[float]]]:
        return [self.draw(row, k) for k in range(n)]


def scripted(say: Callable) -> Callable[[], Scripted]:
    return lambda: Scripted(say=say)


def scripted_samples(draw: Callable) -> Callable[[], Scripted]:
    return lambda: Scripted(draw=draw)


def plain(column: pa.Array) -> list:
    """As to_pylist(), but lists and structs are cut from whole columns of values, not made value by value."""
    if pa.types.is_list(column.type):
        values, found, at = plain(column.flatten()), [], 0
        for n in pc.list_value_length(column).to_pylist():
            found.append(None if n is None else values[at : at + n])
            at += n or 0
        return found
    if pa.types.is_struct(column.type) and column.type.num_fields:
        names = [field.name for field in column.type]
        found = [dict(zip(names, values)) for values in zip(*map(plain, column.flatten()))]
        return [x if valid else None for x, valid in zip(found, column.is_valid().to_pylist())] if column.null_count else found
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def _rows(batch: pa.RecordBatch, names: list[str]) -> list[dict]:
    return [dict(zip(names, values)) for values in zip(*(plain(batch.column(n)) for n in names))] if names else [{} for _ in range(batch.num_rows)]


def _answers(model: ModelClient, rows: Iterable[dict]) -> list[pa.Array]:
    """Contents, errors and seconds of a call a row."""
    contents, errors, seconds = [], [], []
    for row in rows:
        began, answer, error = time.perf_counter(), "", None
        for _ in range(2):
            try:
                answer, error = model.chat(row["member"], row["history"], row), None
                break
            except Exception as e:  # noqa: BLE001  any failure of a remote model is a row's error
                error = f"{type(e).__name__}: {e}"
        contents.append(answer)
        errors.append(error)
        seconds.append(time.perf_counter() - began)
    return [pa.array(contents, pa.string()), pa.array(errors, pa.string()), pa.array(seconds, pa.float64())]


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in rows.columns)


def speak(rows: DataFrame, factory: Callable[[], ModelClient]) -> DataFrame:
    """Appends the answer to `history` of each row, and adds err_msg and seconds. rows: member, history, and others."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_answers(model, _rows(batch, names))], [*names, "_said", "err_msg", "seconds"])

    said = rows.mapInArrow(run, f"{_fields(rows)}, _said string, err_msg string, seconds double")
    return said.withColumn("history", F.array_append("history", assistant(F.col("_said")))).drop("_said")


def speak_together(rows: DataFrame, factory: Callable[[], ModelClient]) -> DataFrame:
    """As speak(), for rows that hold all members' conversations, so that none has to be brought together later.

    rows: talks, an array of (member, history), and others. Adds `said`: an array of (content, err_msg, seconds), a call a talk.
    """
    names = rows.columns
    others = [n for n in names if n != "talks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            talks = plain(batch.column("talks"))
            answers = _answers(model, (row | talk for row, held in zip(_rows(batch, others), talks) for talk in held))
            ends = [0]
            for held in talks:
                ends.append(ends[-1] + len(held))
            said = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(answers, ["content", "err_msg", "seconds"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, said], [*names, "said"])

    return rows.mapInArrow(run, f"{_fields(rows)}, said array<struct<content:string,err_msg:string,seconds:double>>")


def draw(rows: DataFrame, factory: Callable[[], ModelClient], n: int) -> DataFrame:
    """Adds `sampled`: an array of (response, logprobs) of n answers."""
    names = rows.columns
    kind = pa.list_(pa.struct([("response", pa.string()), ("logprobs", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            found = [[{"response": r, "logprobs": list(p)} for r, p in model.samples(row, n)] for row in _rows(batch, names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*names, "sampled"])

    return rows.mapInArrow(run, f"{_fields(rows)}, sampled array<struct<response:string,logprobs:array<double>>>")


def _called(rows: DataFrame, factory: Callable[[], ModelClient], call: Callable[[ModelClient, dict], str], name: str) -> DataFrame:
    """Adds a call's text as `name`, and err_msg; one retry, then an empty text with the error."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            texts, errors = [], []
            for row in _rows(batch, names):
                text, error = "", None
                for _ in range(2):
                    try:
                        text, error = call(model, row), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a remote model is a row's error
                        error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], [*names, name, "err_msg"])

    return rows.mapInArrow(run, f"{_fields(rows)}, `{name}` string, err_msg string")


def continue_answers(rows: DataFrame, factory: Callable[[], ModelClient], name: str = "response") -> DataFrame:
    """Answers that begin with a given text. rows: history, prefix, and others; a null prefix is empty."""
    return _called(rows, factory, lambda model, row: model.continued(row["history"], row["prefix"] or ""), name)


def fill(rows: DataFrame, factory: Callable[[], ModelClient], name: str = "middle") -> DataFrame:
    """What stands between two texts. rows: before, after, and others; null texts are empty."""
    return _called(rows, factory, lambda model, row: model.filled(row["before"] or "", row["after"] or ""), name)


def user(content: Column) -> Column:
    """A user's message."""
    return F.struct(F.lit("user").alias("role"), content.alias("content"))


def assistant(content: Column) -> Column:
    """A model's message."""
    return F.struct(F.lit("assistant").alias("role"), content.alias("content"))
