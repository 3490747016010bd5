"""External tools as operators: commands run by tasks, each in a private working copy; logs come back as columns.

The tools (a JDK, Maven, a test generator, a bug benchmark's checkout command) are not part of this library: commands are
templates, and a missing tool is a row's status, not a failed job. What reads the logs is in functions.logs, and
the metrics over the outcome are in operators.metrics.
"""

from __future__ import annotations

import shlex
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import logs
from granary.storage import stored

RESULT = "exit_code int, log string, timed_out boolean"
OUTCOME = ("exit_code", "log", "timed_out", "compiled", "passed", "reason")


def run_commands(rows: DataFrame, command: str = "command", files: str | None = None, seconds: int = 600) -> DataFrame:
    """Runs each row's command without a shell in a fresh folder and adds exit_code, log and timed_out.

    files: a column map<path, text> written below the folder first. A command that can't start has exit code 127.
    The folder is a task's own scratch and is removed; nothing in it is an output.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, texts, late = [], [], []
            for row in batch.to_pylist():
                folder = Path(tempfile.mkdtemp(prefix="granary-run-"))
                try:
                    for name, text in (row[files] or [] if files else []):
                        target = (folder / name).resolve()
                        if not target.is_relative_to(folder.resolve()):
                            raise ValueError(f"{name} leaves the working folder")
                        target.parent.mkdir(parents=True, exist_ok=True)
                        target.write_text(text)
                    done = subprocess.run(shlex.split(row[command]), cwd=folder, capture_output=True, text=True, errors="replace", timeout=seconds, check=False)
                    codes.append(done.returncode)
                    texts.append(done.stdout + done.stderr)
                    late.append(False)
                except subprocess.TimeoutExpired as e:
                    codes.append(None)
                    texts.append(b"".join(x.encode() if isinstance(x, str) else x for x in (e.stdout, e.stderr) if x).decode(errors="replace") + f"\nstopped after {seconds} s")
                    late.append(True)
                except (OSError, ValueError) as e:
                    codes.append(127)
                    texts.append(f"{type(e).__name__}: {e}")
                    late.append(False)
                finally:
                    shutil.rmtree(folder, ignore_errors=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32()), pa.array(texts, pa.string()), pa.array(late, pa.bool_())], [*batch.schema.names, "exit_code", "log", "timed_out"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInArrow(run, f"{schema}, {RESULT}")


def compile_and_test(rows: DataFrame, compile_command: str, test_command: str, files: str = "files", seconds: int = 600) -> DataFrame:
    """compiled, passed, reason of each row, by one command that compiles and, if that works, one that tests.

    Both run in the same folder; the exit code of the second decides `passed`, and a row that passes has no reason.
    """
    both = F.lit(f"sh -c {shlex.quote('( ' + compile_command + ' ) && echo @@COMPILED && ( ' + test_command + ' )')}")
    done = run_commands(rows.withColumn("command", both), files=files, seconds=seconds).drop("command")
    compiled = F.contains("log", F.lit("@@COMPILED"))
    passed = compiled & (F.coalesce("exit_code", F.lit(1)) == 0)
    return done.withColumns({"compiled": compiled, "passed": passed, "reason": F.when(F.col("timed_out"), "timeout").when(~passed, logs.failure_class(F.col("log")))})


def fill_and_test(rows: DataFrame, compile_command: str, test_command: str, path: str, seconds: int = 600, placeholder: str = "<AssertionPlaceHolder>") -> DataFrame:
    """Each row's test with its assertion in place, written to `path`, compiled and run.

    rows: test_prefix, assertion and others. A row without an answer isn't run: its status is 'unfilled' and the outcome null.
    Every run has a folder of its own, so there is nothing to restore after it.
    """
    filled = substitute(rows, placeholder)
    ready = filled.filter("status = 'ready'").withColumn("files", F.create_map(F.lit(path), "test_case"))
    return compile_and_test(ready, compile_command, test_command, seconds=seconds).drop("files").unionByName(filled.filter("status is distinct from 'ready'"), allowMissingColumns=True)


def compile_repaired(rows: DataFrame, compile_command: str, test_command: str, path: str, seconds: int = 600) -> DataFrame:
    """Classes compiled and tested; those that don't compile lose the methods with an error and are tried once more.

    rows: head, methods (array of texts), tail, and others; a class is its parts, a line break between them. Adds rounds (1 or 2),
    n_lost and the outcome of the last round; `methods` are those of that round. The first round is stored, since commands aren't repeated.
    A class that doesn't compile though no error lies in a method has one round.
    """
    size = lambda text: F.size(F.split(text, "\n"))
    text = F.array_join(F.flatten(F.array(F.array("head"), F.col("methods"), F.array("tail"))), "\n")
    run = lambda part: compile_and_test(part.withColumn("files", F.create_map(F.lit(path), text)), compile_command, test_command, seconds=seconds).drop("files")
    begin = lambda i: F.aggregate(F.slice("methods", F.lit(1), i), size(F.col("head")) + 1, lambda s, m: s + size(m))
    hit = lambda m, i: F.exists("errors", lambda e: (e["line"] >= begin(i)) & (e["line"] < begin(i) + size(m)))
    first = run(rows).withColumn("errors", F.when(~F.col("compiled"), logs.compile_errors(F.col("log"))))
    left = F.filter("methods", lambda m, i: ~F.coalesce(hit(m, i), F.lit(False)))
    first = stored(first.withColumn("left", F.when(F.col("compiled"), F.col("methods")).otherwise(left)).withColumn("n_lost", F.size("methods") - F.size("left")))
    again = first.filter("n_lost > 0").withColumn("methods", F.col("left")).select(*rows.columns, "n_lost")
    settled = first.filter("n_lost = 0").select(*rows.columns, "n_lost", *OUTCOME).withColumn("rounds", F.lit(1))
    return settled.unionByName(run(again).withColumn("rounds", F.lit(2)).select(settled.columns))


def repaired(rows: DataFrame, methods: DataFrame, errors: DataFrame) -> DataFrame:
    """Methods to compile again after those with an error are dropped; rows: file; one round, as a class is tried twice."""
    return logs.methods_hit(errors, methods.join(rows.select("file"), "file", "left_semi"), keep=True)


def substitute(rows: DataFrame, placeholder: str = "<AssertionPlaceHolder>") -> DataFrame:
    """test_case with the generated assertion in place; a row without an answer gets the status 'unfilled'."""
    filled = F.replace("test_prefix", F.lit(placeholder), F.coalesce("assertion", F.lit("")))
    return rows.withColumns({"test_case": filled, "status": F.when(F.coalesce(F.trim("assertion"), F.lit("")) == "", "unfilled").when(F.contains(filled, F.lit(placeholder)), "unfilled").otherwise("ready")})
