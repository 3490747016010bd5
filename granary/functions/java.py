"""Java structure from text: a lexer and the facts read off its tokens, batch-wise in Arrow functions.

There is no grammar here: brackets, statements and argument lists are found on the token stream, so literals and
comments never confuse them. Broken sources give nulls or empty lists, not errors.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>->|::|&&|\|\||[<>=!+\-*/%&|^]=|\+\+|--|\S)', re.S)
# The assertion names of the usual test library.
ASSERTIONS = tuple("assertEquals assertTrue assertFalse assertNull assertNotNull assertThat assertArrayEquals assertNotEquals assertThrows assertSame assertNotSame".split())
MODIFIERS = frozenset("public protected private static final abstract synchronized native default strictfp transient volatile".split())
NOT_CALLS = frozenset("if for while switch catch return new synchronized super this throw assert else do try".split())
OPENING, CLOSING = "([{", ")]}"


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


@lru_cache(maxsize=1)
def tokens(source: str) -> tuple[Token, ...]:
    """Tokens without comments. The last text's are kept, as several facts are read off the same text."""
    return tuple([Token(kind, m[0], *m.span()) for m in TOKEN.finditer(source or "") if (kind := m.lastgroup) != "comment"])


def closing(found: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at `at`; -1 if none does."""
    depth = 0
    for i in range(at, len(found)):
        if found[i].kind == "sign" and found[i].text in OPENING:
            depth += 1
        elif found[i].kind == "sign" and found[i].text in CLOSING:
            depth -= 1
            if depth == 0:
                return i
    return -1


def arguments(source: str, found: list[Token], opening: int, end: int) -> list[str]:
    """The texts between top-level commas of a bracket; commas of type arguments don't part."""
    parts, depth, angle, start = [], 0, 0, found[opening].end
    for i in range(opening + 1, end):
        t = found[i].text
        if found[i].kind == "sign":
            depth += (t in OPENING) - (t in CLOSING)
            if t == "<" and i and found[i - 1].kind == "name" and found[i - 1].text[:1].isupper():
                angle += 1
            elif t == ">" and angle:
                angle -= 1
            elif t == "," and not depth and not angle:
                parts.append(source[start : found[i].start].strip())
                start = found[i].end
    last = source[start : found[end].start].strip()
    return [*parts, last] if parts or last else []


def assertions(source: str, any_name: bool = False) -> list[dict]:
    """Assertion statements in order: ord, start, end, statement (with its semicolon), name, args.

    any_name takes every call whose name begins with assert, in any case, not only the known ones.
    """
    found = tokens(source)
    out = []
    i = 0
    while i < len(found) - 1:
        if found[i].kind == "name" and (found[i].text.lower().startswith("assert") if any_name else found[i].text in ASSERTIONS) and found[i + 1].text == "(":
            end = closing(found, i + 1)
            if end < 0:
                break
            first = i
            while first >= 2 and found[first - 1].text == "." and found[first - 2].kind == "name":
                first -= 2
            stop = found[end + 1].end if end + 1 < len(found) and found[end + 1].text == ";" else found[end].end
            begin = found[first].start
            out.append({"ord": len(out), "start": begin, "end": stop, "statement": source[begin:stop], "name": found[i].text, "args": arguments(source, found, i + 1, end)})
            i = end
        i += 1
    return out


def argument_kind(text: str) -> str:
    """string, number, float, concat, arithmetic, boolean, null or other, by the top level of an argument."""
    found = tokens(text)
    if not found:
        return "other"
    top, depth = [], 0
    for t in found:
        if t.kind == "sign" and t.text in OPENING:
            depth += 1
        elif t.kind == "sign" and t.text in CLOSING:
            depth -= 1
        elif not depth:
            top.append(t)
    signs = [t.text for t in top[1:] if t.kind == "sign" and t.text in ("+", "-", "*", "/", "%")]
    if signs:
        return "concat" if "+" in signs and any(t.kind == "text" and t.text[0] == '"' for t in top) else "arithmetic"
    core = found[1:] if found[0].text == "-" and len(found) == 2 else found
    if len(core) == 1:
        t = core[0]
        if t.kind == "text":
            return "string" if t.text[0] == '"' else "other"
        if t.kind == "number":
            return "float" if re.search(r"[.fFdD]", t.text) and not t.text.startswith("0x") else "number"
        return {"true": "boolean", "false": "boolean", "null": "null"}.get(t.text, "other")
    return "other"


def expected_actual(args: list[str]) -> tuple[str | None, str | None]:
    """(expected, actual) of an equality assertion by the number and kinds of its arguments."""
    if len(args) == 2:
        return args[0], args[1]
    if len(args) == 3:
        first, last = argument_kind(args[0]), argument_kind(args[2])
        if first == "string":
            return args[1], args[2]
        if last in ("number", "float") or first == "float":
            return args[0], args[1]
        if first == "concat":
            return args[1], args[2]
        return None, None
    return (args[1], args[2]) if len(args) == 4 else (None, None)


def unary_subject(args: list[str]) -> str | None:
    """What a boolean or null assertion tests: its only argument, or the one that is no message."""
    if len(args) == 1:
        return args[0]
    if len(args) == 2:
        return args[0] if argument_kind(args[1]) == "string" else args[1]
    return None


def _outside(found: list[Token]) -> list[Token]:
    """The tokens outside of round brackets."""
    out, depth = [], 0
    for t in found:
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.text != ")":
            out.append(t)
    return out


def members(source: str, found: list[Token], start: int, end: int) -> list[dict]:
    """Methods declared right between two tokens: name, modifiers, return_type, params, text, start_line, end_line (from 1).

    Constructors, and what nested, local and anonymous classes declare, are none of them.
    """
    out = []
    first = i = start
    while i < end:
        t = found[i]
        if t.text in (";", "}"):
            first = i + 1
        elif t.text in OPENING:
            stop = closing(found, i)
            if stop < 0:
                break
            head = found[first:i]
            is_value = any(x.text == "=" for x in _outside(head))
            is_call = t.text != "(" or not head or head[-1].kind != "name" or (len(head) > 1 and head[-2].text in (".", "@", "new"))
            if is_call or is_value:
                # a block ends a declaration, but for the value of a field
                first = stop + 1 if t.text == "{" and not is_value else first
                i = stop + 1
                continue
            j = stop + 1
            while j < end and found[j].text not in "{;=":
                j += 1
            last = closing(found, j) if j < end and found[j].text == "{" else j
            if j >= end or found[j].text == "=" or last < 0:
                i = stop + 1
                continue
            modifiers = [x.text for x in head if x.text in MODIFIERS]
            notes = [head[k + 1].text for k in range(len(head) - 1) if head[k].text == "@"]
            kinds = [x for x in _outside(head[:-1]) if x.text not in MODIFIERS and x.text not in notes and x.text != "@"]
            if kinds and kinds[0].text == "<":  # type parameters
                depth = 0
                while kinds and (depth or kinds[0].text == "<"):
                    depth += (kinds[0].text == "<") - (kinds[0].text == ">")
                    kinds = kinds[1:]
            if kinds:
                begin = head[0].start
                out.append({
                    "name": head[-1].text, "modifiers": modifiers + ["@" + x for x in notes], "return_type": source[kinds[0].start : kinds[-1].end],
                    "params": arguments(source, found, i, stop), "text": source[begin : found[last].end],
                    "start_line": source.count("\n", 0, begin) + 1, "end_line": source.count("\n", 0, found[last].end) + 1,
                })
            i = last
            first = last + 1
        i += 1
    return out


def methods(source: str) -> list[dict]:
    """members() of the class that class_facts() takes, or of a text without a class."""
    found = tokens(source)
    body = class_body(found)
    return members(source, found, body[1] + 1, body[2]) if body else members(source, found, 0, len(found))


def invocations(source: str) -> list[str]:
    """Names of the methods called in a method's body, in order; constructors and declarations are none."""
    found = tokens(source)
    start = next((i for i, t in enumerate(found) if t.text == "{"), -1)
    out = []
    for i, t in enumerate(found[:-1]):
        if i <= start or t.kind != "name" or found[i + 1].text != "(" or t.text in NOT_CALLS:
            continue
        k = i
        while k >= 2 and found[k - 1].text == "." and found[k - 2].kind == "name":
            k -= 2
        before = found[k - 1].text
        if before in ("new", "@"):
            continue
        after = closing(found, i + 1) + 1
        if after < len(found) and found[after].text in ("{", "throws") and (found[k - 1].kind == "name" or before in (">", "]")):
            continue  # a method of a local or anonymous class
        out.append(t.text)
    return out


def body_statements(source: str) -> list[str]:
    """Top-level statements of a method's body."""
    found = tokens(source)
    start = next((i for i, t in enumerate(found) if t.text == "{"), -1)
    end = closing(found, start) if start >= 0 else -1
    if end < 0:
        return []
    out, begin, i = [], start + 1, start + 1
    while i < end:
        t = found[i].text
        if t in OPENING:
            i = closing(found, i)
            if t == "{" and not (i + 1 < end and found[i + 1].text in ("else", "catch", "finally", "while", ";", ")", ".")):
                out.append(source[found[begin].start : found[i].end])
                begin = i + 1
        elif t == ";":
            out.append(source[found[begin].start : found[i].end])
            begin = i + 1
        i += 1
    return out


def method_name(source: str) -> str | None:
    """The name of the first declared method; null if brackets don't match."""
    found = tokens(source)
    depth = 0
    for t in found:
        depth += (t.kind == "sign" and t.text in OPENING) - (t.kind == "sign" and t.text in CLOSING)
        if depth < 0:
            return None
    declared = methods(source)
    return declared[0]["name"] if declared and not depth else None


def local_variables(source: str) -> list[str]:
    """Local declarations of a method, as written."""
    return [s for s in body_statements(source) if re.match(r"(?:final\s+)?[A-Za-z_$][\w$.]*(?:<[^=;]*>)?(?:\[\])*\s+[A-Za-z_$][\w$]*\s*(?:=|;|,)", s) and not re.match(r"(?:return|throw|new|else)\b", s)]


def without_blank_runs(text: str) -> str:
    """Keeps the first blank line of each run, and none at the start."""
    kept: list[str] = []
    for line in text.split("\n"):
        if line.strip() or (kept and kept[-1].strip()):
            kept.append(line)
    return "\n".join(kept)


def split_by_assertion(source: str) -> list[str]:
    """The test itself and, unless it has exactly one assertion, one variant for each, the others removed.

    A removed statement goes wherever its text stands; a variant whose own assertion goes with it is left out.
    """
    found = assertions(source, any_name=True)
    out = [source]
    if len(found) == 1:
        return out
    for kept in found:
        text = source
        for x in found:
            if x is not kept:
                text = text.replace(x["statement"], "")
        if kept["statement"] in text:
            out.append(without_blank_runs(text))
    return out


def replace_assertion(source: str, new: str, name: str = "assertEquals") -> str:
    """The test with its first assertion of a name replaced by another statement."""
    found = next((a for a in assertions(source) if a["name"] == name), None)
    return source if found is None else source[: found["start"]] + new.rstrip(";") + ";" + source[found["end"] :]


def assertion_prefixes(source: str) -> list[dict]:
    """For each assertion the lines up to it, the lines of earlier ones blank, with a closing bracket: assertion, ut."""
    lines, out = source.split("\n"), []
    for x in assertions(source):
        first, last = source.count("\n", 0, x["start"]), source.count("\n", 0, x["end"])
        out.append({"assertion": x["statement"], "ut": "\n".join(lines[: last + 1]) + "\n}"})
        lines[first : last + 1] = [""] * (last + 1 - first)
    return out


def class_body(found: list[Token], name: str | None = None) -> tuple[int, int, int] | None:
    """(its word class, opening, closing) of a class: by name, else the first public one that is not abstract, else the first."""
    heads = [i for i, t in enumerate(found[:-1]) if t.text in ("class", "interface", "enum") and found[i + 1].kind == "name" and (not i or found[i - 1].text != ".")]
    if not heads:
        return None
    before = lambda i: {t.text for t in found[max(0, i - 4) : i]} & MODIFIERS
    chosen = next((i for i in heads if found[i + 1].text == name), None) if name else None
    if chosen is None:
        chosen = next((i for i in heads if "public" in before(i) and "abstract" not in before(i)), heads[0])
    opening = next((i for i in range(chosen, len(found)) if found[i].text == "{"), -1)
    end = closing(found, opening) if opening >= 0 else -1
    return (chosen, opening, end) if end >= 0 else None


def class_facts(source: str, name: str | None = None) -> dict | None:
    """Facts of the class that class_body() finds."""
    found = tokens(source)
    body = class_body(found, name)
    if body is None:
        return None
    chosen, opening, end = body
    head = [t.text for t in found[chosen:opening]]
    after = lambda word: " ".join(head[head.index(word) + 1 :]).split(" implements ")[0] if word in head else ""
    fields, i = [], opening + 1
    begin = i
    while i < end:
        t = found[i].text
        if t in "{(":
            stop = closing(found, i)
            is_initial = any(x.text == "=" for x in found[begin:i])
            i = stop
            if t == "{" and not is_initial:
                begin = i + 1
        elif t == ";":
            statement = source[found[begin].start : found[i].end]
            if "(" not in statement.split("=")[0]:
                fields.append(statement)
            begin = i + 1
        i += 1
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", source, re.M)
    return {
        "name": found[chosen + 1].text, "package": package[1] if package else "", "imports": re.findall(r"^\s*(import\s+[^;]+;)", source, re.M),
        "superclass": after("extends"), "interface": after("implements"), "fields": fields, "methods": members(source, found, opening + 1, end),
    }


ASSERTION_TYPE = "array<struct<ord:int,start:int,end:int,statement:string,name:string,args:array<string>>>"
METHOD_TYPE = "array<struct<name:string,modifiers:array<string>,return_type:string,params:array<string>,text:string,start_line:int,end_line:int>>"
CLASS_TYPE = f"struct<name:string,package:string,imports:array<string>,superclass:string,interface:string,fields:array<string>,methods:{METHOD_TYPE}>"


def each(function, kind: str):
    """A column function that applies a Python function batch-wise; made on use, as modules are imported on executors too."""

    def run(source: pd.Series) -> pd.Series:
        return source.map(lambda s: None if s is None else function(s))

    return lambda column: F.pandas_udf(run, kind)(column)


assertions_of = each(assertions, ASSERTION_TYPE)
methods_of = each(methods, METHOD_TYPE)
invocations_of = each(invocations, "array<string>")
statements_of = each(body_statements, "array<string>")
variables_of = each(local_variables, "array<string>")
name_of = each(method_name, "string")
variants_of = each(split_by_assertion, "array<string>")
prefixes_of = each(assertion_prefixes, "array<struct<assertion:string,ut:string>>")
kind_of = each(argument_kind, "string")


def class_of(source) -> Column:
    columns = ["name", "package", "imports", "superclass", "interface", "fields", "methods"]

    def run(sources: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([class_facts(s or "") or dict.fromkeys(columns) for s in sources], columns=columns)

    return F.pandas_udf(run, CLASS_TYPE)(source)


def facts_of(source) -> Column:
    """name, n (top-level statements), called and single (a body of one return) of a method, from one pass over the column."""

    def run(sources: pd.Series) -> pd.DataFrame:
        rows = []
        for s in sources:
            body = body_statements(s or "")
            rows.append((method_name(s or ""), len(body), invocations(s or ""), len(body) == 1 and body[0].startswith("return")))
        return pd.DataFrame(rows, columns=["name", "n", "called", "single"])

    return F.pandas_udf(run, "struct<name:string,n:int,called:array<string>,single:boolean>")(source)


def expected_of(args) -> Column:
    def run(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([expected_actual(list(a)) if a is not None else (None, None) for a in found], columns=["expected", "actual"])

    return F.pandas_udf(run, "struct<expected:string,actual:string>")(args)


def single_return(source: Column) -> Column:
    """Whether the body is one return statement."""
    found = statements_of(source)
    return (F.size(found) == 1) & F.element_at(found, 1).startswith("return")


def nloc(source: Column) -> Column:
    """Top-level statements of the body."""
    return F.size(statements_of(source))


def getters(found: Column) -> Column:
    """Public methods of a methods_of() array that are named get and something."""
    return F.filter(found, lambda m: F.array_contains(m["modifiers"], "public") & m["name"].startswith("get") & (m["name"] != "get"))


def generated_assertion(lines: list[str]) -> str:
    """The assertion in a model's fenced lines: a single line as it is, else the first call that begins with assert; '' without one."""
    if len(lines) == 1:
        return lines[0].strip()
    found = assertions("\n".join(lines), any_name=True)
    return found[0]["statement"] if found else ""


def first_assertion(code: Column) -> Column:
    """The statement of the first assertion; '' without one."""
    return F.coalesce(F.try_element_at(F.transform(assertions_of(code), lambda a: a["statement"]), F.lit(1)), F.lit(""))


def answered_assertion(answer: Column) -> Column:
    """The assertion in a model's answer, without white space outside of literals; '' without one."""
    from granary.functions.text import fenced_lines, strip_outside_literals

    return strip_outside_literals(each(lambda lines: generated_assertion(list(lines)), "string")(fenced_lines(answer)))
