"""Secret scan: pattern spans, and name-literal pairs of an assignment-aware lexer.

The base kinds are patterns. The lexer then reads assignments, mappings and key-value lines (`a = "b"`,
`"a": 'b'`, `a := b`, `a => b`), follows constants by name (`x = "..."` and later `api_key = x`),
joins literals and constants (`"a" + "b"`, `BASE + "b"`), and scores each literal by how sensitive the target name is and how
random the literal looks. Other forms that give a name to a literal are read beside it: subscripts (`env["NAME"] = "..."`), prefixed and
triple-quoted strings, arguments (`define("NAME", "...")`), attributes and elements of XML, indented blocks of YAML, and pairs inside a connection
string or query. Literals that score at least `least` add spans of kind `literal`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

NAME = r"[A-Za-z_$][A-Za-z0-9_.$-]*+"
PAIR = re.compile(
    rf"""(?P<q>["']?)(?<![A-Za-z0-9_.$-])(?P<name>{NAME})(?P=q)[\x20\t]*+(?::=|=>|==?|:)[\x20\t]*+"""
    rf"""(?:(?P<text>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')|(?=(?P<bare>[^\s,;"'<>(){{}}\[\]])))""",
)
LITERAL = r"""(?:"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')"""
MORE = re.compile(rf"""\s*+\+\s*+(?:({LITERAL})|({NAME}))""")
SIGN = r"[\x20\t]*+(?::=|=>|==?|:)[\x20\t]*+"
#: Forms that name a literal, by a text that each needs.
FORMS = [
    (("]",), re.compile(rf"""\[[\x20\t]*+["'](?P<name>{NAME})["'][\x20\t]*+\]{SIGN}(?P<text>[rbfuRBFU]{{0,2}}{LITERAL})""")),
    (('"', "'"), re.compile(rf"""(?<![A-Za-z0-9_.$-])(?P<name>{NAME})["']?{SIGN}(?P<text>[rbfuRBFU]{{1,2}}{LITERAL})""")),
    (("(",), re.compile(rf"""\(\s*+["'](?P<name>{NAME})["']\s*+,\s*+(?P<text>{LITERAL})""")),
    (('"""', "'''"), re.compile(rf"""(?<![A-Za-z0-9_.$-])(?P<name>{NAME})["']?\]?{SIGN}[rbfuRBFU]{{0,2}}(?P<q>\"\"\"|''')(?P<text>.*?)(?P=q)""", re.DOTALL)),
    (("|", ">"), re.compile(rf"""^(?P<indent>[\x20\t]*+)(?:-[\x20\t]+)?["']?(?P<name>{NAME})["']?[\x20\t]*+:[\x20\t]*+[|>][+-]?[0-9]?[\x20\t]*+\n(?P<text>(?:(?P=indent)[\x20\t]+\S.*\n?|[\x20\t]*+\n)+)""", re.MULTILINE)),
    ((";", "&", "?"), re.compile(rf"""(?<=[;&?"'])\x20*+(?P<name>{NAME})\x20*+=\x20*+(?P<text>[^;&"'\s<>]+)""")),
    (("</",), re.compile(rf"""<(?P<name>{NAME})(?:\s[^<>]*+)?>\s*+(?P<text>[^<>\s][^<>]*+)</(?P=name)\s*>""")),
]
#: Pieces of constants joined of constants; one of more isn't followed further, so that chains of them take linear time.
PIECES = 64
TAG = re.compile(r"<[A-Za-z][^<>]*+>")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][A-Za-z0-9_.:-]*+)\s*+=\s*+("[^"<>]*+"|'[^'<>]*+')""")
ENCODED = re.compile(r"(?:-----[A-Z0-9 ]+-----|[A-Za-z0-9+/=_-]{16,}|[A-Za-z0-9+/_-]*=*$)")
BARE = re.compile(r"""[^\s,;"'<>(){}\[\]]++""")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Name parts and their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "pass": 0.7, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "cert": 0.4,
}
KEY_OF = frozenset("api access private secret auth encryption signing account client master ssh storage service license deploy".split())
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|example|your[_-].*|my[_-].*|test|dummy|todo|<.*>|\$\{.*|\{\{.*|%\(.*|\$[A-Z_]+)$")

#: The placeholders that can have a sign in them.
MINE = re.compile(r"(?i)(?:your|my)[_-]|\$(?:[A-Z_]+)$")


def name_weight(name: str) -> float:
    """How sensitive a target name is, 0 to 1."""
    parts = [x.lower() for x in PARTS.findall(name)]
    weight = max((SENSITIVE.get(x, 0.0) for x in parts), default=0.0)
    if any(a in KEY_OF and b in ("key", "keys") for a, b in zip(parts, parts[1:], strict=False)):
        weight = max(weight, 1.0)
    return weight


def entropy(counts: Counter) -> float:
    """Bits a character."""
    size = sum(counts.values())
    return -sum(n / size * math.log2(n / size) for n in counts.values()) if size else 0.0


def likeness(counts: Counter) -> float:
    """How secret-like a literal of these characters is, 0 to 1."""
    letters = "".join(counts)
    kinds = sum(bool(re.search(p, letters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.25 * min(entropy(counts), 4) * min(1, sum(counts.values()) / 12) + 0.15 * (kinds - 1))


def literal_likeness(literal: str) -> float:
    """The likeness of a literal; 0 if it is short, a placeholder or has white space."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or re.search(r"\s", literal):
        return 0.0
    return likeness(Counter(literal))


def literal_score(name: str, literal: str) -> float:
    """Weight of the name times how secret-like the literal is, 0 to 1."""
    weight = name_weight(name)
    return weight * literal_likeness(literal) if weight else 0.0


def literal_of(text: str) -> tuple[str, int, int]:
    """(content, characters before it, characters after it) of a quoted literal, with its prefix if any."""
    start = 0
    while text[start : start + 1].isalpha():
        start += 1
    quoted = text[start : start + 1] in ('"', "'")
    return (text[start + 1 : -1], start + 1, 1) if quoted else (text, 0, 0)


def lexed(text: str) -> Iterator[tuple[str, str | None, list[tuple[int, int]]]]:
    """(target name, literal, spans) of every pair, constants followed; the spans are those of the literal's pieces.

    A bare literal with a sign in it is a chain (`a=b=c`), which is read again from its start; its literal is None,
    the text of its span, so that long chains take linear time.
    """
    known: dict[str, tuple[str | None, list[tuple[int, int]]]] = {}
    at = stop = stripped = sign = 0
    while m := PAIR.search(text, at):
        name = m["name"]
        if m["text"] is not None:
            value, spans = m["text"][1:-1], [(m.start("text") + 1, m.end("text") - 1)]
            at, joins = m.end(), True
        else:
            start = m.start("bare")
            if start >= stop:
                stop = stripped = BARE.match(text, start).end()
                while stripped > start and text[stripped - 1] in ".,:":
                    stripped -= 1
                sign = max(text.rfind(c, start, stripped) for c in ":=")
            end = max(start, stripped)
            value, at = (None, start) if sign >= start else (text[start:end], stop)
            spans, joins = [(start, end)], value in known
            if joins:
                value, spans = known[value]
        if joins and value is not None:
            pieces, spans, here = [value], list(spans), m["text"] is not None
            while more := MORE.match(text, at):
                if more[1] is not None:
                    pieces.append(more[1][1:-1])
                    # a literal right after another one makes its span longer
                    place = (spans.pop()[0] if here else more.start(1) + 1, more.end(1) - 1)
                    spans.append(place)
                    here = True
                else:
                    other, places = known.get(more[2], (None, []))
                    if other is None or len(spans) + len(places) > PIECES:
                        break
                    pieces.append(other)
                    spans += places
                    here = False
                at = more.end()
            value, spans = "".join(pieces), list(dict.fromkeys(spans))
        spans = [(a, b) for a, b in spans if b > a]
        if spans:
            known[name] = (value, spans)
            yield name, value, spans


def named_literals(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(name, literal, spans) of the other forms that name a literal."""
    for needs, form in FORMS:
        if any(x in text for x in needs):
            for m in form.finditer(text):
                value, before, after = literal_of(m["text"])
                kept = value.rstrip()
                if kept:
                    start = m.start("text") + before
                    yield m["name"], kept, [(start, start + len(kept))]
    if "<" in text:
        for tag in TAG.finditer(text):
            found = {a[1].lower(): a for a in ATTRIBUTE.finditer(tag[0])}
            name = next((found[x][2][1:-1] for x in ("name", "key", "id") if x in found), None)
            if name and "value" in found and len(found["value"][2]) > 2:
                start = tag.start() + found["value"].start(2) + 1
                yield name, found["value"][2][1:-1], [(start, start + len(found["value"][2]) - 2)]


def spaced_likeness(name: str, literal: str) -> float:
    """The likeness of a literal with white space: of the words of a passphrase, or of lines of encoded key material."""
    lines = [x.strip() for x in literal.split("\n") if x.strip()]
    if len(lines) > 1 and all(ENCODED.fullmatch(x) for x in lines):
        return literal_likeness("".join(x for x in lines if not x.startswith("-----")))
    if "passphrase" in name.lower() and len(literal.split()) > 2:
        return likeness(Counter("".join(literal.split())))
    return 0.0


def found_literals(text: str, least: float) -> Iterator[tuple[int, int]]:
    """The spans of literals that score at least `least`; each literal, and each chain from its end back, is counted once."""
    seen: dict[str, float] = {}
    counts: Counter = Counter()
    begin = stop = 0
    for name, value, spans in chain(lexed(text), named_literals(text)):
        weight = name_weight(name)
        if weight < least:
            continue
        if value is not None:
            if value not in seen:
                seen[value] = literal_likeness(value)
            alike = seen[value] or spaced_likeness(name, value)
        else:
            (start, end) = spans[0]
            if stop != end or start < begin:
                counts, begin, stop = Counter(text[start:end]), start, end
            counts.subtract(text[begin:start])
            counts, begin = +counts, start
            alike = 0.0 if end - start < 6 or MINE.match(text, start, end) else likeness(counts)
        if weight * alike >= least:
            yield from spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def scan(text: str, least: float = 0.5) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, spans the lexer adds), each sorted by start, then kind."""
    base = sorted(base_spans(text))
    added = set()
    if any(x in text for x in ":=(<"):
        added = {(start, 3, end) for start, end in found_literals(text, least)}
    return base, sorted(added)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan_rows(least: float):
    names = ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = []
                for x in part.column("text"):
                    base, added = scan(x.as_py() or "", least)
                    kinds = [k for _, k, _ in base]
                    rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(sorted(base + added)), len(added)))
                columns = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return run


def scan_secrets(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_literal; no shuffle.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Null and empty texts have
    none. Repeated rows and null ids are kept; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return rows.mapInArrow(_scan_rows(least), schema).withColumnRenamed("id", id_col)
