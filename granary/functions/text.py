"""String functions as Catalyst expressions; none needs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pattern of identifier parts, the classes of primitive types, and the values that a type suggests.
PARTS = r"[A-Z]+(?=[A-Z][a-z0-9]|[0-9]|$)|[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+"
PRIMITIVES = {
    "B": "java.lang.byte", "C": "java.lang.character", "D": "java.lang.double", "F": "java.lang.float", "I": "java.lang.integer", "J": "java.lang.long",
    "Z": "java.lang.boolean", "S": "java.lang.short",
}
BOXED = {"char": "java.lang.character", "int": "java.lang.integer", "char[]": "java.lang.character[]", "int[]": "java.lang.integer[]"}
CANDIDATES = {"number": "0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 200, 404, 500", "boolean": "true, false"}

LITERAL = r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'"


def camel_parts(token: Column) -> Column:
    """Parts of an identifier at case and digit borders; a token that begins with a double quote stays whole.

    Signs have no parts.
    """
    return F.when(token.startswith('"'), F.array(token)).otherwise(F.regexp_extract_all(token, F.lit(PARTS), F.lit(0)))


def code_tokens(code: Column) -> Column:
    """Lower-case identifier parts, numbers and literals of source text; comments and signs have none."""
    plain = F.regexp_replace(code, rf"({LITERAL})|//[^\n]*|/\*(?s:.*?)\*/", "$1 ")
    raw = F.regexp_extract_all(plain, F.lit(rf"({LITERAL}|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][0-9A-Za-z_.]*)"), F.lit(1))
    return F.filter(F.transform(F.flatten(F.transform(raw, camel_parts)), lambda t: F.lower(t)), lambda t: t != "")


def space_tokens(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def strip_outside_literals(code: Column) -> Column:
    """Removes white space that is not inside a string or character literal."""
    return F.regexp_replace(code, rf"({LITERAL})|\s+", "$1")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def contains_without_space(text: Column, part: Column) -> Column:
    return F.contains(without_space(text), without_space(part))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """Replaces the first literal occurrence."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _fenced(lines: Column, only_first: bool) -> Column:
    """Lines between fences, a fence being a line that begins with three backticks; an unclosed fence reaches to the end."""
    start = F.struct(F.lit(0).alias("fences"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        is_fence = line.startswith("```")
        inside = state["fences"] == 1 if only_first else state["fences"] % 2 == 1
        return F.struct((state["fences"] + is_fence.cast("int")).alias("fences"), F.when(inside & ~is_fence, F.array_append(state["kept"], line)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(lines, start, step, lambda state: state["kept"])


def fenced_lines(answer: Column) -> Column:
    """The lines of all fenced blocks."""
    return _fenced(F.split(answer, "\n"), only_first=False)


def fenced_joined(answer: Column) -> Column:
    """All blocks as one text; '' without any."""
    return F.array_join(fenced_lines(answer), "\n")


def fenced_first_stripped(answer: Column) -> Column:
    """The first block with its lines trimmed before fences are looked for; seven characters are cut from lines that begin with Assert."""
    lines = _fenced(F.transform(F.split(answer, "\n"), lambda x: trimmed(x)), only_first=True)
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("Assert"), F.substr(x, F.lit(8))).otherwise(x)), "\n")


def fenced_first(answer: Column) -> Column:
    """The first block as it is; '' without one."""
    return F.array_join(_fenced(F.split(answer, "\n"), only_first=True), "\n")


def import_lines(source: Column) -> Column:
    """The import lines of a source text in order, its package as a wildcard import; lines must begin with the word."""
    taken = F.filter(F.split(source, "\n"), lambda x: x.startswith("package") | x.startswith("import"))
    wildcard = lambda x: F.concat(F.lit("import"), F.replace(F.substr(x, F.lit(8)), F.lit(";"), F.lit(".*;")))
    return F.array_join(F.transform(taken, lambda x: F.when(x.startswith("package"), wildcard(x)).otherwise(trimmed(x))), "\n")


def is_number(text: Column) -> Column:
    return text.rlike(r"^-?\d+(\.\d+)?$")


def collapse_blank_lines(text: Column) -> Column:
    """Keeps the first blank line of each run, and none at the start."""
    lines = F.split(text, "\n")
    blank = lambda x: ~x.rlike(r"\S")
    kept = F.filter(lines, lambda x, i: ~blank(x) | ((i > 0) & ~blank(F.element_at(lines, F.greatest(i, F.lit(1))))))
    return F.array_join(kept, "\n")


def newline_count(text: Column) -> Column:
    """Line breaks of a trimmed text, less one: the lines of a method without its head and its last bracket."""
    whole = trimmed(text)
    return F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) - 1


def prefix_of(value: Column, separator: str = "_") -> Column:
    return F.split_part(value, F.lit(separator), F.lit(1))


def split_at_last(value: Column, separator: str = ".") -> tuple[Column, Column]:
    """(before, after) the last separator."""
    after = F.substring_index(value, separator, -1)
    before = F.regexp_extract(value, rf"^(.*)\{separator}[^{separator}]*$", 1)
    return before, after


def signature_path(signature: Column) -> Column:
    """The source path of a class or method signature (class::method)."""
    return F.concat(F.replace(F.split_part(signature, F.lit("::"), F.lit(1)), F.lit("."), F.lit("/")), F.lit(".java"))


def descriptor_types(descriptor: Column) -> Column:
    """Parameter types of a method descriptor as lower-case class names, primitives by their class, with [] for arrays."""
    items = F.regexp_extract_all(F.regexp_extract(descriptor, r"\((.*)\)", 1), F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZ])"), F.lit(0))
    classes = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])

    def name(item: Column) -> Column:
        base = F.replace(item, F.lit("["), F.lit(""))
        plain = F.when(base.startswith("L"), F.replace(F.regexp_replace(base, "^L|;$", ""), F.lit("/"), F.lit("."))).otherwise(F.try_element_at(classes, base))
        return F.lower(F.concat(plain, F.repeat(F.lit("[]"), F.length(item) - F.length(base))))

    return F.transform(items, name)


def parameter_matches(declared: Column, found: Column) -> Column:
    """Whether a declared parameter type can be a type of descriptor_types(): by its lower-case ending, generics erased, or as a primitive's class."""
    full = F.regexp_replace(found, "^L(.*);$", "$1")
    erased = F.regexp_replace(declared, "<.*$", "")
    special = F.array(*(F.lit(f"{a} {b}") for a, b in BOXED.items()))
    return full.endswith(F.lower(declared)) | full.endswith(F.lower(erased)) | F.array_contains(special, F.concat(declared, F.lit(" "), full))


def expected_kind(expected: Column) -> Column:
    return F.when(expected.isin("assertTrue", "assertFalse"), "Boolean").when(expected.isin("assertNull", "assertNotNull"), "NullValues").otherwise("Equals")


def boolean_equivalent(expected: Column, text: Column) -> Column:
    """Containment where true may be written assertTrue, and false assertFalse."""
    return F.contains(text, expected) | ((expected == "true") & F.contains(text, F.lit("assertTrue"))) | ((expected == "false") & F.contains(text, F.lit("assertFalse")))


def candidate_values(kind: Column) -> Column:
    """The values to choose from for a type; null where there are none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in CANDIDATES.items() for x in pair]), kind)

def field_definition(modifier: Column, kind: Column, name: Column, value: Column) -> Column:
    """A field or parameter as declared; modifier and value may be empty or null."""
    lead = F.when(F.coalesce(modifier, F.lit("")) != "", F.concat(modifier, F.lit(" "))).otherwise("")
    tail = F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(" = "), value)).otherwise("")
    return F.concat(lead, kind, F.lit(" "), name, tail)


def field_signature(kind: Column, name: Column) -> Column:
    return F.concat_ws("#", kind, name)


def method_definition(modifier: Column, returned: Column, name: Column, parameters: Column) -> Column:
    """A method's head with its parameters' definitions (an array)."""
    return F.concat(modifier, F.lit(" "), returned, F.lit(" "), name, F.lit("("), F.array_join(parameters, ","), F.lit(");"))


def method_signature(returned: Column, owner: Column, name: Column, parameters: Column) -> Column:
    """A method's name in its class with its parameters' signatures (an array)."""
    return F.concat(returned, F.lit(" "), owner, F.lit("#"), name, F.lit("("), F.array_join(parameters, ","), F.lit(")"))


def class_signature(package: Column, name: Column) -> Column:
    return F.concat_ws(".", package, name)
