"""The query language: text -> tokens -> tree -> checks -> one Column for each entity.

    mnemonic == 'CALL' and effect.read.register == 3
    constant contains "http" or callee.path == 'os.execute'
    GETTABLE                      a lone word is a mnemonic

`or` binds weaker than `and`. A comparison on a fact of another entity is false there, so entities are
routed at compile time and Catalyst drops what can't match. `!=` asks for a fact that is there and differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_TOKENS = 10_000

# Fixed vocabularies of the language.
CALLEE_STATUS = ("resolved-prototype", "lookup-label", "resolved-path", "unresolved")
CALLEE_REASONS = ("missing-definition", "control-flow-conflict", "dynamic-key", "overwritten", "call-result", "open-register-window", "unsupported-value", "unsupported-instruction", "mutable-capture", "ambiguous-capture", "path-limit", "analysis-limit", "unreachable")
CALL_REASONS = (*CALLEE_REASONS, "symbolic-path-only", "missing-prototype-store", "multiple-prototype-stores", "non-closure-store", "ambiguous-store-value", "lookup-label-only")
ORIGIN_KINDS = ("literal", "parameter", "upvalue", "prototype", "global", "field", "call-result", "concat", "table", "table-literal", "unary", "binary", "alternatives", "unknown")
CONSTANT_TYPES = ("nil", "boolean", "integer", "float", "short-string", "long-string")
PROFILES = ("lua5.1", "lua5.1-stock32", "lua5.1-lnum32", "lua5.2", "lua5.3", "lua5.4", "lua5.5")


class QueryError(ValueError):
    """The predicate can't be read, or asks for what there is not."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, string, op, and, or, open, close
    text: str


@dataclass(frozen=True)
class Compare:
    field: str
    op: str  # ==, !=, contains
    value: str
    quoted: bool


@dataclass(frozen=True)
class Both:
    left: object
    right: object


@dataclass(frozen=True)
class Either:
    left: object
    right: object


_TOKEN = re.compile(r"""\s*(?:(?P<op>==|!=)|(?P<and>&&)|(?P<or>\|\|)|(?P<open>\()|(?P<close>\))|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<word>[^\s()'"=!&|]+))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(text: str) -> list[Token]:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        kind, said = m.lastgroup, m[m.lastgroup]
        if kind == "word" and said in ("and", "or", "contains"):
            kind = "op" if said == "contains" else said
        if kind == "string":
            said = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), said[1:-1], flags=re.S)
        out.append(Token(kind, said))
        if len(out) > MOST_TOKENS:
            raise QueryError(f"more than {MOST_TOKENS} tokens")
        at = m.end()
    return out


def parse(text: str) -> object:
    """The tree of a predicate."""
    todo = tokens(text)
    at = 0

    def peek() -> str:
        return todo[at].kind if at < len(todo) else "end"

    def take(kind: str) -> Token:
        nonlocal at
        if peek() != kind:
            raise QueryError(f"{kind} expected, {peek()} found")
        at += 1
        return todo[at - 1]

    def chain(kind: str, make: Callable, lower: Callable) -> object:
        left = lower()
        while peek() == kind:
            take(kind)
            left = make(left, lower())
        return left

    def primary() -> object:
        if peek() == "open":
            take("open")
            inside = either()
            take("close")
            return inside
        if peek() == "string":
            return Compare("mnemonic", "==", take("string").text, True)
        name = take("word").text
        if peek() != "op":
            return Compare("mnemonic", "==", name, False)
        op = take("op").text
        value = take("string" if peek() == "string" else "word")
        return Compare(name, op, value.text, value.kind == "string")

    def both() -> object:
        return chain("and", Both, primary)

    def either() -> object:
        return chain("or", Either, both)

    tree = either()
    if at != len(todo):
        raise QueryError(f"left over: {todo[at].text!r}")
    return tree


# Fields: entity, operators, what the operand must be, and the column.


@dataclass(frozen=True)
class Field:
    entity: str
    ops: tuple[str, ...]
    operand: str  # any, typed, quoted, number, or closed
    compile: Callable[[str, str, bool], Column]
    closed: tuple[str, ...] = ()
    only_51: bool = False


def _fact(column: Column, op: str, value: str) -> Column:
    """A comparison that is false where the fact is absent."""
    hit = F.contains(column, F.lit(value)) if op == "contains" else column == value if op == "==" else column != value
    return column.isNotNull() & hit


def _mnemonic(op: str, value: str, quoted: bool) -> Column:
    want = re.sub("^OP_", "", value.upper())
    return _fact(F.upper(F.regexp_replace("mnemonic", "^OP_", "")), op, want)


def typed_literal(value: str, quoted: bool) -> Column:
    """Does a constant (ctype, bool_val, int_val, dbl_bits, str_display) equal this literal? Numbers by value and sign of zero, not as doubles."""
    if quoted:
        return F.col("ctype").isin("short-string", "long-string") & (F.col("str_display") == value)
    if value == "nil":
        return F.col("ctype") == "nil"
    if value in ("true", "false"):
        return (F.col("ctype") == "boolean") & (F.col("bool_val") == (value == "true"))
    try:
        number = float(value)
    except ValueError:
        raise QueryError(f"{value!r} is no literal; quote strings") from None
    import struct

    bits = struct.pack(">d", number).hex()
    same_float = (F.col("ctype") == "float") & (F.col("dbl_bits") == bits)
    if re.fullmatch(r"[+-]?\d+", value):
        n = int(value)
        if not -(2**63) <= n < 2**63:
            return same_float
        if value.startswith("-") and n == 0:
            return same_float  # -0 is no integer
        return ((F.col("ctype") == "integer") & (F.col("int_val") == n)) | same_float
    if number == int(number) if abs(number) < 2**53 else False:
        return ((F.col("ctype") == "integer") & (F.col("int_val") == int(number)) & F.lit(not (number == 0 and value.startswith("-")))) | same_float
    return same_float


def _constant(op: str, value: str, quoted: bool) -> Column:
    if op == "contains":
        return F.col("ctype").isin("short-string", "long-string") & F.contains(F.col("str_display"), F.lit(value))
    hit = F.coalesce(typed_literal(value, quoted), F.lit(False))
    return hit if op == "==" else ~hit


def _column(name: str) -> Callable[[str, str, bool], Column]:
    return lambda op, value, quoted: _fact(F.col(name), op, value)


def _effect(side: str, kind: str) -> Callable[[str, str, bool], Column]:
    def make(op: str, value: str, quoted: bool) -> Column:
        n = int(value)
        # only an exact register matches, never a range
        hit = F.coalesce(F.exists(side, lambda e: (e["kind"] == kind) & (e["first"] == n) & (e["last"] == n)), F.lit(False))
        return hit if op == "==" else ~hit

    return make


def _argument(part: str) -> Callable[[str, str, bool], Column]:
    """Of calls with a fixed window; an open one matches nothing, not even !=."""

    def make(op: str, value: str, quoted: bool) -> Column:
        hit = F.exists("arguments", lambda a: a[part].cast("string") == value)
        return (F.col("window_status") == "fixed") & F.coalesce(hit if op == "==" else ~hit, F.lit(False))

    return make


EQ, ALL = ("==", "!="), ("==", "!=", "contains")
FIELDS: dict[str, Field] = {
    "mnemonic": Field("instruction", EQ, "any", _mnemonic),
    "constant": Field("constant", ALL, "typed", _constant),
    "string": Field("constant", ALL, "typed", _constant),
    "constant.type": Field("constant", EQ, "closed", _column("ctype"), CONSTANT_TYPES),
    "callee.status": Field("instruction", EQ, "closed", _column("callee_status"), CALLEE_STATUS, True),
    "callee.path": Field("instruction", ALL, "quoted", _column("callee_path"), (), True),
    "callee.lookup.kind": Field("instruction", EQ, "closed", _column("lookup_kind"), ("gettable", "self"), True),
    "callee.lookup.key": Field("instruction", ALL, "quoted", _column("lookup_key"), (), True),
    "callee.reason": Field("instruction", EQ, "closed", _column("callee_reason"), CALLEE_REASONS, True),
    "call.reason": Field("instruction", EQ, "closed", _column("call_reason"), CALL_REASONS, True),
    "call.target": Field("instruction", EQ, "any", _column("call_target"), (), True),
    "origin.kind": Field("instruction", EQ, "closed", _argument("kind"), ORIGIN_KINDS, True),
    "origin.argument.index": Field("instruction", EQ, "number", _argument("argument_index"), (), True),
    "interpretation.profile": Field("chunk", EQ, "closed", _column("profile"), PROFILES),
    "prototype.digest": Field("prototype", EQ, "quoted", _column("digest"), (), True),
    "effect.read.register": Field("instruction", EQ, "number", _effect("reads", "register")),
    "effect.read.upvalue": Field("instruction", EQ, "number", _effect("reads", "upvalue")),
    "effect.write.register": Field("instruction", EQ, "number", _effect("writes", "register")),
    "effect.write.upvalue": Field("instruction", EQ, "number", _effect("writes", "upvalue")),
}
ALIASES = {"opcode": "mnemonic", "k": "constant", "k.type": "constant.type", "effect.read.reg": "effect.read.register", "effect.write.reg": "effect.write.register", "read.reg": "effect.read.register", "write.reg": "effect.write.register", "read.upvalue": "effect.read.upvalue", "write.upvalue": "effect.write.upvalue"}
#: Which analysis a field needs; the planner joins only those that a predicate names.
NEEDS = {"callee": "callees", "call": "relations", "origin": "origins", "prototype": "identities"}


def field_of(name: str) -> Field:
    found = FIELDS.get(ALIASES.get(name, name))
    if found is None:
        raise QueryError(f"unknown field {name!r}")
    return found


def leaves(tree: object) -> list[Compare]:
    return [tree] if isinstance(tree, Compare) else leaves(tree.left) + leaves(tree.right)


def validate(tree: object, profile: str = "lua5.1") -> None:
    """Raises QueryError for operators, operands and fields that do not go together, or that the profile lacks."""
    for c in leaves(tree):
        f = field_of(c.field)
        if c.op not in f.ops:
            raise QueryError(f"{c.field} does not take {c.op}")
        if f.operand == "closed" and c.value not in f.closed:
            raise QueryError(f"{c.field} knows no {c.value!r}")
        if f.operand == "quoted" and not c.quoted:
            raise QueryError(f"{c.field} takes a quoted string")
        if f.operand == "number" and (c.quoted or not re.fullmatch(r"\d+", c.value)):
            raise QueryError(f"{c.field} takes a number")
        if c.op == "contains" and not c.quoted:
            raise QueryError("contains takes a quoted string")
        if f.operand == "typed" and not c.quoted:
            typed_literal(c.value, False)
        if f.only_51 and not profile.startswith("lua5.1"):
            raise QueryError(f"{c.field} is known for 5.1 only")


def analyses(tree: object) -> set[str]:
    """The analyses that the predicate's fields need."""
    names = (ALIASES.get(c.field, c.field).split(".")[0] for c in leaves(tree))
    return {NEEDS[n] for n in names if n in NEEDS}


def compiled(tree: object, entity: str) -> Column | None:
    """The predicate for rows of one entity; None if no row of it can match."""
    if isinstance(tree, Compare):
        f = field_of(tree.field)
        return f.compile(tree.op, tree.value, tree.quoted) if f.entity == entity else None
    left, right = compiled(tree.left, entity), compiled(tree.right, entity)
    if isinstance(tree, Both):
        return None if left is None or right is None else left & right
    return right if left is None else left if right is None else left | right
