"""Prompt templates as column expressions.

A template is read once, on the driver, into one Column: its text, values in ``{{ .name }}``, and conditions
``{{if c}} ... {{else if c}} ... {{else}} ... {{end}}``, nested as deep as need be.  A condition is a value, a literal, or
``not``, ``and``, ``or``, ``eq``, ``ne`` of such, in brackets where they nest; a ``-`` inside the braces strips white space
on its side, ``{{/* */}}`` is a comment.  Rows are rendered inside the JVM; values are never looked into.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, NumericType, StringType

from quiverlake.functions.text import truncate_bytes

#: What a value that is missing or null is shown as (fixed value).
NO_VALUE = "<no value>"

_LONG = LongType()

_ACTION = re.compile(r"\{\{(-(?=\s))?\s*(/\*.*?\*/|(?:\"(?:\\.|[^\"\\])*\"|[^\"{}])*?)\s*((?<=\s)-)?\}\}", re.S)
_WORD = re.compile(r"\s*(\(|\)|\"(?:\\.|[^\"\\])*\"|-?\d+(?:\.\d+)?|\.?[A-Za-z_]\w*)")


@dataclass(frozen=True)
class Value:
    """A value of a template: a column and its type, which says how it is shown and when it is true."""

    column: Column
    kind: DataType = StringType()

    def shown(self, missing: str) -> Column:
        c = self.column
        if isinstance(self.kind, ArrayType):
            c = F.concat(F.lit("["), F.array_join(c.cast("array<string>"), " ", missing), F.lit("]"))
        return F.coalesce(c.cast("string"), F.lit(missing))

    def true(self) -> Column:
        """Neither null nor false, zero or empty."""
        c = self.column
        if isinstance(self.kind, BooleanType):
            full = c
        elif isinstance(self.kind, NumericType):
            full = c != 0
        elif isinstance(self.kind, ArrayType):
            full = F.size(c) > 0
        else:
            full = c.cast("string") != ""
        return F.coalesce(full, F.lit(False))


def values_of(df: DataFrame, *names: str) -> dict[str, Value]:
    """Columns of a table as values."""
    return {n: Value(F.col(n), df.schema[n].dataType) for n in names or df.columns}


class Template:
    """A template that has been read; :meth:`render` makes the column of it."""

    def __init__(self, text: str, name: str = "template"):
        self.name = name
        self.parts = self._pieces(text)
        self.at = 0
        self.tree = self._block(())
        if self.at < len(self.parts):
            raise ValueError(f"{name}: {{{{{self.parts[self.at][1]}}}}} without an if")

    def names(self) -> set[str]:
        """Values that the template asks for."""
        found: set[str] = set()

        def visit(node) -> None:
            if isinstance(node, tuple) and node[0] == "value":
                found.add(node[1])
            elif isinstance(node, (tuple, list)):
                for x in node:
                    visit(x)

        visit(self.tree)
        return found

    # -- reading -----------------------------------------------------------------------

    @staticmethod
    def _pieces(text: str) -> list[tuple[str, str]]:
        out, at, strip = [], 0, False
        for m in _ACTION.finditer(text):
            before = text[at : m.start()]
            before = before.lstrip(" \t\r\n") if strip else before
            out.append(("text", before.rstrip(" \t\r\n") if m[1] else before))
            if not m[2].startswith("/*"):
                out.append(("action", m[2].strip()))
            at, strip = m.end(), bool(m[3])
        tail = text[at:]
        out.append(("text", tail.lstrip(" \t\r\n") if strip else tail))
        return [p for p in out if p[0] == "action" or p[1]]

    def _block(self, ends: tuple[str, ...]) -> list:
        nodes = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            word = text.split(None, 1)[0] if kind == "action" and text else ""
            if kind == "action" and word in ("else", "end"):
                if word not in ends:
                    return nodes
                break
            self.at += 1
            if kind == "text":
                nodes.append(("text", text))
            elif word == "if":
                nodes.append(self._if(text[2:]))
            else:
                nodes.append(self._expression(text))
        return nodes

    def _if(self, condition: str) -> tuple:
        cases, otherwise = [(self._expression(condition), self._block(("else", "end")))], []
        while True:
            if self.at >= len(self.parts):
                raise ValueError(f"{self.name}: if without an end")
            action = self.parts[self.at][1]
            self.at += 1
            if action == "end":
                return ("if", cases, otherwise)
            rest = action[4:].strip()
            if rest.startswith("if"):
                cases.append((self._expression(rest[2:]), self._block(("else", "end"))))
            elif rest:
                raise ValueError(f"{self.name}: can't read {{{{{action}}}}}")
            else:
                otherwise = self._block(("end",))
                if self.at < len(self.parts) and self.parts[self.at][1] != "end":
                    raise ValueError(f"{self.name}: something follows an else")

    def _expression(self, text: str) -> tuple:
        words, at = [], 0
        while text[at:].strip():
            m = _WORD.match(text, at)
            if not m:
                raise ValueError(f"{self.name}: can't read {{{{{text.strip()}}}}}")
            words.append(m[1])
            at = m.end()
        node, rest = self._call(words)
        if rest or node is None:
            raise ValueError(f"{self.name}: can't read {{{{{text.strip()}}}}}")
        return node

    def _call(self, words: list[str]) -> tuple:
        """A function with its arguments, or one operand, and the words behind it."""
        if words and words[0] in ("not", "and", "or", "eq", "ne"):
            args, rest = [], words[1:]
            while rest and rest[0] != ")":
                arg, rest = self._operand(rest)
                args.append(arg)
            least = 1 if words[0] == "not" else 2
            if len(args) < least or words[0] == "not" and len(args) > 1:
                raise ValueError(f"{self.name}: {words[0]} has {len(args)} operands")
            return (words[0], args), rest
        return self._operand(words) if words else (None, [])

    def _operand(self, words: list[str]) -> tuple:
        w, rest = words[0], words[1:]
        if w == "(":
            node, rest = self._call(rest)
            if node is None or not rest or rest[0] != ")":
                raise ValueError(f"{self.name}: a bracket isn't closed")
            return node, rest[1:]
        if w.startswith("."):
            return ("value", w[1:]), rest
        if w.startswith('"'):
            return ("literal", json.loads(w)), rest
        if w in ("true", "false"):
            return ("literal", w == "true"), rest
        if re.fullmatch(r"-?\d+(\.\d+)?", w):
            return ("literal", float(w) if "." in w else int(w)), rest
        raise ValueError(f"{self.name}: {w} is no function")

    # -- columns -----------------------------------------------------------------------

    def render(self, values: Mapping[str, Value], missing: str = NO_VALUE) -> Column:
        """The text for each row; a value that isn't given, or is null, is shown as ``missing``."""
        return self._text(self.tree, values, missing)

    def _text(self, nodes: list, values: Mapping[str, Value], missing: str) -> Column:
        out = [self._node(n, values, missing) for n in nodes]
        return F.concat(*out) if out else F.lit("")

    def _node(self, node: tuple, values: Mapping[str, Value], missing: str) -> Column:
        if node[0] == "text":
            return F.lit(node[1])
        if node[0] != "if":
            return self._value(node, values).shown(missing)
        (condition, then), *others = node[1]
        out = F.when(self._value(condition, values).true(), self._text(then, values, missing))
        for condition, then in others:
            out = out.when(self._value(condition, values).true(), self._text(then, values, missing))
        return out.otherwise(self._text(node[2], values, missing))

    def _value(self, node: tuple, values: Mapping[str, Value]) -> Value:
        kind, what = node
        if kind == "value":
            return values.get(what, Value(F.lit(None).cast("string")))
        if kind == "literal":
            number = isinstance(what, (int, float)) and not isinstance(what, bool)
            return Value(F.lit(what), BooleanType() if isinstance(what, bool) else _LONG if number else StringType())
        args = [self._value(a, values) for a in what]
        if kind == "not":
            return Value(~args[0].true(), BooleanType())
        if kind in ("eq", "ne"):  # equal to any of the others
            first = args[0].column.cast("string")
            same = F.coalesce(first.isin(*[a.column.cast("string") for a in args[1:]]), F.lit(False))
            return Value(same if kind == "eq" else ~same, BooleanType())
        # and, or: the operand that decides; of kinds that don't go together, whether it is true
        result = args[-1]
        for a in reversed(args[:-1]):
            take = a.true() if kind == "or" else ~a.true()
            numbers = isinstance(a.kind, NumericType) and isinstance(result.kind, NumericType)
            if numbers or a.kind == result.kind:
                result = Value(F.when(take, a.column).otherwise(result.column), a.kind)
            else:
                result = Value(F.when(take, a.true()).otherwise(result.true()), BooleanType())
        return result


@dataclass(frozen=True)
class Variable:
    name: str
    required: bool = False
    default: object = None
    most: int = 0  # bytes of a text, 0: all


@dataclass(frozen=True)
class Definition:
    """A template with its variables, the category it is listed under, and settings for a model."""

    id: str
    template: Template
    category: str = ""
    variables: tuple[Variable, ...] = ()
    settings: dict = field(default_factory=dict)


@dataclass
class Prompts:
    """Templates by id.  A later definition replaces an earlier one; a raw text goes before both, without rules."""

    definitions: dict[str, Definition] = field(default_factory=dict)
    raw: dict[str, Template] = field(default_factory=dict)

    def register(self, name: str, text: str) -> None:
        self.raw[name] = Template(text, name)

    def add(self, text: str, category: str, file: str) -> None:
        """A definition in YAML; without an id of its own it is named after its category and file."""
        try:
            spec = yaml.safe_load(text)
        except yaml.YAMLError:
            return
        if not isinstance(spec, dict):
            return
        about = spec.get("metadata") or {}
        name = about.get("id") or f"{category}.{file.rsplit('/', 1)[-1].removesuffix('.yaml')}"
        variables = tuple(Variable(v["name"], bool(v.get("required")), v.get("default"), int(v.get("max_length") or 0)) for v in spec.get("variables") or [])
        self.definitions[name] = Definition(name, Template(spec.get("template") or "", name), about.get("category") or "", variables, spec.get("llm_config") or {})

    def load(self, files: DataFrame) -> None:
        """Definitions in files ``(path, content)``, a folder for each category; definitions are few."""
        for r in files.where(F.col("path").endswith(".yaml")).orderBy("path").collect():
            parts = r.path.split("/")
            if len(parts) > 1:
                self.add(r.content, parts[-2], parts[-1])

    def names(self, category: str | None = None) -> list[str]:
        if category is not None:
            return sorted(n for n, d in self.definitions.items() if d.category == category)
        return sorted({*self.definitions, *self.raw})

    def render(self, name: str, values: Mapping[str, Value], missing: str = NO_VALUE) -> tuple[Column, Column]:
        """The text and the error of each row: where a required value is null, the text is null.

        Defaults stand in for values that aren't given at all; texts are cut to their greatest length in bytes.
        """
        none = F.lit(None).cast("string")
        if name in self.raw:
            return self.raw[name].render(values, missing), none
        if name not in self.definitions:
            raise KeyError(f"prompt template {name!r} not found")
        d = self.definitions[name]
        values = dict(values)
        problems = []
        for v in d.variables:
            if v.name not in values and v.default is not None:
                kind = BooleanType() if isinstance(v.default, bool) else _LONG if isinstance(v.default, (int, float)) else StringType()
                values[v.name] = Value(F.lit(v.default), kind)
            if v.required and v.name not in values:
                raise ValueError(f"{name}: required variable {v.name!r} not provided")
            if v.required:
                problems.append(F.when(values[v.name].column.isNull(), F.lit(f"required variable '{v.name}' not provided")))
            if v.most and v.name in values and isinstance(values[v.name].kind, StringType):
                values[v.name] = Value(truncate_bytes(values[v.name].column, v.most, ""))
        error = F.coalesce(*problems) if problems else none
        return F.when(error.isNull(), d.template.render(values, missing)), error
