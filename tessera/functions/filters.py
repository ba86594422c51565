"""Metadata filters: a small SQL-like language, turned into Columns.

    expr  = term (OR term)*        term = factor (AND factor)*
    factor = NOT factor | "(" expr ")" | test
    test  = field (= | != | < | <= | > | >=) literal
          | field [NOT] IN "(" literal ("," literal)* ")"
          | field [NOT] BETWEEN literal AND literal
    literal = 'text' ('' is a quote) | integer | decimal | true | false | null

NOT binds tighter than AND, AND tighter than OR; BETWEEN holds its ends. A test of a
missing field is unknown, as in SQL, so its row is left out, under != and NOT as well;
= null and != null ask whether a field is missing. A field is compared with literals
of its own type only: a test across types is unknown.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import FilterSyntaxError

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>[-+]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][-+]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op><=|>=|!=|<>|=|<|>|\(|\)|,))")
_KEYWORDS = {"and", "or", "not", "in", "between", "true", "false", "null"}
_NULL = object()

#: (field, the literal's Python type) -> the field's value in that type, or null.
Resolver = Callable[[str, type], Column]


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if not m:
            raise FilterSyntaxError(f"unexpected {source[at:at + 10]!r} at {at}")
        kind, text = m.lastgroup, m.group(m.lastgroup)
        if kind == "word" and text.lower() in _KEYWORDS:
            kind, text = "keyword", text.lower()
        out.append((kind, text))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str, resolve: Resolver):
        self.tokens, self.at, self.resolve = _tokens(source), 0, resolve

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, text: str | None = None) -> str | None:
        """The next token's text if it is of the kind, else None."""
        k, t = self.peek()
        if k == kind and text in (None, t):
            self.at += 1
            return t
        return None

    def need(self, kind: str, text: str | None = None) -> str:
        got = self.take(kind, text)
        if got is None:
            raise FilterSyntaxError(f"{text or kind} wanted, got {self.peek()[1] or 'the end'!r}")
        return got

    def whole(self) -> Column:
        out = self.any_of()
        self.need("end") if self.peek()[0] != "end" else None
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.take("keyword", "or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.factor()
        while self.take("keyword", "and"):
            out = out & self.factor()
        return out

    def factor(self) -> Column:
        if self.take("keyword", "not"):
            return ~self.factor()
        if self.take("op", "("):
            out = self.any_of()
            self.need("op", ")")
            return out
        return self.test(self.need("word"))

    def literal(self):
        kind, text = self.peek()
        self.at += 1
        if kind == "text":
            return text[1:-1].replace("''", "'")
        if kind == "number":
            return float(text) if re.search(r"[.eE]", text) else int(text)
        if kind == "keyword" and text in ("true", "false", "null"):
            return {"true": True, "false": False, "null": _NULL}[text]
        raise FilterSyntaxError(f"a literal is wanted, got {text or 'the end'!r}")

    def test(self, field: str) -> Column:
        negated = self.take("keyword", "not")
        if self.take("keyword", "in"):
            self.need("op", "(")
            values = [self.literal()]
            while self.take("op", ","):
                values.append(self.literal())
            self.need("op", ")")
            out = self.within(field, values)
        elif self.take("keyword", "between"):
            low = self.literal()
            self.need("keyword", "and")
            high = self.literal()
            if type(low) is type(high) and low is not _NULL:
                out = self.resolve(field, type(low)).between(F.lit(low), F.lit(high))
            else:
                out = self.compare(field, ">=", low) & self.compare(field, "<=", high)
        elif negated:
            raise FilterSyntaxError("NOT after a field goes with IN or BETWEEN")
        else:
            op = self.need("op")
            if op in ("(", ")", ","):
                raise FilterSyntaxError(f"a comparison is wanted, got {op!r}")
            out = self.compare(field, "!=" if op == "<>" else op, self.literal())
        return ~out if negated else out

    def within(self, field: str, values: list) -> Column:
        tests = [self.compare(field, "=", v) for v in values if v is not _NULL]
        unknown = F.lit(None).cast("boolean")
        out = tests[0] if tests else unknown
        for t in tests[1:]:
            # A value of one type is unknown beside the others, not the whole list.
            out = F.coalesce(out, t) | F.coalesce(t, out)
        return out | unknown if len(tests) < len(values) else out

    def compare(self, field: str, op: str, value) -> Column:
        if value is _NULL:
            missing = self.resolve(field, object).isNull()
            if op not in ("=", "!="):
                return F.lit(None).cast("boolean")
            return missing if op == "=" else ~missing
        column = self.resolve(field, type(value))
        right = F.lit(value)
        return {
            "=": column == right, "!=": column != right, "<": column < right,
            "<=": column <= right, ">": column > right, ">=": column >= right,
        }[op]


def columns_of(df: DataFrame) -> Resolver:
    """Fields are columns of df, or dotted paths into its structs."""

    def resolve(field: str, kind: type) -> Column:
        try:
            held = df.select(field).schema[0].dataType
        except Exception as e:
            raise FilterSyntaxError(f"no field {field!r}") from e
        if kind is object:
            return F.col(field)
        fits = {str: (T.StringType, T.VarcharType, T.CharType), bool: (T.BooleanType,), int: (T.NumericType,), float: (T.NumericType,)}[kind]
        if not isinstance(held, fits):
            return F.lit(None).cast({str: "string", bool: "boolean", int: "long", float: "double"}[kind])
        return F.col(field)

    return resolve


def json_of(column: str) -> Resolver:
    """Fields are keys of a column of JSON objects, typed as the JSON is."""

    def resolve(field: str, kind: type) -> Column:
        path = "$." + field
        found = F.try_variant_get(F.try_parse_json(F.col(column)), path, "variant")
        if kind is object:
            return F.try_variant_get(found, "$", "string")
        shape = F.schema_of_variant(found)
        if kind is str or kind is bool:
            return F.when(shape == {str: "STRING", bool: "BOOLEAN"}[kind], F.try_variant_get(found, "$", {str: "string", bool: "boolean"}[kind]))
        number = F.when(F.rlike(shape, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), F.try_variant_get(found, "$", "double"))
        if kind is float:
            return number
        # Whole numbers are compared exactly, beyond 2^53 as well; others keep their order.
        whole = F.when(shape == "BIGINT", F.try_variant_get(found, "$", "long")).cast("decimal(38,18)")
        return F.coalesce(whole, F.when(number.isNotNull(), F.greatest(F.least(number, F.lit(1e19)), F.lit(-1e19))).cast("decimal(38,18)"))

    return resolve


def parse(source: str, resolve: Resolver) -> Column:
    return _Parser(source, resolve).whole()


def apply(df: DataFrame, source: str | None, resolve: Resolver | None = None) -> DataFrame:
    """The rows of df for which the filter is true; all of them if it is null."""
    return df if source is None else df.where(parse(source, resolve or columns_of(df)))
