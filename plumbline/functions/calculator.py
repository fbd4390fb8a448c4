"""A calculator for expressions in text, as an Arrow-batched function with its own parser."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%(),])|([A-Za-z_]\w*))")
_NAMES = {"pi": math.pi, "e": math.e}
_CALLS = {"sqrt": math.sqrt, "abs": abs, "round": round, "int": int, "float": float}


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxError(text)
            self.tokens.append(next((i, g) for i, g in enumerate(m.groups()) if g is not None))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, *wanted):
        if self.peek() in wanted and self.tokens[self.at][0] == 1:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self):
        value = self.sum()
        if self.at != len(self.tokens):
            raise SyntaxError
        return value

    def sum(self):
        value = self.product()
        while op := self.take("+", "-"):
            other = self.product()
            value = value + other if op == "+" else value - other
        return value

    def product(self):
        value = self.sign()
        while op := self.take("*", "/", "//", "%"):
            other = self.sign()
            value = value * other if op == "*" else value / other if op == "/" else value // other if op == "//" else value % other
        return value

    def sign(self):
        if op := self.take("+", "-"):
            value = self.sign()
            return -value if op == "-" else +value
        return self.power()

    def power(self):
        base = self.atom()
        if self.take("**"):
            exponent = self.sign()
            if isinstance(base, int) and isinstance(exponent, int) and exponent > 0 and base not in (0, 1, -1) and exponent * max(base.bit_length(), 1) > 20_000:
                raise OverflowError
            return base**exponent
        return base

    def atom(self):
        if self.at >= len(self.tokens):
            raise SyntaxError
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 0:
            return int(text) if text.isdigit() else float(text)
        if text == "(":
            value = self.sum()
            if not self.take(")"):
                raise SyntaxError
            return value
        if kind == 2 and text in _CALLS and self.take("("):
            values = [self.sum()]
            while self.take(","):
                values.append(self.sum())
            if not self.take(")"):
                raise SyntaxError
            return _CALLS[text](*values)
        if kind == 2 and text in _NAMES:
            return _NAMES[text]
        if kind == 2:
            raise PermissionError
        raise SyntaxError


def evaluate(text: str | None) -> str:
    """Result of an expression of numbers, + - * / // % **, parentheses, sqrt abs round int float, pi and e; or ``Error: ...``.

    Floats are rounded to six places and whole ones shown without a point."""
    expression = (text or "").strip()
    if not expression:
        return "Error: empty expression"
    try:
        value = _Parser(expression).whole()
        if isinstance(value, complex):
            raise ValueError("complex result")
        if isinstance(value, float):
            value = round(value, 6)
            return str(int(value)) if abs(value) < 1e15 and value == int(value) else str(value)
        return str(value)
    except SyntaxError:
        return f"Error: invalid expression '{expression}'"
    except PermissionError:
        return "Error: expression contains disallowed operations"
    except ZeroDivisionError:
        return "Error: division by zero"
    except OverflowError:
        return "Error: result too large"
    except RecursionError:
        return "Error: expression too deep"
    except Exception as problem:
        return f"Error: {problem}"


def calculator():
    """The calculator as a vectorised UDF."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(evaluate)

    return run


#: Tools that can be executed; others are only recorded.
TOOLS = {"calculator": evaluate}
