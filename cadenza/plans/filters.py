"""The filter language of tracks, handed to Spark as a predicate.

    type == video && (width >= 1280 || codec != avc1.64001f)

Only words and their turn are looked at here: attributes, operators and literals
are checked and put as SQL. Precedence, parentheses and evaluation are Spark's. A missing
attribute is null, which no comparison holds for, and there is no negation, so
that is the same as false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = ("type", "format", "id", "codec", "frame_rate", "language", "role")
NUMERIC = ("width", "height", "sample_rate", "channels", "tile_size")
_SPACE = re.compile(r"[ \t\r\n]*")
_WORDS = {"(": "open", ")": "close", "&&": "AND", "||": "OR"}
_NAME, _OPERATOR, _TEXT, _NUMBER = (re.compile(p) for p in ("[a-z_]+", "==|!=|<=|>=|<|>", "[A-Za-z0-9._/-]+", "[0-9]+"))


class FilterError(ValueError):
    """A malformed filter; `offset` is where in its text."""

    def __init__(self, offset: int, message: str):
        super().__init__(f"at offset {offset}: {message}")
        self.offset = offset


def to_sql(text: str, columns: dict[str, str] | None = None) -> str:
    """The predicate as SQL. columns: attribute -> SQL of its value, where that
    is not the column of the same name. Words come in turn: comparisons, behind
    any parentheses that open, and what joins them, behind those that close."""
    columns, out, open_, operand = columns or {}, [], 0, True
    at = _SPACE.match(text, 0).end()
    while at < len(text):
        word = next((w for w in _WORDS if text.startswith(w, at)), None)
        if operand and word == "(":
            out, open_, at = [*out, "("], open_ + 1, at + 1
        elif operand:
            sql, at = _comparison(text, at, columns)
            out, operand = [*out, sql], False
        elif word == ")" and open_:
            out, open_, at = [*out, ")"], open_ - 1, at + 1
        elif word in ("&&", "||"):
            out, operand, at = [*out, _WORDS[word]], True, at + 2
        else:
            raise FilterError(at, "&&, || or the end is expected" if not open_ else "&&, || or ) is expected")
        at = _SPACE.match(text, at).end()
    if operand or open_:
        raise FilterError(at, "a comparison is expected" if operand else ") is expected")
    return f"({' '.join(out)})"


def _comparison(text: str, at: int, columns: dict[str, str]) -> tuple[str, int]:
    """The comparison there as SQL, and where it ends."""
    name = _NAME.match(text, at)
    if not name or name[0] not in (*TEXT, *NUMERIC, *columns):
        raise FilterError(at, "an attribute is expected")
    column, numeric = columns.get(name[0], f"`{name[0]}`"), name[0] in NUMERIC
    at = _SPACE.match(text, name.end()).end()
    op = _OPERATOR.match(text, at)
    if not op:
        raise FilterError(at, "a comparison operator is expected")
    if not numeric and op[0] not in ("==", "!="):
        raise FilterError(at, f"{name[0]} has no order")
    at = _SPACE.match(text, op.end()).end()
    value = (_NUMBER if numeric else _TEXT).match(text, at)
    if not value or (numeric and int(value[0]) >= 1 << 64):
        raise FilterError(at, "a whole number below 2**64 is expected" if numeric else "a value is expected")
    if numeric:
        return f"(CAST({column} AS DECIMAL(20,0)) {op[0]} CAST('{value[0]}' AS DECIMAL(20,0)))", value.end()
    return f"({column} {op[0]} '{value[0]}')", value.end()


def to_column(text: str, columns: dict[str, str] | None = None) -> Column:
    """The filter as a Column; FilterError if it is malformed."""
    return F.expr(to_sql(text, columns))


def filtered(tracks: DataFrame, text: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The tracks that the filter holds for; FilterError if it is malformed."""
    return tracks.filter(to_column(text, columns))


def filtered_or_error(tracks: DataFrame, text: str, columns: dict[str, str] | None = None) -> DataFrame:
    """As `filtered`; no match at all is an error."""
    out = filtered(tracks, text, columns)
    if out.isEmpty():
        raise LookupError(f"no track matches {text!r}")
    return out


@dataclass(frozen=True)
class Options:
    """What a request asks for: lengths in ms."""

    asset: str
    min_length: int = 0
    text_length: int = 0
    compact: bool = False
    multi_period: bool = False
    wvtt: bool = False


_ALIASES = {"a": "asset", "sml": "min_length", "segment_min_length": "min_length", "stl": "text_length", "segment_text_length": "text_length", "c": "compact", "mp": "multi_period"}


#: A key or value of the option notation: in quotes, where ! makes the next
#: character itself; a sign (!t, !f, !n); or a bare word.
_OPTION = re.compile(r"'((?:[^'!]|![!'])*)'|(![tfn])|([^\s'!:(),*@$]+)")


def parse_options(text: str) -> Options:
    """`(key:value,...)`, with or without the parentheses. Values are bare words
    and numbers, quoted texts, `!t` and `!f`; there are no lists or inner
    objects among the options, and `!n` is no value for any. Unknown or repeated
    keys, and values of another kind, are errors that name their offset."""
    whole, end = text.startswith("("), len(text)
    if whole:
        if not text.endswith(")"):
            raise ValueError(f"at offset {end}: ) is expected")
        end -= 1
    kinds, found, at = {f.name: f.type for f in fields(Options)}, {}, int(whole)
    while at < end or found:
        key = _OPTION.match(text, at, end)
        name = None if not key or key[2] else key[3] if key[3] is not None else _unquoted(key[1])
        name = _ALIASES.get(name, name)
        if name not in kinds or name in found:
            raise ValueError(f"at offset {at}: unknown, repeated or no option")
        at = key.end()
        if text[at : min(at + 1, end)] != ":":
            raise ValueError(f"at offset {at}: : is expected")
        at += 1
        value = _OPTION.match(text, at, end)
        if not value:
            raise ValueError(f"at offset {at}: a value is expected")
        found[name] = _valued(name, kinds[name], value, at)
        at = value.end()
        if at == end:
            break
        if text[at] != ",":
            raise ValueError(f"at offset {at}: , or the end is expected")
        at += 1
    if not found.get("asset"):
        raise ValueError("an asset is needed")
    return Options(**found)


def _unquoted(text: str) -> str:
    return re.sub("!(.)", r"\1", text)


def _valued(name: str, kind: str, value: re.Match, at: int) -> int | bool | str:
    quoted, sign, bare = value.groups()
    if kind == "int" and bare and re.fullmatch("[0-9]+", bare) and int(bare) < 1 << 32:
        return int(bare)
    if kind == "bool" and (sign in ("!t", "!f") or bare in ("true", "false")):
        return sign == "!t" or bare == "true"
    # A bare word that begins as numbers do is a number, or nothing.
    if kind == "str" and (quoted is not None or (bare and not re.match("[-0-9]", bare))):
        return _unquoted(quoted) if quoted is not None else bare
    raise ValueError(f"at offset {at}: {name} needs {'a number below 2**32' if kind == 'int' else '!t or !f' if kind == 'bool' else 'a text'}")
