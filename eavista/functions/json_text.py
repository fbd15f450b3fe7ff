"""Length of, and membership in, JSON documents kept as text, of any size and depth.

Lists of scalars, which nearly all documents are, are a regular language: one expression tells
whether a text is one, and its tokens are counted or taken out. Other texts are read once by a
strict parser that skips over the value, so no document is built. What they hold is then told
by their tokens and a running depth, in one pass whatever the number of levels.

The expressions are SQL texts: one call builds what some hundred calls of functions would.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The quantifiers are possessive, so that matching needs no stack however long a text is.
_SPACE = r"[ \t\r\n]*+"
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_CHARACTER = r'(?:[^"\\\x00-\x1F]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))'
_STRICT_STRING = r'"[^"\\\x00-\x1F]*+(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})[^"\\\x00-\x1F]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_SCALAR = rf"(?:{_STRICT_STRING}|{_NUMBER}|true|false|null)"
_FLAT_LIST = rf"^{_SPACE}\[{_SPACE}(?:{_SCALAR}{_SPACE}(?:,{_SPACE}{_SCALAR}{_SPACE})*+)?+\]{_SPACE}\z"

# The parser bounds the length of keys alone by no option; longer ones become empty before it.
_PARSED_KEY = 50_000
_LONG_KEY = rf'("{_CHARACTER}{{0,9999}}+"|{_STRING}(?!{_SPACE}:))|("){_CHARACTER}{{10000,}}+(")(?={_SPACE}:)'
_UNBOUNDED = str(2**31 - 1)
_STRICT = (
    f"map('maxNestingDepth', '{_UNBOUNDED}', 'maxNumLen', '{_UNBOUNDED}', 'maxStringLen', '{_UNBOUNDED}', "
    "'allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
)

# Tokens whose moves are added up together.
_BLOCK = 64


def json_length(column: str) -> Column:
    """``JSON_LENGTH`` of a text column: array size, number of different object keys, 1 for a scalar; NULL for malformed text."""
    text = _named(column)
    first = f"regexp_extract({text}, {_raw(rf'^{_SPACE}(.)')}, 1)"
    return F.expr(
        f"CASE WHEN {_flat(text)} THEN regexp_count({text}, {_raw(_SCALAR)}) WHEN {_one_value(text)} THEN "
        f"CASE {first} WHEN '[' THEN {_elements(text)} WHEN '{{' THEN {_different_keys(text)} ELSE 1 END END"
    )


def json_string_members(column: str) -> Column:
    """The strings ``s`` for which ``JSON_CONTAINS(text, '"s"')`` holds for a text column, as an array.

    They are the document itself when it is a string, and the string elements of
    an array at any depth of nested arrays. Numbers and strings inside objects do
    not count.
    """
    text = _named(column)
    every = f"regexp_extract_all({text}, {_raw(_STRING)}, 0)"
    outside = _kept(text, rf"{_STRING}|[{{}}]", "{", "}", 0)
    shown = f"CASE WHEN contains({text}, '{{') THEN {outside} ELSE {every} END"
    return F.expr(
        f"CASE WHEN {_flat(text)} THEN {_bind(every, _decoded)} WHEN {_one_value(text)} THEN {_bind(shown, _decoded)} END"
    )


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def _raw(pattern: str) -> str:
    """A literal that takes backslashes as they are; no pattern here has an apostrophe."""
    return f"r'{pattern}'"


def _flat(text: str) -> str:
    return f"rlike({text}, {_raw(_FLAT_LIST)})"


def _one_value(text: str) -> str:
    """Whether the text is one JSON value.

    It stands as a member of an object and as the element of an array, before a last member
    that no text can hold. Text that goes on behind its value, or closes what is around
    it, is malformed in one of the two.
    """
    short = f"regexp_replace({text}, {_raw(_LONG_KEY)}, '$1$2$3')"
    value = f"CASE WHEN octet_length({text}) >= {_PARSED_KEY} THEN {short} ELSE {text} END"
    mark = f"sha2({text}, 256)"

    def ends(value: str) -> str:
        around = f"""concat('{{"m":', {value}, ',"l":[', {value}, '],"end":"', {mark}, '"}}')"""
        return f"coalesce(from_json({around}, 'end string', {_STRICT}).end = {mark}, false)"

    return _bind(value, ends)


def _elements(text: str) -> str:
    """The number of elements of a valid array that is not empty: its own commas, and one."""
    tokens = f"regexp_extract_all({text}, {_raw(rf'{_STRING}|[{chr(92)}[{chr(92)}]{{}},]')}, 0)"
    comma = "CASE WHEN token = ',' AND state.depth = 1 THEN 1 ELSE 0 END"
    step = f"struct(state.depth + {_move('token', '[{', ']}')} AS depth, state.commas + {comma} AS commas)"
    return f"aggregate({tokens}, struct(0 AS depth, 0 AS commas), (state, token) -> {step}, state -> state.commas + 1)"


def _different_keys(text: str) -> str:
    token = rf"{_STRING}{_SPACE}:|{_STRING}|[\[\]{{}}]"
    keys = _kept(text, token, "[{", "]}", 1, ending=":")
    return f"size(array_distinct({_bind(keys, _decoded)}))"


def _kept(text: str, token: str, opening: str, closing: str, level: int, ending: str = "") -> str:
    """The string literals among the tokens (those with that ending) that stand so many brackets deep.

    A token's depth is the sum of the moves before it: of blocks of blocks, of blocks, and
    within its own block.
    """

    def wanted(tokens: str, moves: str, sums: str, above: str) -> str:
        group = f"int(floor(block / {_BLOCK}))"
        start = f"{_sum(above, '1', group)} + {_sum(sums, f'{group} * {_BLOCK} + 1', f'block % {_BLOCK}')}"
        first = f"block * {_BLOCK} + 1"

        def there(start: str) -> str:
            depth = f"{start} + {_sum(moves, first, 'place')}"
            literal = f"startswith(token, '\"') AND endswith(token, '{ending}')"
            return f"filter(slice({tokens}, {first}, {_BLOCK}), (token, place) -> {literal} AND {depth} = {level})"

        kept = f"flatten(transform({_blocks(tokens)}, block -> {_bind(start, there)}))"
        return f"transform({kept}, token -> regexp_extract(token, {_raw(_STRING)}, 0))" if ending else kept

    def moved(tokens: str) -> str:
        moves = f"transform({tokens}, token -> {_move('token', opening, closing)})"
        return _bind(moves, lambda moves: _bind(_block_sums(moves), lambda sums: _bind(
            _block_sums(sums), lambda above: wanted(tokens, moves, sums, above)
        )))

    return _bind(f"regexp_extract_all({text}, {_raw(token)}, 0)", moved)


def _blocks(values: str) -> str:
    """The numbers of the blocks of an array that is not empty."""
    return f"sequence(0, int(floor((size({values}) - 1) / {_BLOCK})))"


def _sum(values: str, start: str, length: str) -> str:
    return f"aggregate(slice({values}, {start}, {length}), 0, (total, value) -> total + value)"


def _block_sums(values: str) -> str:
    return f"transform({_blocks(values)}, b -> {_sum(values, f'b * {_BLOCK} + 1', str(_BLOCK))})"


def _move(token: str, opening: str, closing: str) -> str:
    def one_of(kinds: str) -> str:
        return f"{token} IN ({', '.join(repr(c) for c in kinds)})"

    return f"CASE WHEN {one_of(opening)} THEN 1 WHEN {one_of(closing)} THEN -1 ELSE 0 END"


def _decoded(literals: str) -> str:
    """The values of JSON string literals."""
    return f"from_json(concat('[', array_join({literals}, ','), ']'), 'array<string>', {_STRICT})"


def _bind(value: str, body: Callable[[str], str]) -> str:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    inner = body("bound_0")
    depth = 0
    while f"bound_{depth} ->" in inner or f"bound_{depth} ->" in value:
        depth += 1
    name = f"bound_{depth}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"
