"""DuckDB expressions of the text functions, for the queries' SQL."""

from __future__ import annotations

from .. import constants as K
from ..functions.text import stem_word


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def words(values, stopwords: bool = False) -> str:
    return array(sorted({stem_word(w) for w in values if stopwords or w not in K.STOPWORDS}))


def tok(t: str) -> str:
    return f"regexp_extract_all(lower({t}), {q(K.TOKEN)})"


def norm(t: str) -> str:
    return f"array_to_string({tok(t)}, ' ')"


def stem(x: str) -> str:
    return (
        f"CASE WHEN ends_with({x}, 'ies') AND length({x}) > 4 THEN {x}[:-4] || 'y' WHEN ends_with({x}, 'ing') AND length({x}) > 5 THEN {x}[:-4] "
        f"WHEN ends_with({x}, 'ed') AND length({x}) > 4 THEN {x}[:-3] WHEN ends_with({x}, 's') AND NOT ends_with({x}, 'ss') AND length({x}) > 3 THEN {x}[:-2] ELSE {x} END"
    )


def term_list(t: str) -> str:
    return f"list_transform(list_filter({tok(t)}, lambda x: NOT list_contains({array(K.STOPWORDS)}, x) AND NOT regexp_matches(x, '^[0-9]+$')), lambda x: {stem('x')})"


def term_set(t: str) -> str:
    return f"list_distinct({term_list(t)})"


def numbers(t: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(lower({t}), {q(K.NUMBER)}), lambda x: rtrim(x, '%')))"


def dates(t: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({t}), {q(K.DATE)}))"


def sorted_numbers(xs: str) -> str:
    return f"list_transform(list_sort(list_transform({xs}, lambda x: {{'odd': try_cast(x AS DOUBLE) IS NULL, 'v': try_cast(x AS DOUBLE), 'x': x}})), lambda s: s.x)"


def count_shared(a: str, b: str) -> str:
    return f"len(list_distinct(list_intersect({a}, {b})))"


def overlap(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


def bigrams(xs: str) -> str:
    """Distinct runs of two and three terms."""
    two = f"list_transform(range(1, len({xs})), lambda i: {xs}[i] || ' ' || {xs}[i + 1])"
    three = f"list_transform(range(1, len({xs}) - 1), lambda i: {xs}[i] || ' ' || {xs}[i + 1] || ' ' || {xs}[i + 2])"
    return f"list_distinct(list_concat({two}, {three}))"


def any_of(t: str, patterns) -> str:
    return f"regexp_matches({t}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def flag_case(code: str, when: str, trigger: str) -> str:
    risk, message, _ = K.FLAGS[code]
    made = f"'flag-' || sha256(claim_id || ':{code}:' || {norm(trigger)})[:12]"
    return f"CASE WHEN {when} THEN {{'code': '{code}', 'id': {made}, 'message': {q(message)}, 'risk': '{risk}'}} END"


DOC_TEXT = "regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g')"


def sentences_sql(table: str, key: str) -> str:
    """(key, paragraph, sentence, text) of a table's texts."""
    line_end = "chr(13) || chr(10) || '|[' || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']'"
    lines = f"regexp_split_to_array(p, {line_end})"
    joined = f"array_to_string(list_filter(list_transform({lines}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^#{{1,6}}\\s')), ' ')"
    paragraphs = f"list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: {joined}), lambda b: b <> '')"
    parts = "list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    return (
        f"SELECT {key}, paragraph, unnest({parts}) AS text, generate_subscripts({parts}, 1) AS sentence "
        f"FROM (SELECT {key}, unnest({paragraphs}) AS body, generate_subscripts({paragraphs}, 1) AS paragraph FROM {table})"
    )
