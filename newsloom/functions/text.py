"""Text functions: slugs, title case, HTML to plain text."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space plus the four separators that Python also strips.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"

ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"

# One pass over everything that starts with '<' and is not text: comments,
# elements whose text does not belong to the page, declarations, tags. A tag
# ends at the first '>' outside a quoted attribute value; possessive loops keep
# the match linear on long pages.
MARKUP = (
    r"(?s)<(?:"
    r"!--.*?-->"
    r"|(?i:script)\b.*?(?:</(?i:script)\s*>|\z)"
    r"|(?i:style)\b.*?(?:</(?i:style)\s*>|\z)"
    r"|(?i:template)\b.*?</(?i:template)\s*>"
    r"|/?[a-zA-Z][^>=]*+(?:=\s*+(?:\x22[^\x22]*+\x22|\x27[^\x27]*+\x27|)[^>=]*+)*+>"
    r"|/?[a-zA-Z][^>]*+>"
    r"|[!?][^>]*+>"
    r")"
)


def apply_lambda(value: Column, sql_lambda: str) -> Column:
    """A SQL lambda on ``value``, which is computed once however often the
    lambda names it. One SQL text is also much faster to build than its parts."""
    bound = F.call_function("transform", F.array(value), F.expr(sql_lambda))
    return F.get(bound, F.lit(0))


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def slugify(text: Column) -> Column:
    """Lower case, runs of non-word characters to '-', no '-' at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), r"(?U)\W+", "-"), F.lit("-"))


def match_name(text: Column) -> Column:
    """Name for matching: trimmed, lower case, '-' and '_' as spaces."""
    return F.translate(F.lower(F.btrim(text)), "-_", "  ")


def title_case(stem: Column) -> Column:
    """'-' to space, then a capital after every non-letter."""
    spaced = F.split(F.replace(stem, F.lit("-"), F.lit(" ")), "")
    return apply_lambda(
        spaced,
        r"""chars -> array_join(transform(chars, (char, at) ->
              if(at > 0 and get(chars, at - 1) rlike r'\p{L}', lower(char), upper(char))), '')""",
    )


def content_first(content: Column, dtype: T.DataType) -> Column:
    """The text of a feed entry's content: a list of values, one value, or text."""
    if isinstance(dtype, T.ArrayType):
        first = F.get(content, F.lit(0))
        return first["value"] if isinstance(dtype.elementType, T.StructType) else first
    if isinstance(dtype, T.StructType):
        return content["value"]
    return content.cast("string")


def content_text(content: Column) -> Column:
    """The text of a landed article's content, read as JSON text: the first of a
    list of values, one value, or text. What is no such JSON stays as it is."""
    listed = F.from_json(content, "array<struct<value:string>>")
    plain = F.from_json(content, "array<string>")
    single = F.from_json(content, "struct<value:string>")
    first = F.coalesce(F.get(listed, F.lit(0))["value"], F.get(plain, F.lit(0)))
    return (
        F.when(content.rlike(r"^\s*\["), F.coalesce(first, content))
        .when(content.rlike(r"^\s*\{"), F.coalesce(single["value"], content))
        .otherwise(content)
    )


def _json_literal(value: object) -> str:
    """A SQL string literal holding ``value`` as JSON."""
    return "r'" + json.dumps(value).replace("'", r"\u0027") + "'"


@cache
def _entities() -> str:
    """SQL: the HTML5 entities as a map, the everyday ones first (lookups scan)."""
    everyday = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "amp"]
    ordered = everyday + [name for name in html5 if name not in everyday]
    table = {name: html5[name] for name in ordered}
    return f"from_json({_json_literal(table)}, 'map<string,string>')"


@cache
def _bare_entity() -> str:
    """Pattern of the entities that HTML also accepts without ';', longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "^(" + "|".join(bare) + ")"


@cache
def _windows_characters() -> str:
    """SQL: what numeric references 128..159 mean in HTML (Windows-1252)."""
    found = []
    for code in range(0x80, 0xA0):
        try:
            found.append(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            found.append(chr(code))
    return f"from_json({_json_literal(found)}, 'array<string>')"


def _numeric_reference() -> str:
    """SQL: the text of ``token``, '#65;' or '#x41;'."""
    character = f"""case
        when code = 0 or code > 1114111 or code between 55296 and 57343 then '�'
        when code between 128 and 159 then get({_windows_characters()}, cast(code - 128 as int))
        when code between 1 and 8 or code = 11 or code between 14 and 31 or code = 127
          or code between 64976 and 65007 or code & 65535 >= 65534 then ''
        else decode(unhex(lpad(hex(code), 8, '0')), 'UTF-32') end"""
    digits = r"regexp_replace(token, r'^#[xX]?0*|;$', '')"
    base = r"if(token rlike r'^#[xX]', 16, 10)"
    code = f"cast(if(digits = '', '0', if(length(digits) > 7, '9999999', conv(digits, {base}, 10))) as bigint)"
    return _let("digits", digits, _let("code", code, character))


def _unescape(text: str) -> str:
    """SQL: every reference in ``text`` decoded once, with ``entities`` in scope."""
    named = f"""coalesce(
        try_element_at(entities, token),
        {_let("bare", f"regexp_extract(token, r'{_bare_entity()}', 1)",
              "concat(try_element_at(entities, bare), substr(token, length(bare) + 1))")},
        concat('&', token))"""
    reference = _let("token", "substr(found, 2)", f"if(token like '#%', {_numeric_reference()}, {named})")
    pieces = f"""zip_with(
        split(raw, r'{ENTITY}'),
        transform(regexp_extract_all(raw, r'{ENTITY}', 0), found -> {reference}),
        (piece, char) -> concat(piece, coalesce(char, '')))"""
    return _let("raw", text, f"if(raw rlike r'&[#a-zA-Z]', array_join({pieces}, ''), raw)")


@cache
def _unescape_lambda() -> str:
    return "text -> " + _let("entities", _entities(), _unescape("text"))


@cache
def _plain_lambda() -> str:
    visible = f"regexp_replace({_unescape('text')}, r'{MARKUP}', '')"
    stripped = _let("entities", _entities(), _unescape(visible))
    marked = "contains(text, '&') or contains(text, '<')"
    return f"text -> btrim(regexp_replace(if({marked}, {stripped}, text), r'{WHITE_SPACE}', ' '))"


def unescape_entities(text: Column) -> Column:
    """Decode every HTML character reference once, left to right."""
    return apply_lambda(text, _unescape_lambda())


def clean_html(text: Column) -> Column:
    """Plain text of an HTML fragment, '' for NULL.

    References are decoded, tags removed without a separator, what the parser
    would decode is decoded again, and white space is collapsed.
    """
    return F.coalesce(apply_lambda(text, _plain_lambda()), F.lit(""))
