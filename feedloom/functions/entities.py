"""HTML character references: named, with or without the semicolon where HTML allows that, decimal and hexadecimal."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: The names that stand without a semicolon, also before further letters, have at most so many of them.
_LONGEST = max(len(n) for n in html5 if not n.endswith(";"))
#: What numbers 0x80 to 0x9F mean, as in code page 1252; those that it leaves open mean themselves.
_WINDOWS = {n: c for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "replace")) != "�"}


@lru_cache(1)
def _names() -> str:
    return json.dumps(html5)


def _of_number(code: Column) -> Column:
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    out = F.when(bad, F.lit("�"))
    for n, c in _WINDOWS.items():
        out = out.when(code == n, F.lit(c))
    return out.otherwise(char)


def _decoded(ref: Column) -> Column:
    """What one reference stands for; what is none stays as it is."""
    names = F.from_json(F.lit(_names()), "map<string,string>")
    body = F.substr(ref, F.lit(2))
    digits = F.regexp_extract(body, "^#[xX]?([0-9a-fA-F]+)", 1)
    # Nine digits or more are beyond any character.
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    hexadecimal = F.conv(F.left(significant, F.lit(9)), 16, 10).cast("bigint")
    code = F.when(body.rlike("^#[xX]"), hexadecimal).otherwise(F.left(significant, F.lit(9)).try_cast("bigint"))
    named = F.element_at(names, body)
    for k in range(_LONGEST, 1, -1):
        head = F.element_at(names, F.left(body, F.lit(k)))
        named = F.coalesce(named, F.when(F.char_length(body) > k, F.concat(head, F.substr(body, F.lit(k + 1)))))
    return F.when(body.startswith("#"), _of_number(code)).otherwise(F.coalesce(named, ref))


def unescaped(s: Column) -> Column:
    """s with its character references resolved, once: what comes out isn't looked at again."""

    def of(t: Column) -> Column:
        parts = F.split(t, REFERENCE, -1)
        found = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), 0), _decoded)
        return F.array_join(F.zip_with(parts, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(F.contains(s, F.lit("&")), let(s, of)).otherwise(s)
