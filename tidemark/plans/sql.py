"""SQL text with the meaning of the library's expressions, for DuckDB; used as the other side of comparisons."""

from __future__ import annotations

from ..functions.text import SOURCE_ENDINGS as ENDINGS

WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def unescape(x: str) -> str:
    """The references that the tables have."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sanitize(x: str) -> str:
    clean = f"regexp_replace(replace(replace({x}, '**', ''), chr(13) || chr(10), chr(10)), '[\\x09\\x0b-\\x0d\\x1c-\\x20\\x{{85}}\\p{{Z}}]+(\\n|$)', '\\1', 'g')"
    return strip(clean)


def garbled(x: str) -> str:
    return rf"length(regexp_replace({x}, '[^\x{{FFFD}}Ãâ¤ï¿½]', '', 'g')) >= 3"


def escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, chr(10), '<br/>')"


def host(url: str) -> str:
    return rf"lower(regexp_extract({strip(url)}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 1))"


def norm_url(url: str) -> str:
    return f"regexp_replace(lower({strip(url)}), '/+$', '')"


def norm_text(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', '', 'g')"


def title_key(x: str) -> str:
    return f"regexp_replace(lower({x}), '{WS}', '', 'g')"


def title_element(html: str) -> str:
    return f"regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1)"


def normalize_title(source: str, key: str, x: str) -> str:
    """CTEs ``nt0 .. nt3``: the last has ``key`` and ``title``, the normal form of ``x`` in ``source``."""
    out = f"nt0 AS (SELECT {key}, {collapse(x)} AS t FROM {source})"
    for i in range(3):
        tail = f"replace({strip('parts[-1]')}, ' ', '')"
        out += (
            f", np{i} AS (SELECT {key}, t, string_split_regex(t, ' *[-|—_]+ *') AS parts FROM nt{i}), nt{i + 1} AS (SELECT {key}, CASE WHEN len(parts) >= 2 AND ({tail} = '' OR length({tail}) <= 16"
            f" OR regexp_matches({tail}, '(?i)({ENDINGS})$')) THEN {strip('array_to_string(parts[1:len(parts) - 1], chr(32) || chr(45) || chr(32))')} ELSE t END AS t FROM np{i})"
        )
    return out + f", titled AS (SELECT {key}, CASE WHEN t = '' THEN '未命名' ELSE t END AS title FROM nt3)"


def canonical(source: str, key: str, url: str) -> str:
    """CTEs; the last, ``canon``, has ``key`` and ``canonical``."""
    split = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
    dec = lambda x: f"url_decode(replace({x}, '+', ' '))"
    enc = lambda x: f"replace(url_encode({x}), '%20', '+')"
    return f"""c0 AS (SELECT {key}, {strip(url)} AS raw FROM {source}),
c1 AS (SELECT {key}, raw, lower(regexp_extract(raw, '{split}', 1)) AS s, lower(regexp_extract(raw, '{split}', 2)) AS n,
              regexp_replace(regexp_replace(regexp_extract(raw, '{split}', 3), ';[^/]*$', ''), '/+$', '') AS p, regexp_extract(raw, '{split}', 4) AS q FROM c0),
c2 AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: instr(x, '=') > 0),
              lambda x: struct_pack(k := {dec("substr(x, 1, instr(x, '=') - 1)")}, v := {dec("substr(x, instr(x, '=') + 1)")})),
              lambda x: x.v <> '' AND NOT starts_with(lower(x.k), 'utm_'))) AS kv FROM c1),
c3 AS (SELECT {key}, raw, n, p, array_to_string(list_transform(kv, lambda x: {enc("x.k")} || '=' || {enc("x.v")}), '&') AS q,
              CASE WHEN s = '' THEN 'https' ELSE s END || ':' || CASE WHEN n <> '' THEN '//' || n || CASE WHEN p = '' OR starts_with(p, '/') THEN p ELSE '/' || p END
                   WHEN p = '' OR starts_with(p, '/') THEN '//' || p ELSE p END AS base FROM c2),
canon AS (SELECT {key}, CASE WHEN raw = '' THEN '' WHEN n LIKE '%news.google.com' AND p LIKE '/rss/articles/%' THEN base
              ELSE regexp_replace(CASE WHEN q = '' THEN base ELSE base || '?' || q END, '/+$', '') END AS canonical FROM c3)"""


def blocks(source: str, key: str, html: str) -> str:
    """CTEs; the last, ``blocks``, has ``key``, ``pos`` from 0 and ``text``, blank ones too."""
    x = html
    for tag in ("script", "style", "noscript"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)<(?:p|li|h2|h3)(?:\s[^>]*)?>', chr(1), 'g')"
    x = rf"regexp_replace({x}, '(?i)</(?:p|li|h2|h3)\s*>', chr(2), 'g')"
    text = collapse(unescape("regexp_replace(split_part(part, chr(2), 1), '<[^>]*>', ' ', 'g')"))
    return f"""b0 AS (SELECT {key}, string_split({x}, chr(1)) AS parts FROM {source}),
b1 AS (SELECT {key}, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) - 1 AS pos FROM b0),
blocks AS (SELECT {key}, pos::INT AS pos, {text} AS text FROM b1)"""
