"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from gleanframe.functions.text import BEHAVIOUR_WORDS, SKETCH_VERBS, STOP_WORDS

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
TOKEN = rf"{IDENT}|\p{{Nd}}+|[^{SPACE}A-Za-z0-9_]"
_W = r"[\p{L}\p{N}_]"
CODEISH = rf"[A-Za-z_]{_W}*\.[A-Za-z_]{_W}*|[A-Za-z_]{_W}*\(\)|[a-z]+_[a-z_]+|[a-z]+[A-Z]{_W}*"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


STOP, BEHAVIOUR, VERBS = listed(STOP_WORDS), listed(BEHAVIOUR_WORDS), listed(SKETCH_VERBS)

#: One row per item of the corpus.
ITEMS = "items AS (SELECT doc_id, min(doc_pos) AS doc_pos, min(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id)"
#: One row per query.
ASKED = "asked AS (SELECT query_id, min(text) AS text FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


def normalized(x: str) -> str:
    inner = rf"regexp_replace(coalesce({x}, ''), '[{SPACE}]+', ' ', 'g')"
    return strip(inner)


def cleaned(x: str) -> str:
    t = rf"regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g')"
    t = rf"regexp_replace({t}, '[ \t]+(\n|\z)', '\1', 'g')"
    return strip(rf"regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def tokens(x: str) -> str:
    return f"flatten(list_transform(regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}'), lambda t: list_concat([t], list_filter(string_split(t, '_'), lambda p: p <> '' AND p <> t))))"


def features(toks: str) -> str:
    grams = "CASE WHEN length(t) >= 3 THEN list_transform(range(1, length(t) + 1), lambda i: '$' || substr('#' || t || '#', i, 3)) ELSE [] END"
    return f"flatten(list_transform({toks}, lambda t: list_concat([t], {grams})))"


def keywords_cte(source: str, out: str = "analysed") -> str:
    """CTEs that analyse ``source(query_id, text)``."""
    return rf"""
norm AS (SELECT query_id, coalesce(text, '') AS raw, {normalized("text")} AS n FROM {source}),
cand AS (
  SELECT query_id, raw, n, list_concat(list_concat(
      flatten(list_transform(regexp_extract_all(n, '[`''"]([^`''"]+)[`''"]', 1), lambda s: regexp_extract_all(s, '{IDENT}'))),
      regexp_extract_all(n, '{CODEISH}')),
      list_filter(regexp_extract_all(n, '{IDENT}'), lambda t: NOT list_contains({STOP}, lower(t)))) AS c
  FROM norm),
low AS (SELECT *, list_transform(c, lambda t: lower(t)) AS l FROM cand),
{out} AS (
  SELECT query_id, raw, n AS normalized, list_slice(list_filter(c, lambda t, i: list_position(l, lower(t)) = i), 1, 12) AS keywords,
    CASE WHEN regexp_matches(lower(n), '\b(which|what)\b.*\b(file|files|module|class|function)\b')
              AND (contains(lower(n), 'call') OR contains(lower(n), 'before') OR contains(lower(n), 'after') OR contains(lower(n), 'import')) THEN 'structural'
         WHEN regexp_matches(lower(n), '\bwhere\b.*\b(used|called|referenced|defined|declared|invoked)\b') THEN 'usage'
         WHEN regexp_matches(n, '{CODEISH}') AND len(regexp_extract_all(lower(n), '{IDENT}')) <= 4 THEN 'lookup'
         WHEN list_has_any(regexp_extract_all(lower(n), '{IDENT}'), {BEHAVIOUR}) THEN 'behavioral'
         ELSE 'general' END AS query_type
  FROM low)"""


def sketch(norm: str = "normalized", kws: str = "keywords", kind: str = "query_type") -> str:
    parts = f"list_filter(list_transform({kws}, lambda k: lower(regexp_replace(regexp_replace(k, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g'))), lambda p: p <> '')"
    base = f"array_to_string(list_slice({parts}, 1, 4), '_')"
    name = f"CASE WHEN {base} = '' THEN 'solution' WHEN regexp_matches({base}, '^[0-9]') THEN 'f_' || {base} ELSE {base} END"
    params = rf"list_slice(list_filter({kws}, lambda k: regexp_full_match(k, '{IDENT}') AND lower(k) <> {name}), 1, 3)"
    plist = f"CASE WHEN len({params}) > 0 THEN array_to_string({params}, ', ') ELSE 'data' END"
    verbs = f"list_filter({kws}, lambda k: list_contains({VERBS}, lower(k)))"
    nouns = f"list_slice(list_filter({kws}, lambda k: NOT list_contains({VERBS}, lower(k))), 1, 4)"
    nl = "chr(10)"
    head = f"""'def ' || {name} || '(' || {plist} || '):' || {nl} || '    \"\"\"' || replace({norm}, '\"\"\"', '''''''') || '\"\"\"' || {nl}"""
    walk = (
        f"array_to_string(list_transform({nouns}, lambda k: '    # inspect references to ' || k || {nl} || '    for node in ast.walk(tree):' || {nl}"
        f" || '        if getattr(node, ''id'', None) == ''' || k || ''':' || {nl} || '            result.append(node)' || {nl}), '')"
    )
    structural = f"'    result = []' || {nl} || {walk} || '    return result'"
    call = f"'    return ' || CASE WHEN len({nouns}) > 0 THEN {nouns}[1] ELSE 'target' END || '(' || {plist} || ')'"
    note = f"CASE WHEN len({verbs}) > 0 THEN '        # ' || array_to_string({verbs}, ' ') || {nl} ELSE '' END"
    over = f"CASE WHEN len({params}) > 0 THEN {params}[1] ELSE 'data' END"
    loop = f"'    result = []' || {nl} || '    for item in ' || {over} || ':' || {nl} || {note} || '        result.append(item)' || {nl} || '    return result'"
    return f"({head} || CASE WHEN {kind} = 'structural' THEN {structural} WHEN {kind} IN ('lookup', 'usage') THEN {call} ELSE {loop} END)"


def sparse_vectors(name: str, source: str, key: str, text: str = "text", dim: int = 1024) -> str:
    """CTEs that make ``name(key, idx, w)``, the unit vectors of hashed features."""
    keys = key.split(", ")
    k = ", ".join(keys)
    return f"""
{name}_f AS (SELECT {k}, unnest({features(tokens(text))}) AS f FROM {source}),
{name}_c AS (SELECT {k}, f, count(*) AS n FROM {name}_f GROUP BY {k}, f),
{name}_h AS (SELECT {k}, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h, n FROM {name}_c),
{name}_s AS (SELECT {k}, CAST(h % {dim} AS BIGINT) AS idx, sum((CASE WHEN h >= 9223372036854775808 THEN 1.0 ELSE -1.0 END)::DOUBLE * (1 + ln(n))) AS w FROM {name}_h GROUP BY {k}, idx),
{name}_n AS (SELECT {k}, greatest(sqrt(sum(w * w)), 1e-12) AS norm FROM {name}_s GROUP BY {k}),
{name} AS (SELECT {k}, idx, w / norm AS w FROM {name}_s JOIN {name}_n USING ({k}))"""


def bm25_cte() -> str:
    """CTEs that make ``scored(query_id, doc_id, bm25)`` of queries and corpus."""
    return f"""
{ITEMS}, {ASKED},
toks AS (SELECT doc_id, {tokens("text")} AS t FROM items),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, sizes),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM asked) GROUP BY ALL),
scored AS (
  SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25
  FROM qt JOIN stats USING (term) JOIN post USING (term), sizes GROUP BY query_id, doc_id)"""
