"""Text operators as Column expressions; each stays inside Catalyst.

Null text is empty text everywhere. White space is what Unicode calls so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class of the regex engine.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
#: Identifier, number, or a single sign.
TOKEN = rf"{IDENT}|\p{{Nd}}+|[^{SPACE}A-Za-z0-9_]"
_W = r"[\p{L}\p{N}_]"
_QUOTED = r"[`'\"]([^`'\"]+)[`'\"]"
_CODEISH = rf"[A-Za-z_]{_W}*\.[A-Za-z_]{_W}*|[A-Za-z_]{_W}*\(\)|[a-z]+_[a-z_]+|[a-z]+[A-Z]{_W}*"

# Words that are never keywords.
STOP_WORDS = """
a an the of to in on for and or is are be do does how what which where when why who
that this these those with without using use used i you we it its as at by from into
can could would should will shall may might must want need find get set write code
function method way given return returns some any all my your our their he she they
""".split()

# Words by which a query describes behaviour.
BEHAVIOUR_WORDS = """
compute calculate parse sort search reverse merge convert count check validate
generate produce return find determine implement solve print output format encode
decode filter transform traverse detect handle process build create remove insert
update delete append add subtract multiply divide compare match
""".split()

# Keywords a sketch takes for verbs.
SKETCH_VERBS = """
compute calculate parse sort search reverse merge convert count check validate
generate return find determine solve print filter transform traverse detect
handle process build create remove insert update delete append add
""".split()


def words_of(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def normalize_query(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends; case stays."""
    return strip(F.regexp_replace(text_of(c), rf"[{SPACE}]+", " "))


def clean_snippet(c: Column | str) -> Column:
    """One kind of line end, no blanks before it, at most one empty line in a row, no
    white space at the ends."""
    t = F.regexp_replace(text_of(c), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(\n|\z)", "$1")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def tokenize(c: Column | str) -> Column:
    """Lower-cased tokens; a token with underscores is followed by its parts. As the
    text is lower-cased first, camelCase words stay whole."""
    tokens = F.regexp_extract_all(F.lower(text_of(c)), F.lit(f"({TOKEN})"), F.lit(1))
    return F.flatten(
        F.transform(tokens, lambda t: F.concat(F.array(t), F.filter(F.split(t, "_+"), lambda p: (p != "") & (p != t))))
    )


def trigrams(token: Column) -> Column:
    """Trigrams of ``#token#``; none of a token shorter than three."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    empty = F.array().cast("array<string>")
    return F.when(F.length(token) >= 3, F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: F.substr(padded, i, F.lit(3)))).otherwise(empty)


def features(tokens: Column) -> Column:
    """Tokens and their trigrams, the latter marked by ``$``."""
    return F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.transform(trigrams(t), lambda g: F.concat(F.lit("$"), g)))))


def first_spellings(tokens: Column, fold: bool = True) -> Column:
    """Distinct tokens without regard to case, in order, in their first spelling."""
    low = F.transform(tokens, lambda t: F.lower(t)) if fold else tokens
    pairs = F.arrays_zip(tokens.alias("t"), low.alias("l"))
    kept = F.filter(pairs, lambda x, i: F.array_position(low, x.getField("l")) == i + 1)
    return F.transform(kept, lambda x: x.getField("t"))


def raw_keywords(c: Column) -> Column:
    """Keyword candidates of a normalised query, in order: identifiers of quoted spans,
    code-like tokens, other identifiers that aren't stop words."""
    quoted = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(_QUOTED), F.lit(1)), lambda s: F.regexp_extract_all(s, F.lit(f"({IDENT})"), F.lit(1))))
    codeish = F.regexp_extract_all(c, F.lit(f"({_CODEISH})"), F.lit(1))
    plain = F.filter(F.regexp_extract_all(c, F.lit(f"({IDENT})"), F.lit(1)), lambda t: ~F.array_contains(words_of(STOP_WORDS), F.lower(t)))
    return F.concat(quoted, codeish, plain)


def extract_keywords(c: Column, most: int = 12) -> Column:
    """At most ``most`` keywords, each once in its first spelling; expects normalised text."""
    return F.slice(first_spellings(raw_keywords(c)), 1, most)


def is_identifier(c: Column) -> Column:
    return c.rlike(rf"\A{IDENT}\z")


def classify_query(c: Column) -> Column:
    """``structural``, ``usage``, ``lookup``, ``behavioral`` or ``general``, the first
    that fits, of a normalised query."""
    low = F.lower(c)
    names = F.regexp_extract_all(low, F.lit(f"({IDENT})"), F.lit(1))
    structural = low.rlike(r"\b(which|what)\b.*\b(file|files|module|class|function)\b") & (
        low.contains("call") | low.contains("before") | low.contains("after") | low.contains("import")
    )
    usage = low.rlike(r"\bwhere\b.*\b(used|called|referenced|defined|declared|invoked)\b")
    lookup = c.rlike(_CODEISH) & (F.size(names) <= 4)
    behaviour = F.arrays_overlap(names, words_of(BEHAVIOUR_WORDS))
    return F.when(structural, "structural").when(usage, "usage").when(lookup, "lookup").when(behaviour, "behavioral").otherwise("general")


def is_behavioral(query_type: Column) -> Column:
    return query_type.isin("behavioral", "general")


def analyze_query(c: Column | str, normalize: bool = True, extract: bool = True, classify: bool = True) -> Column:
    """``raw, normalized, keywords, identifiers, query_type`` of a query, as a struct;
    a step that is switched off leaves its field plain."""
    raw = text_of(c)
    norm = normalize_query(raw) if normalize else raw
    keywords = extract_keywords(norm) if extract else F.array().cast("array<string>")
    return F.struct(
        raw.alias("raw"),
        norm.alias("normalized"),
        keywords.alias("keywords"),
        F.filter(keywords, is_identifier).alias("identifiers"),
        (classify_query(norm) if classify else F.lit("general")).alias("query_type"),
    )


def front_load(normalized: Column, raw: Column, keywords: Column, most: int = 6) -> Column:
    """The first keywords that don't already begin the text, before the text."""
    if most <= 0:
        return normalized
    base = F.when(normalized == "", raw).otherwise(normalized)
    low = F.lower(base)
    picks = F.slice(F.filter(keywords, lambda k: ~(low.startswith(F.concat(F.lower(k), F.lit(" "))) | low.startswith(F.concat(F.lower(k), F.lit(","))))), 1, most)
    return F.when(F.size(keywords) == 0, normalized).when(F.size(picks) == 0, base).otherwise(F.concat(F.array_join(picks, ", "), F.lit(". "), base))


def sketch_name(keywords: Column) -> Column:
    """A function's name from up to four keywords."""
    parts = F.filter(F.transform(keywords, lambda k: F.lower(F.regexp_replace(F.regexp_replace(k, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))), lambda p: p != "")
    name = F.array_join(F.slice(parts, 1, 4), "_")
    return F.when(name == "", "solution").when(name.rlike(r"^[0-9]"), F.concat(F.lit("f_"), name)).otherwise(name)


def quoted(c: Column) -> Column:
    """A keyword as a Python literal; keywords hold no quotes."""
    return F.concat(F.lit("'"), c, F.lit("'"))


def sketch(normalized: Column, keywords: Column, query_type: Column) -> Column:
    """A short piece of code that an answer to the query might look like."""
    name = sketch_name(keywords)
    fits = F.filter(keywords, lambda k: is_identifier(k) & (F.lower(k) != name))
    params = F.slice(fits, 1, 3)
    listed = F.when(F.size(params) > 0, F.array_join(params, ", ")).otherwise("data")
    verbs = F.filter(keywords, lambda k: F.array_contains(words_of(SKETCH_VERBS), F.lower(k)))
    nouns = F.slice(F.filter(keywords, lambda k: ~F.array_contains(words_of(SKETCH_VERBS), F.lower(k))), 1, 4)
    head = F.concat(F.lit("def "), name, F.lit("("), listed, F.lit('):\n    """'), F.replace(normalized, F.lit('"""'), F.lit("'''")), F.lit('"""\n'))
    walk = F.transform(
        nouns,
        lambda n: F.concat(F.lit("    # inspect references to "), n, F.lit("\n    for node in ast.walk(tree):\n        if getattr(node, 'id', None) == "), quoted(n), F.lit(":\n            result.append(node)\n")),
    )
    structural = F.concat(F.lit("    result = []\n"), F.array_join(walk, ""), F.lit("    return result"))
    call = F.concat(F.lit("    return "), F.when(F.size(nouns) > 0, F.get(nouns, F.lit(0))).otherwise("target"), F.lit("("), listed, F.lit(")"))
    note = F.when(F.size(verbs) > 0, F.concat(F.lit("        # "), F.array_join(verbs, " "), F.lit("\n"))).otherwise("")
    over = F.when(F.size(params) > 0, F.get(params, F.lit(0))).otherwise("data")
    loop = F.concat(F.lit("    result = []\n    for item in "), over, F.lit(":\n"), note, F.lit("        result.append(item)\n    return result"))
    return F.concat(head, F.when(query_type == "structural", structural).when(query_type.isin("lookup", "usage"), call).otherwise(loop))


def hyde_weight(query_type: Column, weight: float) -> Column:
    """How much a sketch counts beside its query."""
    w = F.lit(float(weight))
    return F.when(query_type == "lookup", w * 0.5).when(query_type.isin("behavioral", "general"), F.least(F.lit(1.0), w * 1.15)).otherwise(w)


def with_title(title: Column, body: Column) -> Column:
    """A title that isn't blank stands on its own line before the body."""
    t = strip(F.coalesce(title, F.lit("")))
    return F.when(t != "", F.concat(t, F.lit("\n"), F.coalesce(body, F.lit("")))).otherwise(F.coalesce(body, F.lit("")))


def prefixed(c: Column, prompt: str | None) -> Column:
    return F.concat(F.lit(prompt), c) if prompt else c


def chunk_lines(c: Column | str, max_chars: int = 4000, overlap: int = 200) -> Column:
    """Windows of whole lines of at most ``max_chars`` characters; each begins with the
    whole last lines of the one before that fit into ``overlap``. A line counts one
    character more than it has. A longer single line is a window of its own."""
    t = text_of(c)
    if max_chars <= 0:
        return F.array(t)
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n")
    )

    def tail(cur: Column) -> Column:
        init = F.struct(F.array().cast("array<string>").alias("got"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def take(a: Column, line: Column) -> Column:
            fits = a["on"] & (a["n"] + F.length(line) + 1 <= overlap)
            return F.struct(
                F.when(fits, F.concat(F.array(line), a["got"])).otherwise(a["got"]).alias("got"),
                F.when(fits, a["n"] + F.length(line) + 1).otherwise(a["n"]).alias("n"),
                fits.alias("on"),
            )

        return F.aggregate(F.reverse(cur), init, take)

    def step(a: Column, line: Column) -> Column:
        full = (a["n"] + F.length(line) + 1 > max_chars) & (F.size(a["cur"]) > 0)
        if overlap > 0:
            kept = tail(a["cur"])
            rest, size = kept["got"], kept["n"]
        else:
            rest, size = F.array().cast("array<string>"), F.lit(0)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["done"]).alias("done"),
            F.when(full, F.concat(rest, F.array(line))).otherwise(F.concat(a["cur"], F.array(line))).alias("cur"),
            (F.when(full, size).otherwise(a["n"]) + F.length(line) + 1).alias("n"),
        )

    folded = F.aggregate(F.split(t, "\n", -1), start, step)
    return F.when(F.length(t) <= max_chars, F.array(t)).otherwise(F.concat(folded["done"], F.array(F.array_join(folded["cur"], "\n"))))
