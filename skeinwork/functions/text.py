"""Text functions as columns: normal form, tokens, stop words, stems, phrases, links, slugs, matches and snippets.

Where an expression reads the same in Spark SQL and in standard SQL it is built as text, for both.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never indexed.
STOP_WORDS = """
a about above after again all also am an and any are as at be because been before being below between both but by can did
do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in
into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this those through to too under
until up very was we were what when where which while who whom why will with you your yours yourself yourselves
""".split()

# Quoted phrases that are no phrase queries.
STOP_PHRASES = ("what is", "how to", "tell me about", "explain")

# Suffixes in the order in which they are tried.
SUFFIXES = "ational iveness fulness ousness ization isation ability ibility ement ments ment ness tion sion ing ers est ies ed es ly s".split()
# Endings that get their e back.
SILENT_E = ("at", "bl", "iz", "us", "iv", "ou", "ur")


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to one plain letter, and that letter."""
    pairs = []
    for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if c == c.lower() and len(plain) == 1 and plain.isascii() and plain.isalnum():
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def normal_form(text: str | None) -> str:
    """The normal form of one string on the driver, for queries."""
    folded = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return re.sub("[^a-z0-9]+", " ", folded).strip()


def normalize(col: Column) -> Column:
    """Lower case, accents dropped, everything but letters and digits one space. Exact for Latin letters with accents;
    normalize_exact covers the compatibility forms that decompose to several letters."""
    t = F.translate(F.lower(F.coalesce(col, F.lit(""))), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[\\u0300-\\u036f]", ""), "[^a-z0-9]+", " "))


def normalize_exact(col: Column) -> Column:
    """The normal form with full compatibility decomposition, in Arrow batches; Spark has no built-in for it."""
    import pandas as pd

    def run(x):
        return x.map(normal_form)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(col)


def tokenize(col: Column, stop_words: bool = True) -> Column:
    """Tokens of a text; with stop_words, without these and without tokens of one character."""
    found = F.split(normalize(col), " ")
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS)) if stop_words else F.filter(found, lambda t: t != "")


def stop_words_removed(col: Column) -> Column:
    return F.filter(F.split(normalize(col), " "), lambda t: (t != "") & ((F.length(t) <= 1) | t.isin(STOP_WORDS)))


#: What is done for each suffix: what takes its place, and whether the rest is mended. The first suffix that fits counts; it leaves three letters.
RULES = [(s, "y" if s == "ies" else "", s in ("ing", "ed", "es", "ly")) for s in SUFFIXES]
LEFT = 3
#: Mending: a doubled consonant at the end is made single, then some endings get their e; both need more than two letters.
_DOUBLED = re.compile(r"(?<=.)([^aeiou])\1$")
_SILENT = re.compile(f"(?<=.)(?:{'|'.join(SILENT_E)})$")


def stem_word(t: str) -> str:
    """The stem of one token on the driver, for queries."""
    if len(t) <= LEFT or not t.isalpha():
        return t
    suffix, instead, mends = next((r for r in RULES if t.endswith(r[0]) and len(t) - len(r[0]) >= LEFT), ("", "", False))
    base = t.removesuffix(suffix) + instead
    if not mends:
        return base
    base = _DOUBLED.sub(r"\1", base)
    return f"{base}e" if _SILENT.search(base) else base


def stem_sql(t: str) -> str:
    """The stem of column t as SQL, by the same rules; for distinct words only, as it is long."""
    ends = ", ".join(f"'{e}'" for e in SILENT_E)

    def mended(b: str) -> str:
        one = f"(CASE WHEN length({b}) > 2 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) AND instr('aeiou', right({b}, 1)) = 0 THEN substr({b}, 1, length({b}) - 1) ELSE {b} END)"
        return f"(CASE WHEN length({one}) > 2 AND right({one}, 2) IN ({ends}) THEN {one} || 'e' ELSE {one} END)"

    def case(suffix: str, instead: str, mends: bool) -> str:
        base = f"substr({t}, 1, length({t}) - {len(suffix)})"
        base = f"{base} || '{instead}'" if instead else base
        return f"WHEN length({t}) >= {len(suffix) + LEFT} AND right({t}, {len(suffix)}) = '{suffix}' THEN {mended(base) if mends else base}"

    return f"CASE WHEN length({t}) <= {LEFT} OR translate({t}, '0123456789', '') <> {t} THEN {t} {' '.join(case(*r) for r in RULES)} ELSE {t} END"


def stem(name: str) -> Column:
    return F.expr(stem_sql(name))


def analyze_query(query: str | None) -> dict:
    """Phrases in quotes, and tokens (stems) of the rest, in order; a query is one string, read on the driver."""
    query = query or ""
    phrases = [p for p in map(normal_form, re.findall('"([^"]+)"', query)) if p and p not in STOP_PHRASES]
    rest = normal_form(re.sub('"[^"]*"', " ", query))
    kept = [t for t in rest.split() if len(t) > 1 and t not in STOP_WORDS]
    tokens = [stem_word(t) for t in kept]
    return {
        "normalized": rest, "tokens": tokens, "unique": sorted(set(tokens)), "phrases": phrases, "pairs": list(zip(tokens, kept)),
        "stop_words_removed": [t for t in rest.split() if len(t) <= 1 or t in STOP_WORDS], "length": len(tokens), "is_empty": not tokens and not phrases,
    }


def analyze(col: Column, stems: Column | None = None) -> Column:
    """struct(raw, normalized, tokens, unique, pairs of token and surface form, stop_words_removed, length). stems: an array of stems made at
    vocabulary level; without it tokens are surface forms."""
    surfaces = tokenize(col)
    tokens = surfaces if stems is None else stems
    pairs = F.zip_with(tokens, surfaces, lambda t, x: F.struct(t.alias("token"), x.alias("surface")))
    return F.struct(F.coalesce(col, F.lit("")).alias("raw"), pairs.alias("pairs"), normalize(col).alias("normalized"), tokens.alias("tokens"), F.array_sort(F.array_distinct(tokens)).alias("unique"), stop_words_removed(col).alias("stop_words_removed"), F.size(tokens).alias("length"))


def extract_phrases(col: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit('"([^"]+)"'), F.lit(1)), normalize)
    return F.filter(found, lambda p: (p != "") & ~p.isin(*STOP_PHRASES))


def extract_links(col: Column) -> Column:
    """Slugs in [[double brackets]], lower case, in the order of the text."""
    return F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(r"\[\[([A-Za-z0-9\-]+)\]\]"), F.lit(1)), F.lower)


def slugify(col: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    return F.when(s == "", "document").otherwise(s)


def split_keywords(col: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_input(col: Column, most: int = 300) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " ")), 1, most)


def parse_integers(col: Column, most: int = 60) -> Column:
    """Integers of a comma or space separated list, rounded; what is no number is left out."""
    found = F.filter(F.transform(F.split(F.trim(col), r"[,\s]+"), lambda x: F.round(x.try_cast("double")).cast("int")), lambda x: x.isNotNull())
    return F.slice(found, 1, most)


def parse_edges(col: Column) -> Column:
    """array<struct<l, r, w>> of "A-B:4, B-C"; a weight that is no number is 1, self loops and malformed parts are left out."""
    parts = F.transform(F.split(col, ","), lambda x: F.trim(x))
    made = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^([^-:]+)-([^-:]+)", 1)).alias("l"), F.trim(F.regexp_extract(p, r"^([^-:]+)-([^-:]+)", 2)).alias("r"), F.coalesce(F.regexp_extract(p, r":(.*)$", 1).try_cast("double"), F.lit(1.0)).alias("w")))
    return F.filter(made, lambda e: (e["l"] != "") & (e["r"] != "") & (e["l"] != e["r"]))


def edge_nodes(edges: Column) -> Column:
    """The nodes of parsed edges, in the order in which they are first named."""
    return F.array_distinct(F.flatten(F.transform(edges, lambda e: F.array(e["l"], e["r"]))))


def bounded_pattern(term: str) -> str:
    """A case-insensitive pattern for a whole word or phrase."""
    return rf"(?i)(?<![a-z0-9])\Q{term}\E(?![a-z0-9])" if "\\E" not in term else rf"(?i)(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])"


def matches_word(col: Column, term: str) -> Column:
    return F.coalesce(col, F.lit("")).rlike(bounded_pattern(term))


def count_overlapping(col: Column, pattern: str) -> Column:
    """Occurrences of a literal, overlapping ones too; an empty pattern has none."""
    if not pattern:
        return F.lit(0)
    literal = re.escape(pattern) if "\\E" in pattern else f"\\Q{pattern}\\E"
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(f"(?={literal})"))


def escape_html(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def matched_terms(col: Column, terms: list[str]) -> Column:
    """Those of the terms that a text has as whole words, in their order."""
    hits = [F.when(matches_word(col, t), t) for t in dict.fromkeys(terms) if t]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


_OPEN, _CLOSE = "\ue000", "\ue001"


def snippet(col: Column, terms: list[str], width: int = 220) -> Column:
    """HTML around the first whole-word match: escaped, cut to width with dots, matches marked. One pattern marks all terms,
    longest first, so marks never nest."""
    terms = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    text = F.coalesce(col, F.lit(""))
    if not terms:
        first = F.lit(0)
    else:
        found = [F.regexp_instr(text, F.lit(bounded_pattern(t))) for t in terms]
        first = F.least(*[F.when(f > 0, f) for f in found], F.lit(None).cast("int")) if len(found) > 0 else F.lit(0)
    start = F.greatest(F.lit(0), F.coalesce(first, F.lit(1)) - 1 - width // 3)
    cut = F.substr(text, start + 1, F.lit(width))
    dotted = F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + width < F.length(text), "...").otherwise(""))
    if not terms:
        html = escape_html(dotted)
    else:
        # Marks are set before escaping, as characters for private use, so no mark stands inside an entity.
        words = "|".join(re.escape(t) for t in terms)
        marked = F.regexp_replace(F.translate(dotted, _OPEN + _CLOSE, ""), f"(?i)(?<![a-z0-9])({words})(?![a-z0-9])", f"{_OPEN}$1{_CLOSE}")
        html = F.replace(F.replace(escape_html(marked), F.lit(_OPEN), F.lit("<mark>")), F.lit(_CLOSE), F.lit("</mark>"))
    return F.when(text == "", "").otherwise(html)


def highlight(col: Column, terms: list[str], limit: int = 3) -> Column:
    return snippet(col, terms, limit * 90)


# Presentation.


def format_ms(col: Column) -> Column:
    """Milliseconds: three places under one, two under a hundred, none above."""
    return F.concat(F.when(col < 1, F.format_number(col, 3)).when(col < 100, F.format_number(col, 2)).otherwise(F.format_number(col, 0)), F.lit(" ms"))


def format_compact(col: Column) -> Column:
    """1.2K, 3.4M; smaller numbers as they are."""
    scaled = F.when(col >= 1_000_000, F.concat(F.format_number(col / 1_000_000, 1), F.lit("M"))).when(col >= 1_000, F.concat(F.format_number(col / 1_000, 1), F.lit("K")))
    return F.coalesce(scaled, col.cast("string"))


def format_percent(col: Column) -> Column:
    return F.concat(F.format_number(col * 100, 1), F.lit("%"))


# Hashes.


def djb2(col: Column) -> Column:
    """h = h * 33 + code, modulo 2**32, from 5381."""
    return F.aggregate(F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))


def djb2_of(word: str) -> int:
    """djb2 of one word on the driver."""
    h = 5381
    for c in word:
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    return h


def polynomial_hash(col: Column, base: int = 31, mod: int = 1_000_003) -> Column:
    return F.aggregate(F.transform(F.filter(F.split(col, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), lambda h, c: (h * base + c) % mod)


def register(spark) -> None:
    """Functions for spark.sql: sk_normalize, sk_stem, sk_slugify, sk_djb2, sk_poly."""
    norm = f"trim(regexp_replace(translate(lower(coalesce(t, '')), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sk_normalize(t STRING) RETURNS STRING RETURN {norm}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sk_stem(t STRING) RETURNS STRING RETURN {stem_sql('t')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sk_slugify(t STRING) RETURNS STRING RETURN coalesce(nullif(substr(trim(BOTH '-' FROM regexp_replace(lower(coalesce(t, '')), '[^a-z0-9]+', '-')), 1, 80), ''), 'document')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sk_djb2(t STRING) RETURNS BIGINT RETURN aggregate(filter(split(t, ''), c -> c <> ''), 5381L, (h, c) -> (h * 33 + ascii(c)) & 4294967295)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sk_poly(t STRING) RETURNS BIGINT RETURN aggregate(filter(split(t, ''), c -> c <> ''), 0L, (h, c) -> (h * 31 + ascii(c)) % 1000003)")
