"""Text scalars as column expressions: normal forms, tests, tokens, scores, identifiers and lists.

Where a value is used inside a lambda more than once, it is bound first (`_let`), so that it is
computed once for a row and not once for an element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words that the retrieval tokens leave out.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with", "using", "use")

# Patterns of boilerplate.
NOISE = (
    r"\bcookie(s)?\b",
    r"\bprivacy policy\b",
    r"\bterms of use\b",
    r"\ball rights reserved\b",
    r"\bcopyright\b",
    r"\bskip to (main )?content\b",
    r"\bsign in\b|\blogin\b|\blog out\b",
    r"\bcontact us\b|\bsitemap\b|\bmenu\b|\bsearch\b",
    r"\bsubscribe\b|\bnewsletter\b|\bfollow us\b",
    r"\bfacebook\b|\btwitter\b|\blinkedin\b|\byoutube\b",
    r"\baccessibility\b|\bnon-discrimination\b",
    r"\bpowered by\b|\bback to top\b",
)


# All of NOISE are whole words: their edge is looked for once, not once for each.
_NOISY = r"(?i)\b(?:" + "|".join(NOISE).replace(r"\b", "") + r")\b"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def one_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_lines(text: Column) -> Column:
    """Lines trimmed, blank ones dropped; \\r\\n and no-break spaces are made plain."""
    plain = F.regexp_replace(F.regexp_replace(text, " ", " "), r"\r\n?", "\n")
    return F.array_join(F.filter(F.transform(F.split(plain, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), "\n")


def _count(text: Column, pattern: str) -> Column:
    """Characters of the text in the class `pattern`, taken out by runs: a match costs more than a character."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern + "+", ""))


def noisy(text: Column, min_chars: int = 40, max_url_share: float = 0.20) -> Column:
    """True for short, numeric, shouted, link-laden or boilerplate text."""

    def judge(t: Column) -> Column:
        size = F.char_length(t)
        words = F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))
        links = F.aggregate(F.regexp_extract_all(t, F.lit(r"https?://\S+|www\.\S+"), F.lit(0)), F.lit(0), lambda n, x: n + F.char_length(x))

        def counted(x: Column) -> Column:
            letters, words = x["letters"], x["words"]
            shouted = (words <= 20) & (_count(t, r"\p{Lu}") > letters * 0.75)
            return (letters < 8) | (_count(t, r"\p{Nd}") > size * 0.35) | (words < 6) | shouted | (links > size * max_url_share) | t.rlike(_NOISY)

        return (size < min_chars) | _let(F.struct(_count(t, r"\p{L}").alias("letters"), words.alias("words")), counted)

    return _let(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), judge)


def compressed(text: Column, limit: int) -> Column:
    """Lines of 4 characters or more that are not just digits and do not open a back matter section, cut to `limit`."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: (F.char_length(x) >= 4) & ~x.rlike(r"^\d+$") & ~F.lower(x).rlike(r"^(references|copyright|table of contents)"))
    return F.substring(F.array_join(kept, "\n"), 1, limit)


def without_controls(text: Column) -> Column:
    """Without control characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def safe_name(text: Column, length: int = 200) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), 1, length)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 20)


def excerpt(text: Column, limit: int = 260) -> Column:
    """At most `limit` (80 at least) characters, cut at the last space if that leaves three fifths."""
    cap = max(80, limit)

    def cut(s: Column) -> Column:
        clipped = F.regexp_replace(F.substring(s, 1, cap), r"\s+$", "")
        last = F.char_length(F.regexp_replace(clipped, r"[^ ]*$", "")) - 1
        short = F.when(last >= int(cap * 0.6), F.rtrim(F.substring(clipped, F.lit(1), F.greatest(last, F.lit(0))))).otherwise(clipped)
        return F.when(F.char_length(s) <= cap, s).otherwise(short)

    return _let(one_space(F.coalesce(text, F.lit(""))), cut)


def snake(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9_]+", "_")


def snake_list(texts: Column) -> Column:
    """Snake-case tokens without outer underscores or blanks, each once in order."""
    return F.array_distinct(F.filter(F.transform(texts, lambda x: F.regexp_replace(snake(F.trim(x)), "^_+|_+$", "")), lambda x: x != ""))


def phrase(text: Column) -> Column:
    """Lower case with plain quotes; only letters, digits, spaces, hyphens, underscores and slashes stay."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[‘’“”]", "'")
    return one_space(F.regexp_replace(plain, r"[^a-z0-9\s\-_/]", " "))


def free_text(text: Column) -> Column:
    """Lower case with single spaces for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def match_tokens(text: Column, least: int = 3) -> Column:
    """Tokens of `least` characters or more that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens(text), lambda t: (F.char_length(t) >= least) & ~F.array_contains(stop, t))


def lexical_score(query: Column, content: Column) -> Column:
    """Share of the query's tokens (repeats counted) that the content has, plus 0.30 if it holds the
    whole query or 0.15 if it holds its first tokens (three to five) as a phrase; at most 1."""

    def scored(q: Column) -> Column:
        whole, terms, body, has = (q[k] for k in ("text", "tokens", "body", "has"))
        hits = F.size(F.filter(terms, lambda t: F.array_contains(has, t)))
        opening = F.array_join(F.slice(terms, 1, 5), " ")
        bonus = F.when(F.contains(body, whole), 0.30).when((F.size(terms) >= 3) & F.contains(body, opening), 0.15).otherwise(0.0)
        return F.when((F.size(terms) == 0) | (F.size(has) == 0), 0.0).otherwise(F.least(F.lit(1.0), hits / F.size(terms) + bonus))

    q, c = (F.lower(one_space(F.coalesce(x, F.lit("")))) for x in (query, content))
    return _let(F.struct(q.alias("text"), match_tokens(q).alias("tokens"), c.alias("body"), F.array_distinct(match_tokens(c)).alias("has")), scored)


def coverage_weighted(lexical: Column, coverage: Column) -> Column:
    """A lexical score lifted by how far the requirement is covered."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(coverage, F.lit(0.0))))
    return lexical * (0.65 + 0.35 * held)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_chunks(text: Column, size: int = 220) -> Column:
    """Consecutive chunks of `size` words; no words give no chunk. The words are split once."""

    def cut(words: Column) -> Column:
        n = F.ceil(F.size(words) / size).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * size + 1, F.lit(size)), " "))
        return F.when(n > 0, parts).otherwise(F.array().cast("array<string>"))

    return _let(words_of(text), cut)


def unit_float(value: Column, default: float = 0.0) -> Column:
    """A number from text within 0 and 1; what is none, NaN or infinite is the default."""
    number = value.try_cast("double")
    bad = number.isNull() | F.isnan(number) | number.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def optional_bool(text: Column) -> Column:
    """True, false or null from the usual words."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False)


def vector(text: Column) -> Column:
    """A vector from its text; null where it is none."""
    return F.nullif(F.from_json(F.trim(text), "array<float>"), F.array().cast("array<float>"))


def from_inverted_index(index: Column) -> Column:
    """Text from map<word, positions>: words in order of position, gaps skipped; null if nothing is left."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(e["value"], lambda p: p >= 0), lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " "), F.lit(""))


def doi(text: Column) -> Column:
    """Without the prefixes doi: and https://doi.org/."""
    bare = F.trim(F.regexp_replace(one_space(F.coalesce(text, F.lit(""))), r"(?i)^doi:\s*", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def work_id(text: Column) -> Column:
    """The last part of a path if it is a letter A or W and digits."""
    last = F.trim(F.element_at(F.split(F.regexp_replace(one_space(F.coalesce(text, F.lit(""))), "/+$", ""), "/"), -1))
    return F.when(last.rlike(r"^[AW]\d+$"), last)


def query_value(url: Column, name: str) -> Column:
    """A parameter of a URL's query; null where there is none."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def listed(text: Column, pattern: str = "[,;]") -> Column:
    """Parts of a list, in lower case, trimmed, each once in order; blanks go."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern, -1), lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def emails(text: Column) -> Column:
    return F.filter(listed(text), lambda x: F.contains(x, F.lit("@")))


def piped(text: Column) -> Column:
    """Parts between bars, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|", -1), lambda x: F.trim(x)), lambda x: x != "")


def one_of(text: Column, allowed: dict[str, str], default: str | None = None) -> Column:
    """The canonical name of an alias, or the default."""
    t, out = F.lower(F.trim(text)), F.lit(default)
    for alias, name in reversed(allowed.items()):
        out = F.when(t == alias, F.lit(name)).otherwise(out)
    return out


def json_object(text: Column) -> Column:
    """The first JSON object of a noisy answer; the text itself if none begins there or it does not end or parse.

    A fold over brackets, quotes and escapes: brackets within strings do not count, and what follows
    the object's end is left alone. A code fence before it is skipped like any other text.
    """
    body = F.substring(text, F.locate("{", text), F.char_length(text))
    parts = F.regexp_extract_all(body, F.lit(r'(?s)\\.|"|[{}]|[^\\"{}]+|\\'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("length"), F.lit(False).alias("over"))

    def step(at: Column, part: Column) -> Column:
        depth = at["depth"] + F.when(at["quoted"], 0).when(part == "{", 1).when(part == "}", -1).otherwise(0)
        moved = F.struct(depth.alias("depth"), F.when(part == '"', ~at["quoted"]).otherwise(at["quoted"]).alias("quoted"), (at["length"] + F.char_length(part)).alias("length"), (depth == 0).alias("over"))
        return F.when(at["over"], at).otherwise(moved)

    def found(end: Column) -> Column:
        whole = F.substring(body, F.lit(1), end["length"])
        return F.when(end["over"] & F.try_parse_json(whole).isNotNull(), whole).otherwise(text)

    return F.when(F.locate("{", text) > 0, _let(F.aggregate(parts, start, step), found)).otherwise(text)


def joined_once(texts: Column, between: str = "\n\n") -> Column:
    """Texts joined, each once by its lower-cased, single-spaced form; blanks go.

    Each text is normalised once; sorted by form and place, a form's first text stands after another form's.
    """
    clean = F.filter(F.transform(texts, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    keyed = F.array_sort(F.transform(clean, lambda x, i: F.struct(F.lower(one_space(x)).alias("key"), i.alias("place"), x.alias("text"))))

    def firsts(rows: Column) -> Column:
        first = F.filter(rows, lambda r, i: (i == 0) | (r["key"] != F.get(rows, i - 1)["key"]))
        return F.array_join(F.transform(F.array_sort(F.transform(first, lambda r: F.struct(r["place"], r["text"]))), lambda r: r["text"]), between)

    return _let(keyed, firsts)


def search_text(*parts: Column) -> Column:
    """Single-spaced parts that are not blank, one on each line."""
    return F.concat_ws("\n", *(F.nullif(one_space(p), F.lit("")) for p in parts))


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(value, F.lit(0.0)))


# Patterns of score wording and what stands in for each, in this order; aliases of source types; fit labels; broad categories.
SCORE_MARKS = (
    (r"\(\s*score\s*=\s*[-+]?\d*\.?\d+\s*\)", ""),
    (r",\s*src\s*=\s*[-+]?\d*\.?\d+", ""),
)
SCORE_WORDS = (
    (r"\(\s*score\s*=\s*[-+]?\d*\.?\d+\s*\)", ""),
    (r"\b(?:score|scored|scoring)\b\s*[:=]?\s*[-+]?\d*\.?\d+%?", ""),
    (r"\bat\s+[-+]?\d*\.?\d+%?\b", ""),
    (r"\bhighest[-\s]?scoring\b", "strong"),
    (r"\brequirements?\b", "priority areas"),
    (r"\balignment\b", "fit"),
)
SOURCE_TYPES = {
    "additional_info_chunk": "additional_info_chunk",
    "faculty_additional_info_chunk": "additional_info_chunk",
    "grant_additional_info_chunk": "additional_info_chunk",
    "attachment_chunk": "attachment_chunk",
    "attachments_chunk": "attachment_chunk",
    "publication": "publication",
    "faculty_publication": "publication",
}
FIT_LABELS = {"greate": "great", "mismatch": "mismatch", "bad": "bad", "good": "good", "great": "great", "fantastic": "fantastic"}
BROAD_CATEGORIES = {x: x for x in ("basic_research", "applied_research", "educational", "unclear")}


def _replaced(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    for pattern, instead in patterns:
        text = F.regexp_replace(text, "(?i)" + pattern, instead)
    return text


def without_score_marks(text: Column) -> Column:
    """Without the marks of scores that contexts carry; null is empty."""
    return _replaced(F.coalesce(text, F.lit("")), SCORE_MARKS)


def without_scores(text: Column) -> Column:
    """Single-spaced, without numbers of scores, and with plain words for requirements and alignment; null is empty."""
    return one_space(_replaced(one_space(F.coalesce(text, F.lit(""))), SCORE_WORDS))


def source_type(text: Column) -> Column:
    """The canonical type of a source; one that is unknown stays, in lower case with underscores."""
    token = F.regexp_replace(F.lower(one_space(F.coalesce(text, F.lit("")))), "[- ]", "_")
    return F.coalesce(one_of(token, SOURCE_TYPES), token)


def fit_label(text: Column) -> Column:
    """One of the fit labels; mismatch for any other."""
    return one_of(F.coalesce(text, F.lit("")), FIT_LABELS, "mismatch")


def broad_category(text: Column) -> Column:
    """One of the broad categories; unclear for any other."""
    return one_of(F.coalesce(text, F.lit("")), BROAD_CATEGORIES, "unclear")
