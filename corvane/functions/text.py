"""Text functions, Column to Column. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lex

LETTER = r"[\p{L}\p{N}_]"
WORD = LETTER + "{3,}"
#: The characters of Unicode's property White_Space, which ``\s`` has with the flag U.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def words_literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.btrim(text, F.lit(SPACES))  # looks at the ends only; a regular expression would look at every character


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def fallback(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def lowered(text: Column) -> Column:
    """Lower-cased and with the dotless i as i; empty for null."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ı"), F.lit("i"))


def tokens(text: Column, stop=lex.STOP_WORDS) -> Column:
    """Words of at least three characters outside the stop list, lower-cased and with the dotless i as i."""
    found = F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop))


def clean_html(html: Column) -> Column:
    """Text of markup: scripts, styles and comments out, tags as line breaks, common entities as characters, white space tidied."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"(?U)\s+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def html_title(html: Column) -> Column:
    return strip(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_items(html: Column, pattern: str = lex.LIST_CITATION, most: int = 20) -> Column:
    """Texts of list items that match a pattern."""
    items = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    plain = F.transform(items, lambda x: strip(squeeze(F.regexp_replace(x, r"(?s)<[^>]*>", " "))))
    return F.slice(F.filter(plain, lambda x: F.regexp_like(x, F.lit(pattern))), 1, most)


def after(text: Column, marker: str) -> Column:
    """What follows the first marker, or the whole text."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + F.lit(len(marker)), F.length(text))).otherwise(text)


def from_last(text: Column, markers, size: int = 2000) -> Column:
    """``size`` characters from the last place of the first marker that occurs; empty without one."""
    out = F.lit("")
    for m in reversed(list(markers)):
        back = F.instr(F.reverse(text), m[::-1])
        out = F.when(back > 0, F.substring(text, F.length(text) - back - F.lit(len(m)) + F.lit(2), F.lit(size))).otherwise(out)
    return out


def clean_markdown(text: Column) -> Column:
    """Without emphasis marks; blank lines and blanks tidied."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?d)\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?d)\*(.+?)\*", "$1")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"[ \t]+", " "))


def source_label(source: Column, labels: dict[str, str] = lex.SOURCE_LABELS) -> Column:
    """The code's label, else the code."""
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), source)


def chamber(text: Column, source: Column) -> Column:
    """Chamber or board named in the first 500 characters, else the source's label, else the source, else unknown."""
    head = F.substring(text, 1, 500)
    return fallback(strip(F.regexp_extract(head, "(?U)" + lex.CHAMBER, 1)), F.regexp_extract(head, lex.BOARD, 1), source_label(source), F.lit("Bilinmeyen"))


def statutes(text: Column, patterns=(lex.STATUTE, lex.ARTICLE), most: int = 20) -> Column:
    """Distinct matches of the patterns, one pattern after the other, in order."""
    found = [F.transform(F.regexp_extract_all(text, F.lit("(?U)" + p), F.lit(0)), strip) for p in patterns]
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def subject(text: Column, size: int = 200) -> Column:
    """The first subject line's content."""
    return F.substring(strip(F.regexp_extract(text, "(?U)" + lex.SUBJECT, 1)), 1, size)


def title(board: Column, case_no: Column, decision_no: Column) -> Column:
    """Board and numbers; a missing number is written None."""
    return F.concat(board, F.lit(" - E. "), F.coalesce(case_no, F.lit("None")), F.lit(", K. "), F.coalesce(decision_no, F.lit("None")))


def sentences(text: Column) -> Column:
    """Split at white space after a full stop, exclamation or question mark; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def summary(text: Column, most: int = 3, longer: int = 30) -> Column:
    """The first sentences longer than ``longer`` characters."""
    return F.array_join(F.slice(F.filter(sentences(text), lambda s: F.length(s) > longer), 1, most), " ")


def claims(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: F.length(s) > 15)


def citations(text: Column) -> Column:
    """Distinct cited numbers."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\[Karar\s+(\d+)\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def norm_keyword(text: Column) -> Column:
    """Lower case, punctuation as blanks, white space as one blank."""
    return squeeze(F.regexp_replace(F.lower(text), r"""[.,;:!?"'()\[\]/—–\-]""", " "))


def norm_graded(text: Column) -> Column:
    """Lower case, dotless i as i, a with circumflex as a."""
    return F.translate(F.lower(text), "ıâ", "ia")


def norm_query(text: Column) -> Column:
    """All kinds of i as i, circumflexes off, lower case, white space as one blank, stripped."""
    t = F.replace(text, F.lit("i̇"), F.lit("i"))
    return strip(squeeze(F.lower(F.translate(t, "İIıâîû", "iiiaiu"))))


def informative_passage(text: Column, markers=lex.CONTENT_MARKERS, size: int = 2000, before: int = 1500) -> Column:
    """``size`` characters from the first marker (in the order given) that begins within the first ``before`` characters, stripped."""
    start = F.lit(1)
    for m in reversed(list(markers)):
        at = F.instr(text, m)
        start = F.when((at >= 1) & (at <= before), at).otherwise(start)
    return strip(F.substring(text, start, F.lit(size)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leftmost(text: Column, terms: Column) -> Column:
    """1-based place of the first of any term in the lower-cased text; null without one."""
    return let(F.lower(text), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)))


def snippet(text: Column, terms: Column, size: int = 600, before: int = 100) -> Column:
    """``size`` characters from ``before`` characters ahead of the first hit, with dots where text was cut."""

    def cut(span: Column) -> Column:
        head, tail = F.when(span.s > 0, "...").otherwise(""), F.when(span.e < F.length(text), "...").otherwise("")
        return F.concat(head, F.substring(text, span.s + 1, span.e - span.s), tail)

    def around(at: Column) -> Column:
        start = F.when(at.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), at - 1 - before))
        return let(start, lambda s: let(F.struct(s.alias("s"), F.least(F.length(text), s + size).alias("e")), cut))

    return let(leftmost(text, terms), around)


#: What ``term_counts`` makes.
TERMS = "array<struct<tok: string, tf: long>>"


def term_counts(tokens: Column) -> Column:
    """The distinct tokens with their counts: sorted, a token's run ends where the next one's begins."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("tok"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs)).otherwise(F.array().cast(TERMS))


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def marked_snippet(query: Column, text: Column, size: int = 420, before: int = 80, stop=lex.HIGHLIGHT_STOP) -> Column:
    """A snippet with the query's words of four letters or more in section marks, longest words first."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(query, F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0)), lambda w: ~F.array_contains(words_literal(stop), F.lower(w))))
    mark = lambda s, w: F.regexp_replace(s, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])("), w, F.lit(r")(?![\p{L}\p{N}_])")), F.lit("§§$1§§"))

    def with_words(ws: Column) -> Column:
        longest = F.array_sort(ws, lambda a, b: F.length(b) - F.length(a))
        start = F.greatest(F.lit(0), F.coalesce(leftmost(text, F.transform(ws, F.lower)), F.lit(1)) - 1 - before)
        return let(start, lambda s: F.concat(F.when(s > 0, "… ").otherwise(""), F.aggregate(longest, strip(squeeze(F.substring(text, s + 1, F.lit(size)))), mark), F.when(F.length(text) > size, " …").otherwise("")))

    return let(words, with_words)


def marks_to_html(text: Column) -> Column:
    return F.regexp_replace(text, "§§(.+?)§§", "<mark>$1</mark>")


def prefixed(text: Column, kind: str) -> Column:
    """With the prefix that encoders of queries and passages expect."""
    return F.concat(F.lit(f"{kind}: "), text)


def near_key(text: Column) -> Column:
    """Signature of near-identical openings: of the first 120 characters in lower case, the first 80 that are letters, digits or underscores."""
    return F.substring(F.regexp_replace(F.lower(F.substring(text, 1, 120)), r"[^\p{L}\p{N}_]", ""), 1, 80)


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
