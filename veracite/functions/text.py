"""Text as Column expressions: cleaning, paragraphs, windows of words, excerpts. All of them stay in the JVM.

A null input gives null unless stated. Lengths and places count code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, with the four separators that some libraries count too.
WS = r"[\x1c-\x1f\s]"
WS_IN_LINE = r"[\x1c-\x1f[^\S\n]]"
SQUASHED = rf"(?U){WS}+"

# Fixed values: (text before a lost glyph, text after it, the ligature that was lost), tried in this order.
LIGATURES = [
    ("fi", "hs", "ft"), ("so", "ware", "ft"), ("o", "en", "ft"), ("a", "er", "ft"),
    ("di", "erent", "ff"), ("di", "erence", "ff"), ("e", "ect", "ff"), ("e", "ort", "ff"), ("e", "icient", "ff"), ("su", "icient", "ff"), ("o", "ice", "ff"), ("a", "orded", "ff"), ("sta", "", "ff"),
    ("arti", "cial", "fi"), ("speci", "c", "fi"), ("classi", "cation", "fi"), ("identi", "ed", "fi"), ("justi", "ed", "fi"), ("bene", "t", "fi"), ("con", "rm", "fi"), ("de", "ne", "fi"), ("signi", "cant", "fi"),
    ("in", "uence", "fl"), ("re", "ect", "fl"),
]
# Elements whose content isn't text, and entities (the ampersand's own comes last).
HTML_DROPPED = ["script", "style", "nav", "header", "footer"]
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
    ("&sect;", "§"), ("&para;", "¶"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]
# A subsection's marker, and a section's label, at the start of a paragraph.
SUBSECTION = r"^(?:([A-Z])\.\s+(?=[A-Z(“])|\(([a-z])\)\s+)"
SECTION = r"^(?:§+\s*|Sec(?:tion)?\.?\s+)?((?:\d+[-.]\d+(?:[-.]\d+)*)|(?:\d{1,3}))\s*[.:—-]?\s+(?=[A-Z])"
# What makes a question one for advice, in lower case.
ADVICE = [
    r"\bshould i\b", r"\bwill i win\b", r"\bdo i have a case\b", r"\bcan i sue\b",
    r"\bam i going to\b", r"\bwhat are my chances\b", r"\bshould we settle\b", r"\bis it worth suing\b",
]
TOKENS_PER_WORD = 1.3


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{WS}+|{WS}+$", "")


def squash(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, SQUASHED, " "))


def words(c: Column) -> Column:
    """The words, between white space; an empty array for an empty text."""
    s = squash(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def token_estimate(c: Column) -> Column:
    """Words times 1.3 in double, cut to an integer."""
    return (F.size(words(c)) * F.lit(TOKENS_PER_WORD)).cast("int")


def _gaps(c: Column, glyph: str) -> tuple[Column, Column]:
    """The text before the first lost glyph, and for each glyph (fill: null where no rule explains it, rest: what follows).

    One pass: a glyph's rule depends on the letters on both sides of it, up to the next glyph, and on no other glyph, as no
    rule's letters hold a ligature.
    """
    quoted = r"\x00" if glyph == "\x00" else "".join("\\" + x if not x.isalnum() else x for x in glyph)
    parts = F.split(c, quoted, -1)
    n = F.size(parts) - 1
    before, after = max(len(x) for x, _, _ in LIGATURES), max(len(x) for _, x, _ in LIGATURES)
    sides = F.zip_with(
        F.slice(parts, F.lit(1), n), F.slice(parts, F.lit(2), n),
        lambda x, y: F.struct(F.lower(F.right(x, F.lit(before))).alias("left"), F.lower(F.left(y, F.lit(after))).alias("right"), y.alias("rest")),
    )

    def fill(g: Column) -> Column:
        rules = F.when(F.lit(False), "")
        for left, right, letters in LIGATURES:
            near = F.endswith(g["left"], F.lit(left))
            rules = rules.when(near & F.startswith(g["right"], F.lit(right)) if right else near, letters)
        return rules

    return F.get(parts, F.lit(0)), F.transform(sides, lambda g: F.struct(fill(g).alias("fill"), g["rest"].alias("rest")))


def repair_ligatures(c: Column, glyph: str = "\x00") -> Column:
    """Fills lost glyphs from what stands beside them; those left over become ff."""
    first, gaps = _gaps(c, glyph)
    filled = F.transform(gaps, lambda g: F.concat(F.coalesce(g["fill"], F.lit("ff")), g["rest"]))
    return F.when(F.contains(c, F.lit(glyph)), F.concat(first, F.array_join(filled, ""))).otherwise(c)


def residual_ligatures(c: Column, glyph: str = "\x00") -> Column:
    """How many lost glyphs no rule explains."""
    left = F.size(F.filter(_gaps(c, glyph)[1], lambda g: g["fill"].isNull()))
    return F.when(F.contains(c, F.lit(glyph)), left).otherwise(F.lit(0) + 0 * F.length(c))


def normalise(c: Column) -> Column:
    """Ligatures, private-use bullets, line ends, runs of spaces and tabs."""
    c = F.replace(repair_ligatures(c), F.lit("\uf0b7"), F.lit("•"))
    return F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")


def paragraphs(c: Column) -> Column:
    """Rejoins wrapped lines: a paragraph ends at a blank line and after a line that ends in . : ; ! or ?; lines of digits go.

    One pass of expressions over the text, no rows for lines and so no shuffle.
    """
    lines = F.regexp_replace(c, rf"(?Umd)^{WS_IN_LINE}+|{WS_IN_LINE}+$", "")
    lines = F.regexp_replace(lines, r"(?md)^[\p{Nd}²³¹⁰-⁹₀-₉]+$\n?", "")
    parts = F.split(lines, r"\n{2,}|(?<=[.:;!?])\n")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")


def reflow(c: Column) -> Column:
    """The paragraphs, with a blank line between them."""
    return F.array_join(paragraphs(c), "\n\n")


def blocks(c: Column) -> Column:
    """The parts between blank lines, with single spaces, empty ones left out."""
    parts = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"\n\n+")
    return F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"[ \t]+", " "))), lambda p: p != "")


def section_label(block: Column, least: int = 80) -> Column:
    """The section number that a block of more than `least` characters starts with, else null."""
    return F.when(F.length(block) > least, F.nullif(F.regexp_extract(block, "(?U)" + SECTION, 1), F.lit("")))


def subsection(paragraph: Column) -> Column:
    """The letter that marks a subsection, else null."""
    found = [F.nullif(F.regexp_extract(paragraph, "(?U)" + SUBSECTION, i), F.lit("")) for i in (1, 2)]
    return F.coalesce(*found)


def without_marker(paragraph: Column) -> Column:
    return F.regexp_replace(paragraph, "(?U)" + SUBSECTION, "")


def split_long(c: Column, most: int = 2200) -> Column:
    """Pieces of at most `most` characters, cut after the last ". " in the second half, else hard; stripped."""
    half = most // 2

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        cut = F.length(F.regexp_extract(F.substring(rest, 1, most), r"(?s)^(.*)\. ", 1))
        at = F.when(cut > half, cut + 1).otherwise(F.lit(most))
        # the cut is bound once, by a transform over one element
        made = F.transform(F.array(at), lambda n: F.struct(strip(F.substr(rest, n + 1)).alias("rest"), F.concat(state["pieces"], F.array(strip(F.substr(rest, F.lit(1), n)))).alias("pieces")))[0]
        return F.when(F.length(rest) > most, made).otherwise(state)

    start = F.struct(c.alias("rest"), F.array().cast("array<string>").alias("pieces"))
    rounds = F.sequence(F.lit(1), F.floor(F.length(c) / half).cast("int") + 1)
    cut = F.aggregate(rounds, start, step, lambda s: F.filter(F.concat(s["pieces"], F.array(s["rest"])), lambda p: p != ""))
    return F.when(F.length(c) <= most, F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))).otherwise(cut)


def excerpt(c: Column, most: int = 420) -> Column:
    """At most `most` characters of the stripped text, cut before the last space that isn't the first character, then "..."."""
    t = strip(c)
    head = F.regexp_extract(F.substring(t, 1, most), r"(?s)^(.+) [^ ]*$", 1)
    kept = F.when(head != "", head).otherwise(F.substring(t, 1, most))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(kept, rf"(?U){WS}+$", ""), F.lit("...")))


def asks_for_advice(c: Column, patterns: list[str] = ADVICE) -> Column:
    """Word borders are those of Unicode, so letters of any language count."""
    return F.lower(c).rlike("(?U)(?:" + ")|(?:".join(patterns) + ")")


def html_text(c: Column) -> Column:
    """The text nodes of an HTML page, one per line; scripts, styles, navigation, headers, footers and comments are left out."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in HTML_DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"\n[ \t\r\n]*\n", "\n"), r"^\n|\n$", "")
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), HTML_ENTITIES, c)


def citation_scope(c: Column) -> Column:
    """0 for the provisions of the widest reach, then 1, then 2: a broader rule is cited first."""
    return F.when(c.startswith("29 CFR"), 0).when(c.startswith("41 CFR"), 1).otherwise(2)


def ordered_citations(c: Column) -> Column:
    """An array of citations by scope, then by text."""
    pairs = F.transform(c, lambda x: F.struct(citation_scope(x).alias("s"), x.alias("c")))
    return F.transform(F.array_sort(pairs), lambda p: p["c"])


def full_citation(citation: Column, letter: Column) -> Column:
    return F.when(F.coalesce(letter, F.lit("")) != "", F.concat(citation, F.lit("("), letter, F.lit(")"))).otherwise(citation)


def header(title: Column, heading: Column, citation: Column, status: Column) -> Column:
    """title | heading | citation, and | STATUS: what it is, where that isn't in_force."""
    tag = F.when(status == "in_force", F.lit("")).otherwise(F.concat(F.lit(" | STATUS: "), status))
    return squash(F.concat(F.concat_ws(" | ", title, heading, citation), tag))


def window_sizes(size: int = 512, overlap: int = 64) -> tuple[int, int]:
    """(step, width) in words of windows given in tokens."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    return max(1, int((size - overlap) / TOKENS_PER_WORD)), max(1, int(size / TOKENS_PER_WORD))


def window_starts(n_words: Column, step: int, width: int) -> Column:
    """Starts of the windows over so many words: the last is the first that reaches the end; none without words."""
    last = F.greatest(F.lit(0), F.ceil((n_words - width) / F.lit(step))) * step
    return F.when(n_words > 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
