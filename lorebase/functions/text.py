"""Text functions as column expressions: they stay in the JVM and in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

WORD = r"[\p{L}\p{N}_]+"
PREFIX = "[DCFLPWR]"
NONE = "cast(array() as array<string>)"


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0)), F.expr(NONE))


def query_terms(c: Column, least: int = 2) -> Column:
    """Tokens that are no stop words and have `least` characters, in order, repeats kept."""
    return F.filter(tokens(c), lambda t: ~t.isin(K.STOP_WORDS) & (F.length(t) >= least))


def match_query(c: Column, mode: str = "AND") -> Column:
    """The query as quoted terms joined by AND or OR; empty if no term is left."""
    return F.array_join(F.transform(query_terms(c), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), f" {mode} ")


def dedup_terms(c: Column) -> Column:
    """The distinct terms of over three characters that duplicates are judged by."""
    return F.array_distinct(query_terms(c, 4))


def overlap(a: Column, b: Column) -> Column:
    """Common terms over the larger set's, to three digits; 0 if both are empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.round(F.when(most > 0, F.size(F.array_intersect(a, b)) / most).otherwise(0.0), 3)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def line_words(c: Column) -> Column:
    """The distinct words of over two characters that lines are prefiltered by."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-zåäö0-9_./#-]+"), F.lit(0)), lambda w: F.length(w) > 2))


def prefilter(a: Column, b: Column, least: float = 0.10) -> Column:
    wa, wb = line_words(a), line_words(b)
    return (F.size(wa) > 0) & (F.size(wb) > 0) & (jaccard(wa, wb) >= least)


_SUBJECT = rf"^\s*({PREFIX}):[ \t\r\f\x0B]*([^→∵⚠@△✓✗∅;>\s]+)"


def subject_prefix(c: Column) -> Column:
    """The letter that types the first line, null without a subject."""
    return F.nullif(F.regexp_extract(c, _SUBJECT, 1), F.lit(""))


def subject(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _SUBJECT, 2), F.lit(""))


def tag_list(tags: Column) -> Column:
    """Trimmed tags, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(tags, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def has_tag(tags: Column, tag: str) -> Column:
    """Whether the tag is one of the comma-separated atoms, spaces not trimmed."""
    return F.contains(F.concat(F.lit(","), F.coalesce(tags, F.lit("")), F.lit(",")), F.lit(f",{tag},"))


def is_bookkeeping(tag: Column) -> Column:
    low = F.lower(F.trim(tag))
    return reduce(Column.__or__, [low.startswith(p) for p in K.BOOKKEEPING_PREFIXES], low.isin(*K.BOOKKEEPING_TAGS))


def is_machine_made(tags: Column) -> Column:
    return F.lower(F.coalesce(tags, F.lit(""))).rlike("synthesized|nyx-cycle|bridge")


def stable_tags(tags: Column) -> Column:
    return F.array_join(F.filter(tag_list(tags), lambda t: ~is_bookkeeping(t)), ", ")


def embed_text(project: Column, content: Column, tags: Column, kind: Column, layer: Column) -> Column:
    """The text that an embedding stands for."""
    stable = stable_tags(tags)
    return F.trim(F.concat_ws(" ", project, F.when(kind != "fact", F.concat(F.lit("["), kind, F.lit("]"))), F.when(layer != "semantic", F.concat(F.lit("["), layer, F.lit("]"))), content, F.when(stable != "", stable)))


def text_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def map_glyphs(c: Column, only: set[str] | None = None) -> Column:
    """Operator glyphs replaced by words, runs of spaces collapsed."""
    for glyph, word in K.GLYPHS.items():
        if only is None or glyph in only:
            c = F.replace(c, F.lit(glyph), F.lit(word))
    return F.regexp_replace(c, " {2,}", " ")


def is_english(c: Column) -> Column:
    """Two function words, or over 15 % of words; else no letters beyond ASCII."""
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    hits = F.size(F.filter(tokens(c), lambda t: t.isin(K.ENGLISH)))
    return (words == 0) | (hits >= 2) | (hits / F.greatest(words, F.lit(1)) > 0.15) | ~c.rlike(r"[^\x00-\x7f]")


def non_english_share(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^\p{L}]|[a-zA-Z]", "")) / letters).otherwise(0.0)


def has_mojibake(c: Column) -> Column:
    return F.coalesce(reduce(Column.__or__, [F.contains(c, F.lit(s)) for s in K.MOJIBAKE]), F.lit(False))


def lines(c: Column) -> Column:
    """Lines that aren't blank, as they are."""
    return F.filter(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")


def content_lines(c: Column) -> Column:
    """Trimmed lines without rules (---)."""
    return F.filter(F.transform(F.split(explode_chain(c), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("---"))


def explode_chain(c: Column) -> Column:
    """A one-line chain of typed statements, one to a line.

    Cuts stand after ';' or '.' and before a prefix that isn't a drive letter. Nothing but
    white space and ';' may change, else the text is returned as it is.
    """
    cut = F.regexp_replace(c, rf"(?<=[;.])\s*(?={PREFIX}:(?![\\/]))", "\n")
    parts = F.filter(F.transform(F.split(cut, "\n"), lambda p: F.trim(F.regexp_replace(F.trim(p), r";+\s*$", ""))), lambda p: p != "")
    out, bare = F.array_join(parts, "\n"), lambda x: F.regexp_replace(x, r"[\s;]+", "")
    return F.when(~F.contains(c, F.lit("\n")) & (F.size(parts) >= 2) & (bare(out) == bare(c)), out).otherwise(c)


def tag_supported(tag: Column, content: Column) -> Column:
    """The tag, or all its terms, stand in the text."""
    low, text = F.lower(tag), F.lower(content)
    terms = F.regexp_extract_all(low, F.lit("[a-z0-9åäö]{3,}"), F.lit(0))
    return F.contains(text, low) | ((F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(text, t)))


def slug(c: Column) -> Column:
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 40)
    return F.when(out == "", F.lit("misc")).otherwise(out)


def digits(c: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))


def digit_guard(original: Column, changed: Column) -> Column:
    """The changed text, unless its numbers differ from the original's."""
    return F.when(digits(original) == digits(changed), changed).otherwise(original)


def needs_prefix(c: Column) -> Column:
    """Whether the first line has no type prefix."""
    return ~F.regexp_replace(c, r"^\s+", "").rlike(rf"^{PREFIX}:")


def fact_key(line: Column) -> Column:
    """prefix|subject of a typed fact (the subject ends at an arrow), null if it is none."""
    m = F.regexp_extract(line, rf"^\s*({PREFIX}):\s*([^→]*)", 2)
    return F.when(line.rlike(rf"^\s*{PREFIX}:"), F.concat(F.regexp_extract(line, rf"^\s*({PREFIX}):", 1), F.lit("|"), F.lower(F.trim(m))))


def evidence_sessions(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"D(\d+):(\d+)"), F.lit(1)), lambda x: x.cast("int"))))


def best_sentence(content: Column, query: Column, chars: int) -> Column:
    """The sentence with most query words, the first of equals; else the head of the text."""
    words = F.array_distinct(query_terms(query, 3))
    sentences = F.split(F.trim(content), r"(?<=[.!?])\s+")
    scored = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(words, tokens(s))).alias("hits"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(scored)
    head = F.concat(F.substring(content, 1, chars), F.when(F.length(content) > chars, F.lit(" …")).otherwise(F.lit("")))
    cut = F.concat(F.substring(best["s"], 1, chars), F.when(F.length(best["s"]) > chars, F.lit(" …")).otherwise(F.lit("")))
    return F.when(best["hits"] > 0, cut).otherwise(head)


def marked_window(content: Column, query: Column, chars: int) -> Column:
    """The stretch of words that holds most hits of the query's words, each marked ⟪so⟫; null without a hit.

    A stretch has chars / 6 words, at least 8 and at most 64, and starts at a hit; of equals the first counts.
    """
    size = max(8, min(64, chars // 6))
    wanted = F.array_distinct(query_terms(query, 1))
    words = F.split(F.trim(content), r"\s+")
    hit = F.transform(words, lambda w: F.arrays_overlap(tokens(w), wanted))
    at = F.filter(F.transform(hit, lambda h, i: F.when(h, i)), lambda i: i.isNotNull())
    scored = F.transform(at, lambda p: F.struct(F.size(F.filter(at, lambda q: (q >= p) & (q < p + size))).alias("n"), (-p).alias("at")))
    start = F.greatest(F.lit(0), F.least(-F.array_max(scored)["at"], F.size(words) - size))
    told = F.transform(words, lambda w, i: F.when(F.get(hit, i), F.concat(F.lit("⟪"), w, F.lit("⟫"))).otherwise(w))
    cut = F.array_join(F.slice(told, start + 1, size), " ")
    out = F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), cut, F.when(start + size < F.size(words), F.lit(" …")).otherwise(F.lit("")))
    return F.when(F.size(at) > 0, out)


def compact(row: Column) -> Column:
    """A struct as JSON without its null fields."""
    return F.to_json(row, {"ignoreNullFields": "true"})


def window_around(text: Column, anchor: Column, chars: int = 120) -> Column:
    """About `chars` characters around the anchor's first occurrence, else the head."""
    half = max(chars // 2, 40)
    at = F.position(anchor, text)
    start = F.greatest(F.lit(0), at - 1 - half)
    end = F.least(F.length(text), at - 1 + F.length(anchor) + half)
    cut = F.concat(F.when(start > 0, F.lit("… ")).otherwise(F.lit("")), F.substring(text, start + 1, end - start), F.when(end < F.length(text), F.lit(" …")).otherwise(F.lit("")))
    head = F.concat(F.substring(text, 1, chars), F.when(F.length(text) > chars, F.lit(" …")).otherwise(F.lit("")))
    return F.when((F.length(anchor) > 0) & (at > 0), cut).otherwise(head)


def headline(c: Column, most: int = 160) -> Column:
    """The first line, cut at the end of a sentence, a clause or a word past a third of `most`."""
    line = F.trim(F.element_at(F.split(c, "\n"), 1))
    cut, least = F.substring(line, 1, most), most // 3
    # greedy: up to the last such mark with over `least` characters before it
    sentence = F.coalesce(*[F.nullif(F.regexp_extract(cut, rf"(?s)^(.{{{least + 1},}}[{x}]) ", 1), F.lit("")) for x in ".!?"])
    clause = F.coalesce(*[F.nullif(F.regexp_extract(cut, rf"(?s)^(.{{{least + 1},}}){x} ", 1), F.lit("")) for x in ";,"])
    word = F.nullif(F.regexp_extract(cut, rf"(?s)^(.{{{least + 1},}}) ", 1), F.lit(""))
    short = F.coalesce(F.concat(F.coalesce(sentence, clause, word), F.lit(" …")), F.concat(cut, F.lit("…")))
    return F.when(F.length(line) <= most, line).otherwise(short)


def verdict(reply: Column) -> Column:
    """True for CORRECT, false for INCORRECT, by the first line and else anywhere; null if neither."""
    def of(c: Column) -> Column:
        return F.when(F.contains(c, F.lit("INCORRECT")), F.lit(False)).when(F.contains(c, F.lit("CORRECT")), F.lit(True))

    return F.coalesce(of(F.element_at(F.split(F.upper(F.trim(reply)), "\n"), 1)), of(F.upper(reply)))


def weave_reply(reply: Column) -> Column:
    """link_type, strength (0.1 to 1) and insight of a judge's reply."""
    kind = F.lower(F.regexp_extract(reply, r"(?im)^LINK_TYPE:\s*(\w+)", 1))
    strength = F.try_to_number(F.regexp_extract(reply, r"(?im)^STRENGTH:\s*([0-9.]+)", 1), F.lit("9.999")).cast("double")
    return F.struct(kind.alias("link_type"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.coalesce(strength, F.lit(0.5)))).alias("strength"), F.regexp_extract(reply, r"(?im)^INSIGHT:\s*(.+)$", 1).alias("insight"))


def class_reply(reply: Column) -> Column:
    """The class before the bar of CLASS|explanation, upper-cased."""
    return F.upper(F.trim(F.element_at(F.split(F.element_at(F.split(F.trim(reply), "\n"), 1), r"\|"), 1)))


def insights_reply(reply: Column) -> Column:
    return F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("L:"))


def survival_reply(reply: Column) -> Column:
    """How many facts a reply calls preserved and dropped."""
    starts = lambda p: F.size(F.filter(F.split(reply, "\n"), lambda x: F.trim(x).startswith(p)))
    return F.struct(starts("PRESERVED:").alias("preserved"), starts("DROPPED:").alias("dropped"))
