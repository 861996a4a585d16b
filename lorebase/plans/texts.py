"""Queries of text functions, over every memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import splitting
from ..functions import text as T
from ..operators import consolidation as C
from ..operators import evaluation
from . import views
from .registry import registry
from .views import sql, with_more

QUERIES, ORACLES, query = registry()
_W = r"'[\p{L}\p{N}_]+'"


def _content():
    return F.col("content")


@query(sql(f"SELECT query_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(query), {_W}), lambda t: length(t) >= 2 AND NOT list_contains({views.STOP}, t)), lambda t: '\"' || t || '\"'), ' AND ') AS match FROM queries"))
def clean_query(spark, sf):
    return views.queries(spark, sf).select("query_id", T.match_query(F.col("query")).alias("match"))


@query(sql("SELECT id, hash FROM hashes"))
def embed_text_hash(spark, sf):
    c = F.col
    return views.memories(spark, sf).select("id", T.text_hash(T.embed_text(c("project"), _content(), c("tags"), c("type"), c("layer"))).alias("hash"))


@query(sql("SELECT id, tags FROM stable"))
def stable_tags(spark, sf):
    return views.memories(spark, sf).select("id", T.stable_tags(F.col("tags")).alias("tags"))


_GLYPHS = "content || ' a→b ∵ c ✓  d ∅'"
_MAP = _GLYPHS
for _g, _w in K.GLYPHS.items():
    _MAP = f"replace({_MAP}, '{_g}', '{_w}')"


@query(sql(f"SELECT id, regexp_replace({_MAP}, ' {{2,}}', ' ', 'g') AS mapped FROM memories"))
def operator_map(spark, sf):
    return views.memories(spark, sf).select("id", T.map_glyphs(F.concat(_content(), F.lit(" a→b ∵ c ✓  d ∅"))).alias("mapped"))


@query(sql(r"SELECT id, round(CASE WHEN length(regexp_replace(content, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(content, '[^\p{L}]|[a-zA-Z]', '', 'g')) / length(regexp_replace(content, '[^\p{L}]', '', 'g'))::DOUBLE ELSE 0 END, 6) AS share FROM memories"))
def non_english_share(spark, sf):
    return views.memories(spark, sf).select("id", F.round(T.non_english_share(_content()), 6).alias("share"))


@query(with_more(rf"w AS (SELECT id, content, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n, len(list_filter(regexp_extract_all(lower(content), {_W}), lambda t: list_contains({K.ENGLISH}, t))) AS hits FROM memories)", r"SELECT id, n = 0 OR hits >= 2 OR hits / greatest(n, 1)::DOUBLE > 0.15 OR NOT regexp_matches(content, '[^\x00-\x7f]') AS english FROM w"))
def english_rows(spark, sf):
    return views.memories(spark, sf).select("id", T.is_english(_content()).alias("english"))


@query(sql(r"SELECT count(*) FILTER (WHERE length(regexp_replace(content, '[^\p{L}]|[a-zA-Z]', '', 'g')) > 0.005 * length(regexp_replace(content, '[^\p{L}]', '', 'g')) AND length(regexp_replace(content, '[^\p{L}]', '', 'g')) > 0) AS affected, count(*) AS total FROM memories"))
def language_scan(spark, sf):
    from ..operators import maintenance

    return maintenance.language_scan(views.memories(spark, sf))


@query(sql("SELECT id, " + " OR ".join(f"contains(content || CASE WHEN id % 9 = 0 THEN 'Ã¤' ELSE '' END, '{s}')" for s in K.MOJIBAKE) + " AS mojibake FROM memories"))
def mojibake_rows(spark, sf):
    return views.memories(spark, sf).select("id", T.has_mojibake(F.concat(_content(), F.when(F.col("id") % 9 == 0, "Ã¤").otherwise(""))).alias("mojibake"))


@query(with_more(r"x AS (SELECT id, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-zåäö0-9_./#-]+'), lambda w: length(w) > 2)) AS w FROM memories), p AS (SELECT a.id, a.w AS wa, b.w AS wb FROM x a JOIN x b ON b.id = a.id + 1)", "SELECT id, round(len(list_intersect(wa, wb)) / greatest(len(list_distinct(list_concat(wa, wb))), 1)::DOUBLE, 6) AS jaccard, len(wa) > 0 AND len(wb) > 0 AND len(list_intersect(wa, wb)) / greatest(len(list_distinct(list_concat(wa, wb))), 1)::DOUBLE >= 0.1 AS passes FROM p"))
def jaccard_prefilter(spark, sf):
    m = views.memories(spark, sf)
    both = m.select("id", _content().alias("ca")).join(m.select((F.col("id") - 1).alias("id"), _content().alias("cb")), "id")
    return both.select("id", F.round(T.jaccard(T.line_words(F.col("ca")), T.line_words(F.col("cb"))), 6).alias("jaccard"), T.prefilter(F.col("ca"), F.col("cb")).alias("passes"))


_FACT = "(['D:', 'C:', 'F:', 'L:', 'P:', 'W:', 'R:', ''])[id % 8 + 1] || ' ' || content"


def _fact():
    return F.concat(F.element_at(F.array(*map(F.lit, ["D:", "C:", "F:", "L:", "P:", "W:", "R:", ""])), (F.col("id") % 8 + 1).cast("int")), F.lit(" "), _content())


_SUBJ = r"'^\s*([DCFLPWR]):[ \t\r\f\x0B]*([^→∵⚠@△✓✗∅;>\s]+)'"


@query(sql(f"SELECT id, nullif(regexp_extract({_FACT}, {_SUBJ}, 1), '') AS prefix, nullif(regexp_extract({_FACT}, {_SUBJ}, 2), '') AS subject, NOT regexp_matches(regexp_replace({_FACT}, '^\\s+', ''), '^[DCFLPWR]:') AS bare FROM memories"))
def cml_subject_prefix(spark, sf):
    return views.memories(spark, sf).select("id", T.subject_prefix(_fact()).alias("prefix"), T.subject(_fact()).alias("subject"), T.needs_prefix(_fact()).alias("bare"))


@query(sql(r"SELECT id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_replace(x, '\s', '', 'g') <> ''))::INT AS lines FROM memories"))
def line_counts(spark, sf):
    return views.memories(spark, sf).select("id", F.size(T.lines(_content())).alias("lines"))


@query(sql(r"SELECT id, array_to_string(list_sort(regexp_extract_all(content, '\d+')), ',') AS digits, CASE WHEN id % 2 = 0 THEN content ELSE CASE WHEN regexp_matches(content, '1') THEN content ELSE content || ' ok' END END AS guarded FROM memories"))
def digit_guard(spark, sf):
    changed = F.when(F.col("id") % 2 == 0, _content()).otherwise(F.when(F.contains(_content(), F.lit("1")), F.replace(_content(), F.lit("1"), F.lit("one"))).otherwise(F.concat(_content(), F.lit(" ok"))))
    return views.memories(spark, sf).select("id", F.array_join(T.digits(_content()), ",").alias("digits"), T.digit_guard(_content(), changed).alias("guarded"))


@query(with_more(r"d AS (SELECT a.id, list_distinct(regexp_extract_all(a.content, '\d+')) AS x, list_distinct(regexp_extract_all(b.content, '\d+')) AS y FROM memories a JOIN memories b ON b.id = a.id + 1)", "SELECT id, round(CASE WHEN len(x) > 0 THEN len(list_intersect(x, y)) / len(x)::DOUBLE ELSE 1 END, 6) AS integrity FROM d"))
def digit_integrity(spark, sf):
    m = views.memories(spark, sf)
    both = m.select("id", _content().alias("ca")).join(m.select((F.col("id") - 1).alias("id"), _content().alias("cb")), "id")
    return both.select("id", evaluation.digit_integrity(F.col("ca"), F.col("cb")).alias("integrity"))


@query(with_more(r"t AS (SELECT id, lower(content) AS c, lower(trim(unnest(string_split(tags || ',the license,und', ',')))) AS tag FROM memories)", "SELECT id, tag, contains(c, tag) OR (len(regexp_extract_all(tag, '[a-z0-9åäö]{3,}')) > 0 AND len(list_filter(regexp_extract_all(tag, '[a-z0-9åäö]{3,}'), lambda x: NOT contains(c, x))) = 0) AS supported FROM t"))
def tag_support(spark, sf):
    rows = views.memories(spark, sf).select("id", "content", F.explode(T.tag_list(F.concat("tags", F.lit(",the license,und")))).alias("tag"))
    return rows.select("id", F.lower("tag").alias("tag"), T.tag_supported(F.col("tag"), _content()).alias("supported"))


@query(with_more(r"s AS (SELECT id, substr(regexp_replace(regexp_replace(lower(content), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS s FROM memories)", "SELECT id, CASE WHEN s = '' THEN 'misc' ELSE s END AS slug FROM s"))
def slugs(spark, sf):
    return views.memories(spark, sf).select("id", T.slug(_content()).alias("slug"))


@query(with_more("a AS (SELECT id, content, strpos(content, 'license') AS p FROM memories)", "SELECT id, CASE WHEN p > 0 THEN CASE WHEN p - 1 - 60 > 0 THEN '… ' ELSE '' END || substr(content, greatest(0, p - 61) + 1, least(length(content), p - 1 + 7 + 60) - greatest(0, p - 61)) || CASE WHEN p - 1 + 7 + 60 < length(content) THEN ' …' ELSE '' END ELSE left(content, 120) || CASE WHEN length(content) > 120 THEN ' …' ELSE '' END END AS snippet FROM a"))
def match_window(spark, sf):
    return views.memories(spark, sf).select("id", T.window_around(_content(), F.lit("license")).alias("snippet"))


@query(sql("SELECT id, CASE WHEN length(content) > 30 THEN 'CORRECT' ELSE 'INCORRECT' END = 'CORRECT' AS verdict FROM memories"))
def judge_verdicts(spark, sf):
    reply = F.concat(F.when(F.length(_content()) > 30, "correct").otherwise("Incorrect"), F.lit("\nbecause"))
    return views.memories(spark, sf).select("id", T.verdict(reply).alias("verdict"))


@query(sql("SELECT id, (id % 4)::INT AS preserved, (id % 3)::INT AS dropped FROM memories"))
def fact_survival(spark, sf):
    reply = F.concat(F.repeat(F.lit("PRESERVED: x\n"), (F.col("id") % 4).cast("int")), F.repeat(F.lit(" DROPPED: y\n"), (F.col("id") % 3).cast("int")))
    return views.memories(spark, sf).select("id", T.survival_reply(reply).alias("r")).select("id", "r.preserved", "r.dropped")


@query(sql("SELECT id, array_to_string(list_sort(list_distinct([id % 7, id % 5])), ',') AS sessions FROM memories"))
def evidence_sessions(spark, sf):
    text = F.concat(F.lit("D"), (F.col("id") % 7).cast("string"), F.lit(":3; D"), (F.col("id") % 5).cast("string"), F.lit(":12"))
    return views.memories(spark, sf).select("id", F.array_join(T.evidence_sessions(text).cast("array<string>"), ",").alias("sessions"))


@query(sql("SELECT id, 'F: one.' || chr(10) || 'D: two ' || id || chr(10) || 'W: see D:/mnt' AS exploded FROM memories"))
def explode_chain(spark, sf):
    return views.memories(spark, sf).select("id", T.explode_chain(F.concat(F.lit("F: one. D: two "), F.col("id").cast("string"), F.lit("; W: see D:/mnt;"))).alias("exploded"))


_CHAIN = r"'F:' || regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '\. ', '. D: ', 'g') || '; W:end'"
_PIECES = rf"cut AS (SELECT id, {_CHAIN} AS c FROM memories), pieces AS (SELECT id, c, list_filter(list_transform(string_split(regexp_replace(regexp_replace(c, '([;.])\s*([DCFLPWR]:)([^\\/])', '\1' || chr(10) || '\2\3', 'g'), '([;.])\s*([DCFLPWR]:)([^\\/])', '\1' || chr(10) || '\2\3', 'g'), chr(10)), lambda x: trim(regexp_replace(trim(x), ';+\s*$', ''))), lambda x: x <> '') AS p FROM cut)"


@query(with_more(_PIECES, r"SELECT id, sha256(CASE WHEN len(p) >= 2 AND regexp_replace(array_to_string(p, chr(10)), '[\s;]+', '', 'g') = regexp_replace(c, '[\s;]+', '', 'g') THEN array_to_string(p, chr(10)) ELSE c END) AS hash FROM pieces"))
def explode_chains(spark, sf):
    """Every memory as a chain of statements, exploded."""
    chain = F.concat(F.lit("F:"), F.regexp_replace(F.regexp_replace(_content(), r"\s+", " "), r"\. ", ". D: "), F.lit("; W:end"))
    return views.memories(spark, sf).select("id", T.text_hash(T.explode_chain(chain)).alias("hash"))


@query(sql("SELECT id, true AS same FROM memories"))
def explode_forms_agree(spark, sf):
    """The expression and the Python form of the chain splitter, on every memory as a chain."""
    chain = F.concat(F.lit("F:"), F.regexp_replace(F.regexp_replace(_content(), r"\s+", " "), r"\. ", ". D: "), F.lit("; W:end"))
    return views.memories(spark, sf).select("id", (T.explode_chain(chain) == splitting.explode_udf(chain)).alias("same"))


def _packs(name: str, source: str, most: int) -> str:
    """SQL of name(id, k, a, e): the stretches a..e of source(id, k, costs) that greedy packing makes, by cut points among the cumulative costs."""
    return f"""{name}_c AS (SELECT id, k, list_transform(range(0, len(costs) + 1), lambda i: list_sum(costs[1:i])::BIGINT) AS t FROM {source}),
{name}_t AS (SELECT id, k, list_transform(t, lambda x: coalesce(x, 0)) AS t FROM {name}_c),
{name} AS (SELECT id, k, 1::BIGINT AS a, greatest(1, len(list_filter(t, lambda x: x <= {most})) - 1)::BIGINT AS e, t FROM {name}_t WHERE len(t) > 1
 UNION ALL SELECT id, k, e + 1, greatest(e + 1, len(list_filter(t, lambda x: x <= t[e + 1] + {most})) - 1)::BIGINT, t FROM {name} WHERE e + 1 < len(t))"""


_SMALL, _TARGET = 400, 300
_BLOCKS = rf"""long AS (SELECT id, content FROM memories WHERE length(content) > {_SMALL}),
bl AS (SELECT id, 0 AS k, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(content, '^(\s*\n)+', ''), '(\n\s*)+$', ''), '\n(?:\s*\n)+'), lambda x: trim(x) <> '') AS parts FROM long),
bc AS (SELECT id, k, list_transform(parts, lambda x: length(x) + 3) AS costs FROM bl),
{_packs("bp", "bc", _TARGET + 2)},
ch AS (SELECT bp.id, a AS block, array_to_string(parts[a:e], chr(10) || chr(10)) AS body, length(parts[a]) + 2 > {_TARGET} AS over, string_split(parts[a], chr(10)) AS lines FROM bp JOIN bl USING (id)),
lc AS (SELECT id, block AS k, list_transform(lines, lambda x: length(x) + 1) AS costs FROM ch WHERE over),
{_packs("lp", "lc", _TARGET)},
every AS (SELECT id, block, 0 AS pos, body FROM ch WHERE NOT over UNION ALL SELECT lp.id, lp.k, lp.a, array_to_string(lines[lp.a:lp.e], chr(10)) FROM lp JOIN ch ON ch.id = lp.id AND ch.block = lp.k
 UNION ALL SELECT id, 0, 0, content FROM memories WHERE length(content) <= {_SMALL})"""


@query(with_more(_BLOCKS, "SELECT id, (row_number() OVER (PARTITION BY id ORDER BY block, pos))::INT AS part, sha256(body) AS hash FROM every").replace("WITH ", "WITH RECURSIVE ", 1))
def split_chunks(spark, sf):
    """Every chunk of every memory, split small, by its hash."""
    rows = splitting.pieces(views.memories(spark, sf), lambda x: splitting.split_content(x, _SMALL, _TARGET))
    return rows.select("id", "part", T.text_hash(F.col("body")).alias("hash"))


_PARAGRAPHS = f"""pa AS (SELECT id, 0 AS k, string_split(content, chr(10) || chr(10)) AS parts FROM memories WHERE length(content) > {K.CHUNK_CHARS}),
pc AS (SELECT id, k, list_transform(parts, lambda x: length(x) + 2) AS costs FROM pa),
{_packs("pp", "pc", K.CHUNK_CHARS + 2)},
pt AS (SELECT pp.id, a, array_to_string(parts[a:e], chr(10) || chr(10)) AS body FROM pp JOIN pa USING (id)),
every AS (SELECT id, a, pos, substr(body, pos + 1, {K.CHUNK_CHARS}) AS body FROM (SELECT *, unnest(range(0, length(body), {K.CHUNK_CHARS})) AS pos FROM pt) UNION ALL SELECT id, 0, 0, content FROM memories WHERE length(content) <= {K.CHUNK_CHARS})"""


@query(with_more(_PARAGRAPHS, "SELECT id, (row_number() OVER (PARTITION BY id ORDER BY a, pos))::INT AS part, sha256(body) AS hash FROM every").replace("WITH ", "WITH RECURSIVE ", 1))
def ingest_chunks(spark, sf):
    """Every chunk that ingest would store of every text, by its hash."""
    rows = splitting.pieces(views.memories(spark, sf), lambda x: splitting.chunk_text(x or ""))
    return rows.select("id", "part", T.text_hash(F.col("body")).alias("hash"))


@query(with_more("n AS (SELECT id, string_split(content, chr(10)) AS x FROM memories), m AS (SELECT id, x, len(x) AS n, greatest(2, len(x) // 3) AS o FROM n)", "SELECT id, sha256(array_to_string(x[1:(n + o) // 2], chr(10))) AS first_half, sha256(array_to_string(x[greatest(1, (n + o) // 2 - o + 1):n], chr(10))) AS second_half FROM m"))
def overlap_split(spark, sf):
    halves = evaluation.overlap_split(F.split(_content(), "\n"))
    return views.memories(spark, sf).select("id", *[T.text_hash(F.array_join(halves[x], "\n")).alias(name) for x, name in (("a", "first_half"), ("b", "second_half"))])


@query(sql("SELECT id, array_to_string(list_sort(list_filter(string_split(tags, ','), lambda t: t = project OR t = subcategory)), ',') AS kept FROM memories"))
def chunk_tag_filter(spark, sf):
    """Tags of a chunk whose text names its project; the language is universal."""
    tags = F.array_distinct(T.tag_list(F.col("tags")))
    kept = C.chunk_tags(F.concat(F.lit("of "), F.col("project")), tags, F.array("subcategory"))
    return views.memories(spark, sf).select("id", F.array_join(kept, ",").alias("kept"))
