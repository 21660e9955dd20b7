"""DuckDB SQL for the registered queries, written from their definitions and not from the engine's plans."""

from __future__ import annotations

from ..functions import text as T
from ..operators import answer
from .queries import DECLINE, WORDS

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"CAST(floor({_words(x)} * CAST(1.3 AS DOUBLE)) AS INTEGER)"


def _words(x: str) -> str:
    return f"(CASE WHEN {_squash(x)} = '' THEN 0 ELSE len(string_split({_squash(x)}, ' ')) END)"


def _whole(pattern: str) -> str:
    """A pattern between word borders of Unicode, which this dialect's own are not."""
    word = r"\p{L}\p{M}\p{N}\p{Pc}"
    return rf"(?:^|[^{word}]){pattern.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}(?:$|[^{word}])"


DOCS = "docs AS (SELECT doc_id, coalesce(\"text\", '') AS t, lang, source FROM documents)"
INDEX = """idx AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, 'j' || (label % 3) AS j, 's' || label AS s, CASE WHEN label = 9 THEN 'WITHDRAWN' ELSE 'in_force' END AS status FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, v, label FROM idx WHERE vec_id % 50 = 0)"""


def _ranked(where: str = "true", own: str = "i.vec_id <> q.query_id") -> str:
    return f"""near AS (SELECT q.query_id, i.vec_id, i.label, i.j, i.s, i.status, list_dot_product(q.v, i.v) AS score FROM q JOIN idx i ON {own} WHERE {where}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM near)"""


def _knn(k: int, where: str = "true") -> str:
    return f"WITH {INDEX}, {_ranked(where)} SELECT query_id, rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= {k}"


def _two_stage(k: int, reserve: int) -> str:
    second = f"""p2 AS (SELECT query_id, rank, vec_id, score, 2 AS hop FROM (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY seed, c.rank) AS nth FROM c
  LEFT JOIN p1 ON p1.query_id = c.query_id AND p1.vec_id = c.vec_id WHERE c.s <> c.seed_s AND p1.vec_id IS NULL) WHERE nth = 1)""" if reserve > 1 else "p2 AS (SELECT * FROM p1 WHERE false)"  # fmt: skip
    return f"""WITH {INDEX}, {_ranked()},
direct AS (SELECT * FROM ranked WHERE rank <= {k}),
seeds AS (SELECT d.query_id, d.rank AS seed, i.v, i.j, i.s FROM direct d JOIN idx i USING (vec_id) WHERE d.rank <= 2),
h AS (SELECT z.query_id, z.seed, z.j AS seed_j, z.s AS seed_s, i.vec_id, i.j, i.s, list_dot_product(z.v, i.v) AS score FROM seeds z, idx i),
hr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, seed ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM h),
c AS (SELECT hr.* FROM hr LEFT JOIN direct d ON d.query_id = hr.query_id AND d.vec_id = hr.vec_id WHERE hr.rank <= {k + 40} AND d.vec_id IS NULL),
p1 AS (SELECT query_id, rank, vec_id, score, 1 AS hop FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seed, rank) AS nth FROM c WHERE j <> seed_j) WHERE nth = 1),
{second},
hops AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2), n AS (SELECT query_id, count(*) AS n FROM hops GROUP BY query_id),
u AS (SELECT d.query_id, d.rank, d.vec_id, d.score, 0 AS hop FROM direct d LEFT JOIN n USING (query_id) WHERE d.rank <= {k} - coalesce(n.n, 0) UNION ALL SELECT * FROM hops)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, rank) AS INTEGER) AS rank, vec_id, round(score, 4) AS score, hop FROM u"""


def _ligatures(x: str, glyph: str) -> str:
    for left, right, fill in T.LIGATURES:
        x = f"regexp_replace({x}, '({left}){glyph}({right})', '\\1{fill}\\2', 'gi')"
    return x


def _lines(x: str) -> str:
    """Stripped lines without those of digits, joined again, with a blank line after each paragraph."""
    kept = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_strip('l')}), lambda l: NOT regexp_full_match(l, '\\p{{Nd}}+'))"
    return f"regexp_replace(regexp_replace(array_to_string({kept}, chr(10)), '([.:;!?])\\n', '\\1' || chr(10) || chr(10), 'g'), '\\n\\n+', chr(1), 'g')"


_PARAGRAPHS = f"list_filter(list_transform(string_split({_lines('t')}, chr(1)), lambda p: trim(replace(p, chr(10), ' '))), lambda p: p <> '')"


def _html(x: str) -> str:
    x = f"regexp_replace({x}, '<!--.*?-->', '', 'gs')"
    for tag in T.HTML_DROPPED:
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'gis')"
    x = f"regexp_replace({x}, '<[^>]*>', chr(10), 'gs')"
    for a, b in T.HTML_ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, a, b.replace("'", "''"))
    return _squash(x)


def _excerpt(x: str, most: int) -> str:
    head = f"regexp_extract(substring({x}, 1, {most}), '(?s)^(.+) [^ ]*$', 1)"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE regexp_replace(CASE WHEN {head} <> '' THEN {head} ELSE substring({x}, 1, {most}) END, '{_WS}+$', '') || '...' END"


_STATUS = f"WITH {DOCS}, lab AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), st AS (SELECT docs.*, CASE WHEN toxic = 1 THEN 'WITHDRAWN' ELSE 'in_force' END AS status FROM docs LEFT JOIN lab USING (doc_id))"
_TURNS = "c AS (SELECT conv_id, turn, role, coalesce(\"text\", '') AS t FROM conversations)"


def _scores(k: int, name: str = "") -> str:
    return f"""hit{name} AS (SELECT query_id, rank, score, s, status, vec_id FROM ranked WHERE rank <= {k}),
sc{name} AS (SELECT q.query_id AS id, CASE WHEN q.query_id % 350 = 0 THEN 'out_of_scope' ELSE 'type' || (q.label % 3) END AS type, min(CASE WHEN n.s = 's' || q.label THEN n.rank END) AS first,
  max(CASE WHEN n.rank = 1 THEN n.score END) AS top, max(CASE WHEN n.rank = 1 THEN 'c' || n.vec_id END) AS cited, coalesce(bool_or(n.status <> 'in_force'), false) AS withdrawn FROM q LEFT JOIN hit{name} n USING (query_id) GROUP BY q.query_id, q.label),
qs{name} AS (SELECT id, type, type <> 'out_of_scope' AND first IS NOT NULL AS hit, CASE WHEN type <> 'out_of_scope' AND first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS recall,
  CASE WHEN type <> 'out_of_scope' AND first IS NOT NULL THEN 1 / CAST(first AS DOUBLE) ELSE 0 END AS rr, coalesce(top, -1e300) < {DECLINE} AS abstained, coalesce(top, 0) AS top, coalesce(cited, '') AS cited, withdrawn FROM sc{name}),
ok{name} AS (SELECT *, CASE WHEN type = 'out_of_scope' THEN abstained ELSE recall = 1 AND NOT abstained END AS correct FROM qs{name}),
g{name} AS (SELECT CASE WHEN grouping(type) = 1 THEN 'overall' ELSE 'by_type.' || type END AS scope, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 4) AS correct, round(avg(CASE WHEN type <> 'out_of_scope' THEN CAST(hit AS INTEGER) END), 4) AS hit,
  round(avg(CASE WHEN type <> 'out_of_scope' THEN recall END), 4) AS recall, round(avg(CASE WHEN type <> 'out_of_scope' THEN rr END), 4) AS mrr, round(avg(CASE WHEN type = 'out_of_scope' THEN CAST(abstained AS INTEGER) END), 4) AS ab FROM ok{name} GROUP BY GROUPING SETS ((type), ())),
m{name} AS (SELECT scope, unnest(['n', 'correct', 'hit@k', 'recall@k', 'mrr', 'abstain_rate']) AS metric, unnest([CAST(n AS DOUBLE), correct, hit, recall, mrr, ab]) AS value FROM g{name})"""


_PAIRS = f"""WITH {DOCS}, e AS (SELECT d.doc_id, d.t, d.source, CAST(regexp_extract(d.source, '[0-9]+') AS INTEGER) % 2 AS odd, CAST(v.embedding AS DOUBLE[]) AS v FROM docs d JOIN embeddings v ON d.doc_id = v.vec_id),
r AS (SELECT t, max(doc_id) AS doc_id FROM e WHERE odd = 1 GROUP BY t), p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.v AS av, b.v AS bv FROM e a JOIN r USING (t) JOIN e b ON b.doc_id = r.doc_id WHERE a.odd = 0)"""

_FOUND3 = f"""WITH {INDEX}, {_ranked()},
f AS (SELECT query_id, max(score) AS top, bool_or(status <> 'in_force') AS gone, string_agg('c' || vec_id, ', ' ORDER BY rank) AS cited, count(DISTINCT j) AS nj, string_agg(DISTINCT j, ', ' ORDER BY j) AS js,
  max(CASE WHEN rank = 1 THEN vec_id END) AS lead FROM ranked WHERE rank <= 3 GROUP BY query_id),
a AS (SELECT q.query_id, q.query_id % 200 = 0 AS advice, f.* EXCLUDE (query_id) FROM q LEFT JOIN f USING (query_id))"""

_DIS = "'" + answer.JURISDICTIONS.replace("'", "''").replace("%s", "' || js || '") + "'"

ORACLE = {
    "knn_topk": f"WITH {INDEX.replace('vec_id % 50 = 0', 'vec_id = 0')}, {_ranked(own='true')} SELECT rank, vec_id, round(score, 4) AS score FROM ranked WHERE rank <= 10",
    "knn_batch": _knn(5),
    "knn_filtered": _knn(5, "i.j = 'j1'"),
    "knn_in_force": _knn(5, "i.status = 'in_force'"),
    "knn_abstain": f"WITH {INDEX}, {_ranked()} SELECT q.query_id, round(r.score, 4) AS top_score, coalesce(r.score, -1e300) < {DECLINE} AS abstain FROM q LEFT JOIN ranked r ON r.query_id = q.query_id AND r.rank = 1",
    "knn_two_stage": _two_stage(5, 2),
    "knn_two_stage_k2": _two_stage(2, 1),
    "pool_probe": f"WITH {INDEX}, {_ranked()} SELECT query_id, string_agg(s, ', ' ORDER BY rank) AS sources FROM ranked WHERE rank <= 3 GROUP BY query_id",
    "l2_norm_check": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm, 1.0::DOUBLE AS unit_norm FROM embeddings",
    "dedup_merge": f"WITH {DOCS} SELECT sha256(t) AS body_sha, min(doc_id) AS first_doc, count(*) AS n_docs, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources FROM docs GROUP BY t",
    "dedup_stats": f"WITH {DOCS}, g AS (SELECT count(*) AS n, count(DISTINCT source) AS s FROM docs GROUP BY t) SELECT CAST(sum(n) AS BIGINT) AS n_docs, count(*) AS n_texts, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest, count(*) FILTER (s > 1) AS n_across FROM g",
    "near_dup_pairs": f"WITH {DOCS} SELECT d.doc_id AS left_doc, max(e.doc_id) AS right_doc, sha256(any_value(d.t)) AS body_key FROM docs d JOIN docs e ON d.t = e.t AND d.source <> e.source GROUP BY d.doc_id",
    "shared_bodies": f"WITH {DOCS}, p AS (SELECT t, CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 2 AS odd FROM docs) SELECT sha256(t) AS body_key FROM (SELECT t FROM p WHERE odd = 0 INTERSECT SELECT t FROM p WHERE odd = 1)",
    "header_check": f"""{_PAIRS}, s AS (SELECT 'with header' AS variant, list_dot_product(av, bv) AS s FROM p UNION ALL SELECT 'no header', list_dot_product(av[1:16], bv[1:16]) FROM p)
SELECT variant, round(avg(s), 4) AS mean, round(min(s), 4) AS least, round(max(s), 4) AS most, count(*) FILTER (s > 0.5) AS n_above, count(*) AS n FROM s GROUP BY variant""",
    "pair_pool_probe": f"""{_PAIRS}, pool AS (SELECT a AS ord FROM p UNION SELECT b FROM p), q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, e.doc_id AS ord, e.source, list_dot_product(q.v, e.v) AS score FROM q, pool JOIN e ON e.doc_id = pool.ord)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INTEGER) AS rank, ord, round(score, 4) AS score, source FROM s QUALIFY rank <= 3""",
    "equal_bodies": f"WITH {DOCS} SELECT sha256(t) AS body_key, source, max(doc_id) AS last_doc, count(*) AS n_docs FROM docs GROUP BY t, source QUALIFY count(*) OVER (PARTITION BY t) > 1",
    "likeness_by_label": f"WITH {INDEX}, {_ranked()} SELECT round(avg(score), 4) AS mean, round(min(score), 4) AS least, round(max(score), 4) AS most, count(*) FILTER (score > 0.5) AS n_above, count(*) AS n FROM ranked WHERE rank = 1",
    "token_estimate": f"WITH {DOCS} SELECT doc_id, {_tokens('t')} AS n_tokens FROM docs",
    "chunk_stats": f"WITH {DOCS}, k AS (SELECT coalesce(source, '-') AS source, {_tokens('t')} AS n_tokens FROM docs) SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS n, median(n_tokens) AS median, max(n_tokens) AS most, CAST(sum(n_tokens) AS BIGINT) AS total FROM k GROUP BY GROUPING SETS ((source), ())",
    "fixed_windows": f"""WITH {DOCS}, w AS (SELECT doc_id, string_split({_squash('t')}, ' ') AS w FROM docs WHERE {_squash('t')} <> ''),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 393) / 344.0) AS BIGINT)) * 344 + 1, 344)) AS start FROM w),
p AS (SELECT doc_id, start, w[start + 1 : start + 393] AS part FROM s)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(floor(len(part) * CAST(1.3 AS DOUBLE)) AS INTEGER) AS n_tokens, sha256(array_to_string(part, ' ')) AS body_sha FROM p""",
    "source_windows": f"""WITH {DOCS}, w AS (SELECT source, doc_id, unnest(string_split({_squash('t')}, ' ')) AS w, generate_subscripts(string_split({_squash('t')}, ' '), 1) AS i FROM docs WHERE {_squash('t')} <> ''),
o AS (SELECT source, doc_id, w, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM w),
s AS (SELECT *, unnest(range(greatest(0, CAST(floor((pos - 393) / 344.0) AS BIGINT) + 1), least(greatest(0, CAST(ceil((n - 393) / 344.0) AS BIGINT)), pos // 344) + 1)) AS k FROM o),
g AS (SELECT source, k * 344 AS start, string_agg(w, ' ' ORDER BY pos) AS body, count(*) AS n_words FROM s GROUP BY source, k),
c AS (SELECT source, start, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS cited FROM (SELECT DISTINCT source, k * 344 AS start, doc_id FROM s) GROUP BY source, start)
SELECT source, start, CAST(floor(n_words * CAST(1.3 AS DOUBLE)) AS INTEGER) AS n_tokens, cited, sha256(body) AS body_sha FROM g JOIN c USING (source, start)""",
    "reflow_paragraphs": f"WITH {DOCS}, p AS (SELECT doc_id, {_PARAGRAPHS} AS p FROM docs) SELECT doc_id, len(p) AS n_paragraphs, sha256(array_to_string(p, chr(10) || chr(10))) AS text_sha FROM p",
    "ligature_repair": f"WITH {DOCS}, g AS (SELECT doc_id, regexp_replace(t, 'f[filt]', '~', 'gi') AS t FROM docs), r AS (SELECT doc_id, {_ligatures('t', '~')} AS t FROM g) SELECT doc_id, length(t) - length(replace(t, '~', '')) AS residual, sha256(replace(t, '~', 'ff')) AS text_sha FROM r",
    "normalise_text": f"WITH {DOCS} SELECT doc_id, sha256(regexp_replace(replace(replace(t, chr(61623), '•'), chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g')) AS text_sha, sha256({_squash('t')}) AS squashed_sha FROM docs",
    "section_fold": f"WITH {_TURNS}, g AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS grp FROM c) SELECT conv_id, grp, count(*) AS n_turns, sha256(string_agg(t, ' ' ORDER BY turn)) AS body_sha FROM g GROUP BY conv_id, grp",
    "part_units": f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '(' || chr(CAST(97 + turn % 26 AS INTEGER)) || ') ' ELSE '' END || t AS t FROM c),
m AS (SELECT *, regexp_extract(t, '^([A-Z])\\.{_WS}+[A-Z(“]', 1) AS big, regexp_extract(t, '^\\(([a-z])\\){_WS}+', 1) AS small FROM p),
k AS (SELECT conv_id, turn, nullif(big || small, '') AS letter, CASE WHEN big <> '' THEN regexp_replace(t, '^[A-Z]\\.{_WS}+', '') WHEN small <> '' THEN regexp_replace(t, '^\\([a-z]\\){_WS}+', '') ELSE t END AS t FROM m),
g AS (SELECT *, CAST(sum(CASE WHEN letter IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS grp FROM k)
SELECT CAST(conv_id AS VARCHAR) AS source_id, grp AS unit_ord, max(letter) AS subsection, sha256({_strip("string_agg(t, ' ' ORDER BY turn)")}) AS body_sha FROM g GROUP BY conv_id, grp""",
    "labelled_blocks": f"""WITH {DOCS}, l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM docs),
b AS (SELECT doc_id, i, {_strip("regexp_replace(CASE WHEN i % 3 = 0 THEN '§ 5-' || i || '. A ' ELSE '' END || x, '[ " + chr(92) + "t]+', ' ', 'g')")} AS x FROM l),
m AS (SELECT *, CASE WHEN length(x) > 80 THEN nullif(regexp_extract(x, '^(?:§+{_WS}*|Sec(?:tion)?\\.?{_WS}+)?((?:\\d+[-.]\\d+(?:[-.]\\d+)*)|(?:\\d{{1,3}})){_WS}*[.:—-]?{_WS}+[A-Z]', 1), '') END AS mark FROM b WHERE x <> ''),
g AS (SELECT *, CAST(sum(CASE WHEN mark IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS grp FROM m)
SELECT doc_id, grp, max(mark) AS label, sha256({_strip("string_agg(x, ' ' ORDER BY i)")}) AS body_sha FROM g GROUP BY doc_id, grp""",
    "size_fold": f"WITH {_TURNS}, a AS (SELECT *, length(t) >= 200 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS st FROM c), g AS (SELECT *, sum(CAST(st AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM a) SELECT conv_id, min(turn) AS turn, count(*) AS n_turns, sha256(string_agg(t, ' ' ORDER BY turn)) AS body_sha FROM g GROUP BY conv_id, f",
    "label_carry": "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS label FROM conversations",
    "long_split": f"""WITH RECURSIVE {DOCS}, s AS (SELECT doc_id, -1 AS piece, '' AS body, {_strip('t')} AS rest FROM docs
  UNION ALL SELECT doc_id, piece + 1, {_strip('substring(rest, 1, CAST(cut AS BIGINT))')}, {_strip('substring(rest, CAST(cut AS BIGINT) + 1)')} FROM (SELECT *, CASE WHEN length(rest) <= 2200 THEN length(rest)
    WHEN length(regexp_extract(substring(rest, 1, 2200), '(?s)^(.*)\\. ', 1)) > 1100 THEN length(regexp_extract(substring(rest, 1, 2200), '(?s)^(.*)\\. ', 1)) + 1 ELSE 2200 END AS cut FROM s WHERE rest <> ''))
SELECT doc_id, piece, length(body) AS n_chars, sha256(body) AS body_sha FROM s WHERE piece >= 0""",
    "html_text": "WITH p AS (SELECT page_id, " + _html("coalesce(html, '')") + " AS t FROM pages) SELECT page_id, length(t) AS n_chars, sha256(t) AS text_sha FROM p",
    "excerpt": f"WITH {DOCS}, s AS (SELECT doc_id, t, {_strip('t')} AS x FROM docs) SELECT doc_id, {_excerpt('x', 420)} AS excerpt, substring(t, 1, 300) AS raw_excerpt FROM s",
    "advice_filter": "WITH c AS (SELECT conv_id, turn, coalesce(\"text\", '') AS t FROM conversations WHERE role = 'user' UNION ALL VALUES (-1, 0, 'Should I settle this?'), (-2, 0, 'What must an audit state?'), (-3, 0, 'CAN I SUE them'), (-4, 0, 'shouldi sue')) SELECT conv_id, turn, regexp_matches(lower(t), '" + "|".join(map(_whole, T.ADVICE + WORDS)) + "') AS declined FROM c",
    "header_build": f"{_STATUS}, h AS (SELECT doc_id, source || ' | ' || lang || ' | 29 CFR ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '(a)' ELSE '' END || CASE WHEN status <> 'in_force' THEN ' | STATUS: ' || status ELSE '' END AS h FROM st) SELECT doc_id, {_squash('h')} AS header FROM h",
    "citation_order": f"WITH {DOCS}, c AS (SELECT DISTINCT lang, CASE doc_id % 3 WHEN 0 THEN '41 CFR ' WHEN 1 THEN '29 CFR ' ELSE '10 Local ' END || source AS c FROM docs) SELECT lang, string_agg(c, '; ' ORDER BY CASE WHEN starts_with(c, '29 CFR') THEN 0 WHEN starts_with(c, '41 CFR') THEN 1 ELSE 2 END, c) AS citations FROM c GROUP BY lang",
    "withdrawn_flag": f"{_STATUS} SELECT source, bool_or(status <> 'in_force') AS withdrawn, count(*) AS n FROM st GROUP BY source",
    "jurisdiction_disclosure": f"""{_STATUS}, g AS (SELECT source, bool_or(status <> 'in_force') AS gone, count(DISTINCT lang) AS nl, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS js FROM st GROUP BY source)
SELECT source, concat_ws(' / ', CASE WHEN gone THEN '{answer.WITHDRAWN}' END, CASE WHEN nl > 1 THEN {_DIS} END) AS disclosures FROM g""",
    "compose_answers": f"""{_FOUND3} SELECT query_id, advice OR coalesce(top, -1e300) < {DECLINE} AS refused,
  CASE WHEN advice THEN '{answer.ADVICE_REFUSAL}' WHEN coalesce(top, -1e300) < {DECLINE} THEN '{answer.SCOPE_REFUSAL}' ELSE 'The most relevant provision is c' || lead || '. body of ' || lead END AS summary,
  CASE WHEN advice OR coalesce(top, -1e300) < {DECLINE} THEN '' ELSE cited END AS cited,
  CASE WHEN advice OR coalesce(top, -1e300) < {DECLINE} THEN '' ELSE concat_ws(' / ', CASE WHEN gone THEN '{answer.WITHDRAWN}' END, CASE WHEN nj > 1 THEN {_DIS} END) END AS disclosures FROM a""",
    "question_scores": f"WITH {INDEX}, {_ranked()}, {_scores(5)} SELECT id, type, hit, round(recall, 4) AS recall, round(rr, 4) AS reciprocal_rank, abstained, correct, round(top, 4) AS top_score, cited AS top_citations, withdrawn AS withdrawn_in_top FROM ok",
    "eval_metrics": f"WITH {INDEX}, {_ranked()}, {_scores(5)} SELECT * FROM m WHERE value IS NOT NULL",
    "metric_compare": f"WITH {INDEX}, {_ranked()}, {_scores(1, '1')}, {_scores(5, '5')} SELECT scope, metric, b.value AS base, c.value AS value, round(c.value - b.value, 4) AS delta FROM m5 b LEFT JOIN m1 c USING (scope, metric) WHERE metric <> 'n' AND b.value IS NOT NULL AND (c.value - b.value < 0 OR c.value IS NULL)",
    "golden_validate": """WITH b AS (SELECT CAST(item_id AS VARCHAR) AS id, item_id % 4 AS n, CASE item_id % 4 WHEN 0 THEN 'src' || item_id WHEN 1 THEN 'rc' || item_id WHEN 2 THEN 'src' || (item_id % 7) END AS wanted, CASE item_id % 4 WHEN 0 THEN 'citation' WHEN 1 THEN 'citation_contains' WHEN 2 THEN 'source_id' ELSE 'none' END AS kind FROM benchmark),
s AS (SELECT DISTINCT source FROM documents) SELECT id, kind, wanted FROM b WHERE kind = 'none' OR NOT EXISTS (SELECT 1 FROM s WHERE CASE WHEN kind = 'citation_contains' THEN contains(source, wanted) ELSE source = wanted END)""",
    "matcher_kinds": "SELECT CASE item_id % 4 WHEN 0 THEN 'citation' WHEN 1 THEN 'citation_contains' WHEN 2 THEN 'source_id' ELSE 'none' END AS kind, count(*) AS n FROM benchmark GROUP BY 1",
    "benchmark_overlap": f"WITH {DOCS} SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item FROM docs JOIN benchmark b ON length(b.\"text\") > 0 AND contains(t, b.\"text\") GROUP BY doc_id",
    "fingerprint": f"WITH {DOCS} SELECT source, count(*) AS n, CAST(sum(CAST('0x' || substring(sha256(doc_id || '|' || {_tokens('t')} || '|' || t), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM docs GROUP BY source",
    "index_fingerprint": f"""WITH {DOCS}, h AS (SELECT sha256(concat_ws(chr(31), CAST(doc_id AS VARCHAR), CAST({_tokens('t')} AS VARCHAR), t)) AS h FROM docs),
s AS (SELECT count(*) AS n, sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) AS b FROM h)
SELECT sha256(concat_ws('|', 'hashed-words-256', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))) AS fingerprint FROM s""",
    "checked_index": "SELECT vec_id AS ord, 'c' || vec_id AS chunk_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
    "index_integrity": "SELECT count(*) AS n, count(*) FILTER (l.doc_id IS NULL) AS no_label, count(*) FILTER (d.doc_id IS NULL) AS no_document FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
    "top_per_source": f"WITH {DOCS}, k AS (SELECT source, doc_id, {_tokens('t')} AS n_tokens FROM docs) SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY n_tokens DESC, doc_id) AS INTEGER) AS rank, doc_id, n_tokens FROM k QUALIFY rank <= 3",
}
