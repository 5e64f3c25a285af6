"""DuckDB SQL of the composed searches, put together from common table expressions by name.

A search takes a table of questions: query_id, kb_id, question, e (vector or null), k.
"""

from __future__ import annotations

from docweave.functions import text as T
from docweave.operators import composite as C
from docweave.plans.more_sql import EXPANDED, HOP_ANCHORS, SPACE, has, listed, once, quote_anchors, strip
from docweave.plans.search_queries import QUALITY_CTES
from docweave.sources.views import with_views

_ONE = "CAST(1 AS DOUBLE)"
_EMPTY = "CAST([] AS VARCHAR[])"


def terms(x: str) -> str:
    """``retrieval_terms``."""
    breaks = T.CJK_BREAKS.replace("\\s", "\\s\\x0b")
    return f"list_distinct(list_concat(regexp_extract_all(lower({x}), '[0-9A-Za-z_]{{2,}}'), regexp_extract_all(regexp_replace(lower({x}), '{breaks}', ' ', 'g'), '[一-鿿]{{1,2}}')))"


def substantive(x: str) -> str:
    return f"list_filter({terms(x)}, lambda w: NOT list_contains({listed(T.TEMPLATE_TERMS)}, w))"


def overlap(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len({a}) ELSE CAST(0 AS DOUBLE) END)"


_T = strip("question")
ROUTE = (
    f"CASE WHEN {_T} = '' THEN 'chitchat' WHEN length({_T}) <= 24 AND ({has(f'lower({_T})', T.CHITCHAT_CUES)} OR {has(_T, T.CHITCHAT_CUES)}) AND (NOT {has(_T, ['?', '？'])} OR {has(_T, T.GREETINGS)}) THEN 'chitchat' "
    f"WHEN regexp_matches({_T}, '{T.RELATION_PATTERN}') OR {has(_T, T.RELATION_CUES)} OR (contains({_T}, '综合') AND {has(_T, T.TWO_PART_CUES)}) THEN 'relational' WHEN {has(_T, T.OVERVIEW_CUES)} THEN 'comprehensive' ELSE 'factual' END"
)
_N = f"length({_T})"
_BASE = "(CASE route WHEN 'comprehensive' THEN 4 ELSE 5 END)"
TOP_K = f"CASE WHEN route = 'chitchat' THEN 0 WHEN length(question) = 0 THEN {_BASE} WHEN {_N} < 15 THEN greatest({_BASE}, 4) WHEN {_N} > 80 THEN least({_BASE} + 1, 10) ELSE {_BASE} END"

#: What all searches read: postings, their statistics, vectors, chunks with their terms, quality.
BASE = [
    "fx_tok AS (SELECT chunk_id, kb_id, unnest(regexp_extract_all(lower(content), '[0-9a-z_]{2,}|[一-鿿]')) AS term FROM fx_chunks WHERE is_active)",
    "fx_post AS (SELECT kb_id, chunk_id, term, count(*) AS tf FROM fx_tok GROUP BY 1, 2, 3)",
    "fx_len AS (SELECT chunk_id, count(*) AS doc_len FROM fx_tok GROUP BY 1)",
    "fx_st AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM fx_len)",
    "fx_idf AS (SELECT term, greatest(ln(((SELECT n FROM fx_st) - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT term, count(*) AS df FROM fx_post GROUP BY 1) d)",
    f"fx_alive AS (SELECT chunk_id, content, {terms('content')} AS held, list_distinct(regexp_extract_all(lower(content), '[\\pL\\pM\\pN_]{{2,}}')) AS words FROM fx_chunks WHERE is_active)",
    "fx_vec AS (SELECT c.chunk_id, c.kb_id, CAST(e.embedding AS DOUBLE[]) AS e FROM fx_chunks c JOIN embeddings e ON e.vec_id = c.chunk_id)",
    QUALITY_CTES,
    "fx_quality AS (SELECT chunk_id, dislike_count % 4 AS dislikes, chunk_id % 5 = 0 AS review, quality_score + CAST(0.3 AS DOUBLE) AS quality FROM ql)",
]


def bm25(asked: str, out: str, limit: int = 30) -> list[str]:
    """``out`` (query_id, chunk_id, rank)."""
    found = "list_slice(list_concat(regexp_extract_all(t, '[0-9A-Za-z_]{2,}'), regexp_extract_all(t, '[一-鿿]')), 1, 20)"
    part = "idf * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * doc_len / (SELECT avgdl FROM fx_st)))"
    return [
        f"{out}_t AS (SELECT DISTINCT query_id, kb_id, lower(unnest(CASE WHEN t = '' THEN NULL WHEN len({found}) = 0 THEN [substr(t, 1, 32)] ELSE {found} END)) AS term FROM (SELECT query_id, kb_id, {_T} AS t FROM {asked}) x)",
        f"{out}_s AS (SELECT q.query_id, p.chunk_id, round(sum({part}), 6) AS score FROM {out}_t q JOIN fx_post p ON p.term = q.term AND (q.kb_id IS NULL OR q.kb_id = p.kb_id) JOIN fx_idf i ON i.term = q.term JOIN fx_len l ON l.chunk_id = p.chunk_id GROUP BY 1, 2)",
        f"{out} AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {out}_s) x WHERE rank <= {limit})",
    ]


def hybrid(asked: str, out: str) -> list[str]:
    """``out`` (query_id, chunk_id, score, rank, quality)."""
    d = "round(1 - list_cosine_similarity(q.e, v.e), 6)"
    return [
        *bm25(asked, f"{out}_full"),
        f"{out}_near AS (SELECT * FROM (SELECT q.query_id, v.chunk_id, {d} AS d, row_number() OVER (PARTITION BY q.query_id ORDER BY {d}, v.chunk_id) AS rank FROM {asked} q JOIN fx_vec v ON v.kb_id = q.kb_id WHERE q.e IS NOT NULL) x WHERE rank <= 30 AND CAST(0.7 AS DOUBLE) * (1 - d) > 0.15)",
        f"{out}_fuse AS (SELECT query_id, chunk_id, round(coalesce({_ONE} / (60 + a.rank), 0) + coalesce({_ONE} / (60 + b.rank), 0), 12) AS rrf FROM {out}_near a FULL OUTER JOIN {out}_full b USING (query_id, chunk_id))",
        f"{out}_pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM {out}_fuse) x WHERE rank <= 30)",
        f"{out}_scored AS (SELECT p.query_id, p.chunk_id, q.k, CASE WHEN len({terms('q.question')}) = 0 THEN rrf ELSE round(CAST(0.65 AS DOUBLE) * rrf + CAST(0.35 AS DOUBLE) * {overlap(terms('q.question'), 'c.held')}, 6) END AS score FROM {out}_pool p JOIN fx_alive c ON c.chunk_id = p.chunk_id JOIN {asked} q ON q.query_id = p.query_id)",
        f"{out}_good AS (SELECT s.query_id, s.chunk_id, s.k, round(CAST(0.7 AS DOUBLE) * score + CAST(0.3 AS DOUBLE) * coalesce(quality, 0.5), 4) AS score, coalesce(quality, 0.5) AS quality FROM {out}_scored s LEFT JOIN fx_quality f ON f.chunk_id = s.chunk_id WHERE coalesce(dislikes, 0) < 3 AND NOT (coalesce(review, false) AND coalesce(dislikes, 0) >= 2) AND coalesce(quality, 0.5) >= 0.25)",
        f"{out} AS (SELECT query_id, chunk_id, score, rank, quality FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {out}_good) x WHERE rank <= k)",
    ]


def evidence(asked: str, results: str, out: str, route: str = ROUTE, has_graph: str = "false") -> list[str]:
    """``out``: one row a question with what its results show; n is null without any."""
    spans = "list_concat(regexp_extract_all(question, '[「『]([^」』]+)[」』]', 1), [regexp_extract(question, '本知识库中\\s*(.+?)(?:章节|的详细|$)', 1)])"
    return [
        f"{out}_q AS (SELECT query_id, question, {route} AS route, {terms('question')} AS t, {substantive('question')} AS s, list_distinct(flatten(list_transform({spans}, lambda x: {substantive('x')}))) AS a FROM {asked})",
        f"{out}_r AS (SELECT r.*, q.t, CASE WHEN len(q.s) > 0 THEN q.s ELSE q.t END AS s, q.a, c.held FROM {results} r JOIN fx_alive c ON c.chunk_id = r.chunk_id JOIN {out}_q q ON q.query_id = r.query_id)",
        f"{out}_e AS (SELECT query_id, max(score) AS best, max({overlap('t', 'held')}) AS term_o, max({overlap('s', 'held')}) AS sub_o, max({overlap('a', 'held')}) AS anchor_o, max(len(list_intersect(a, held))) AS matches, sum(CASE WHEN rank <= 3 AND coalesce(quality, 0.5) < {C.LOW_QUALITY} THEN 1 ELSE 0 END) AS n_low, count(*) AS n, bool_or({has_graph}) AS has_graph FROM {out}_r GROUP BY 1)",
        f"{out} AS (SELECT q.query_id, q.question, q.route, len(q.a) AS n_anchor, e.* EXCLUDE (query_id), greatest(term_o, sub_o, anchor_o) AS most FROM {out}_q q LEFT JOIN {out}_e e ON e.query_id = q.query_id)",
    ]


def _gate(relaxed: bool) -> str:
    anchored = "false" if relaxed else f"n_anchor > 0 AND (matches < least({C.MIN_ANCHOR_MATCHES}, n_anchor) OR anchor_o < {C.MIN_ANCHOR})"
    m, o = C.MIN_SCORE, C.MIN_OVERLAP
    return (
        f"n IS NOT NULL AND CASE WHEN route = 'chitchat' THEN true WHEN n >= 3 AND n_low > 2 THEN false WHEN has_graph AND best >= CAST({m} AS DOUBLE) * CAST(0.6 AS DOUBLE) THEN true WHEN {anchored} THEN false WHEN sub_o < {C.MIN_SUBSTANTIVE} AND best < {C.RRF_SCALE} THEN false "
        f"WHEN most < CAST({o} AS DOUBLE) * CAST(0.75 AS DOUBLE) AND best < 0.18 THEN false WHEN best < {m} AND most < {o} THEN false WHEN route = 'factual' AND best < CAST({m} AS DOUBLE) * CAST(0.85 AS DOUBLE) AND most < CAST({o} AS DOUBLE) * CAST(0.8 AS DOUBLE) THEN false ELSE true END"
    )


_LEAST = "CASE route WHEN 'relational' THEN CAST(0.06 AS DOUBLE) * CAST(0.85 AS DOUBLE) WHEN 'comprehensive' THEN CAST(0.06 AS DOUBLE) * CAST(0.9 AS DOUBLE) ELSE CAST(0.06 AS DOUBLE) END"
_SHARE = "CASE route WHEN 'relational' THEN CAST(0.1 AS DOUBLE) * CAST(0.85 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END"
ENOUGH = f"CASE WHEN route = 'chitchat' THEN true WHEN n IS NULL THEN false WHEN best < {C.RRF_SCALE} THEN best > 0 AND most >= {_SHARE} ELSE best >= {_LEAST} AND (most >= {_SHARE} OR best >= {_LEAST} * CAST(1.8 AS DOUBLE)) END"
VALUE = "CASE WHEN route = 'chitchat' THEN 1.0 WHEN n IS NULL THEN 0.0 ELSE round(CAST(0.55 AS DOUBLE) * least(1.0, best / CAST(0.5 AS DOUBLE)) + CAST(0.45 AS DOUBLE) * least(1.0, most / CAST(0.35 AS DOUBLE)), 4) END"


def merged(lists: str, out: str, most: str) -> list[str]:
    """``out`` (query_id, chunk_id, score, source, rank) from lists with source; ``most`` may name a column of none."""
    return [
        f"{out}_f AS (SELECT query_id, chunk_id, round(sum({_ONE} / (60 + rank)), 6) AS score, array_to_string(list_sort(list_distinct(list(source))), '+') AS source, min(list_no * 1000000 + rank) AS first FROM {lists} GROUP BY 1, 2)",
        f"{out} AS (SELECT query_id, chunk_id, score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM {out}_f) x WHERE rank <= {most})",
    ]


def with_quota(lists: str, quota: str, out: str, top_k: int) -> list[str]:
    """``out`` (query_id, chunk_id, rank): the heads of the quota lists first, then the fused pool."""
    return [
        *merged(lists, f"{out}_m", "2147483647"),
        f"{out}_h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY min(list_no * 1000000 + rank), chunk_id) AS place FROM {quota} WHERE rank <= 1 GROUP BY 1, 2)",
        f"{out} AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, m.rank NULLS LAST, chunk_id) AS rank FROM (SELECT m.* FROM {out}_m m LEFT JOIN (SELECT query_id, max(place) AS n FROM {out}_h GROUP BY 1) k ON k.query_id = m.query_id WHERE m.rank <= {top_k} + coalesce(k.n, 0)) m FULL OUTER JOIN {out}_h h USING (query_id, chunk_id)) x WHERE rank <= {top_k})",
    ]


def _asked(question: str) -> str:
    return f"asked AS (SELECT item_id AS query_id, concat('src', CAST(item_id % 20 AS VARCHAR)) AS kb_id, {question} AS question, CAST(e.embedding AS DOUBLE[]) AS e, 5 AS k FROM benchmark LEFT JOIN embeddings e ON e.vec_id = item_id)"


PLAIN = _asked("substr(text, 1, 120)")
TEMPLATED = _asked("CASE item_id % 3 WHEN 0 THEN concat('「', substr(text, 1, 16), '」和「', substr(text, 18, 16), '」之间有什么联系') WHEN 1 THEN concat(substr(text, 1, 30), '；', substr(text, 32, 30)) ELSE substr(text, 1, 100) END")
PARTS = [
    f"halves AS (SELECT *, {_T} AS t, list_filter(list_transform(string_split_regex({_T}, '{T.SUB_SPLIT}'), lambda x: {strip('x')}), lambda x: length(x) >= 4) AS h FROM asked)",
    "chosen AS (SELECT query_id, kb_id, e, CASE WHEN len(h) >= 2 THEN h ELSE [t] END AS h FROM halves WHERE t <> '')",
    "lowered AS (SELECT *, list_transform(h, lambda x: lower(x)) AS w FROM chosen)",
    "parts AS (SELECT query_id, kb_id, e, list_slice(list_filter(h, lambda x, i: list_position(w, lower(x)) = i), 1, 3) AS p FROM lowered)",
]
_SUB = "sub AS (SELECT query_id AS parent, len(p) AS n_parts, unnest(range(len(p))) AS list_no, query_id * 100 + unnest(range(len(p))) AS query_id, kb_id, e, unnest(p) AS question, 8 AS k FROM parts)"



def variant_hits(cuts: str, out: str, limit: int) -> list[str]:
    """``out`` (query_id, chunk_id, rank): full-text hits of the variants of anchors (query_id, kb_id, a, anchor), as first seen."""
    bare = strip(f"regexp_replace(regexp_replace({strip('anchor')}, '[《》「」『』\"''（）()]', ' ', 'g'), '[{SPACE}]+', ' ', 'g')")
    return [
        f"{out}_b AS (SELECT *, {strip('anchor')} AS t, {bare} AS b FROM {cuts})",
        f"{out}_p AS (SELECT *, list_filter(list_concat([t], CASE WHEN length(t) > 24 THEN [{strip('substr(t, 1, 24)')}, {strip('substr(t, 1, 40)')}] ELSE [] END, [b], list_slice(regexp_extract_all(t, '[A-Za-z][0-9A-Za-z_.-]{{1,20}}'), 1, 4)), lambda x: length(x) >= 2) AS l FROM {out}_b)",
        f"{out}_v AS (SELECT query_id AS parent, kb_id, a, unnest(range(len(v))) AS v, unnest(v) AS question FROM (SELECT query_id, kb_id, a, list_slice({once('l')}, 1, 5) AS v FROM {out}_p) y)",
        f"{out}_n AS (SELECT row_number() OVER (ORDER BY parent, a, v) AS query_id, * FROM {out}_v)",
        *bm25(f"{out}_n", f"{out}_h", 3),
        f"{out}_s AS (SELECT n.parent AS query_id, h.chunk_id, min(n.a * 1000000 + n.v * 1000 + h.rank) AS first FROM {out}_h h JOIN {out}_n n ON n.query_id = h.query_id GROUP BY 1, 2)",
        f"{out} AS (SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, chunk_id) AS rank FROM {out}_s) x WHERE rank <= {limit})",
    ]


def _sql(select: str, *ctes: str) -> str:
    return with_views(select, *BASE, *ctes)


_ABSTAIN = [TEMPLATED, *hybrid("asked", "r"), *evidence("asked", "r", "ev")]
SQL = {
    "sr04_hybrid_search": _sql("SELECT query_id, chunk_id, score, rank FROM r", PLAIN, *hybrid("asked", "r")),
    "sr07_sub_query_search": _sql(
        "SELECT m.query_id, chunk_id, score, rank, source FROM mg m JOIN (SELECT parent, max(n_parts) AS n FROM sub GROUP BY 1) z ON z.parent = m.query_id WHERE rank <= least(15, 5 + n)",
        TEMPLATED, *PARTS, _SUB, *hybrid("sub", "r"), "lists AS (SELECT s.parent AS query_id, s.list_no, r.chunk_id, r.rank, 'hybrid' AS source FROM r JOIN sub s ON s.query_id = r.query_id WHERE r.rank <= least(8, greatest(3, 5 // n_parts + 1)))", *merged("lists", "mg", "15"),
    ),
    "sr07b_coverage": _sql(
        "SELECT query_id, round(avg(CASE WHEN o >= 0.15 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS coverage FROM best GROUP BY 1", TEMPLATED, *PARTS, *hybrid("asked", "r"),
        "cut AS (SELECT query_id, i, list_distinct(regexp_extract_all(lower(part), '[\\pL\\pM\\pN_]{2,}')) AS w FROM (SELECT query_id, unnest(range(len(p))) AS i, unnest(p) AS part FROM parts) x)",
        f"best AS (SELECT c.query_id, c.i, max({overlap('c.w', f'coalesce(a.words, {_EMPTY})')}) AS o FROM cut c LEFT JOIN r ON r.query_id = c.query_id LEFT JOIN fx_alive a ON a.chunk_id = r.chunk_id GROUP BY 1, 2)",
    ),
    "sr08_retrieval_abstain": _sql(f"SELECT r.query_id, r.chunk_id, r.rank FROM r JOIN ev ON ev.query_id = r.query_id WHERE {_gate(False).replace('n IS NOT NULL', 'ev.n IS NOT NULL')}", *_ABSTAIN),
    "sr09_sufficiency": _sql(f"SELECT query_id, route, {ENOUGH} AS sufficient, {VALUE} AS sufficiency FROM ev", *_ABSTAIN),
    "sr20_two_round_search": _sql(
        "SELECT b.query_id, b.chunk_id, b.score, b.rank, b.round, c.refused FROM (SELECT query_id, chunk_id, score, rank, 1 AS round FROM r1 UNION ALL SELECT query_id, chunk_id, score, rank, 2 FROM r2) b JOIN choice c ON c.query_id = b.query_id AND c.round = b.round",
        TEMPLATED, f"ways AS (SELECT * EXCLUDE (k), {ROUTE} AS route FROM asked)", f"one AS (SELECT * FROM (SELECT *, {TOP_K} AS k FROM ways) x WHERE k > 0)", *hybrid("one", "r1"), *evidence("one", "r1", "e1", "route"),
        f"j1 AS (SELECT query_id, {ENOUGH} AS ok, coalesce(best, 0) AS best FROM e1)",
        f"two AS (SELECT o.query_id, o.kb_id, CASE WHEN o.route IN ('relational', 'comprehensive') AND len({EXPANDED}) > 0 THEN array_to_string({EXPANDED}, ' ') ELSE o.question END AS question, o.e, o.route, least(o.k + 3, 12) AS k FROM one o JOIN j1 ON j1.query_id = o.query_id WHERE NOT j1.ok)", *hybrid("two", "r2"), *evidence("two", "r2", "e2", "route"),
        f"j2 AS (SELECT query_id, {ENOUGH} AS ok, coalesce(best, 0) AS best FROM e2)",
        "choice AS (SELECT j1.query_id, CASE WHEN j1.ok THEN 1 WHEN j2.ok THEN 2 WHEN j1.best > coalesce(j2.best, 0) THEN 1 ELSE 2 END AS round, NOT j1.ok AND NOT coalesce(j2.ok, false) AS refused FROM j1 LEFT JOIN j2 ON j2.query_id = j1.query_id)",
    ),
    "sr05_anchor_search": _sql(
        "SELECT query_id, chunk_id, rank, round(1 - CAST(0.04 AS DOUBLE) * (rank - 1), 6) AS score FROM hits",
        "asked AS (SELECT item_id AS query_id, concat('「', substr(text, 1, 30), '」与「', substr(text, 32, 20), '」') AS question FROM benchmark)", quote_anchors("asked"), "cuts AS (SELECT query_id, CAST(NULL AS VARCHAR) AS kb_id, unnest(range(len(a))) AS a, unnest(a) AS anchor FROM quotes)", *variant_hits("cuts", "hits", 10),
    ),
    "sr06_multi_hop_search": _sql(
        f"SELECT query_id, chunk_id, score, rank, source FROM kept UNION ALL SELECT query_id, chunk_id, round({_ONE} / (60 + rank), 6), rank, 'fts' FROM back",
        TEMPLATED, quote_anchors("asked"), HOP_ANCHORS, f"split AS (SELECT q.*, h.anchors FROM asked q JOIN hops h ON h.query_id = q.query_id WHERE {ROUTE.replace('question', 'q.question')} IN ('relational', 'comprehensive') AND {has('q.question', C.SPLIT_CUES)} AND len(h.anchors) >= 2)",
        "sub0 AS (SELECT query_id AS parent, unnest(range(len(anchors))) AS list_no, query_id * 100 + unnest(range(len(anchors))) AS query_id, kb_id, e, unnest(anchors) AS anchor, 5 AS k FROM split)", "sub AS (SELECT *, CASE WHEN length(anchor) < 12 THEN concat(anchor, ' 相关内容') ELSE anchor END AS question FROM sub0)",
        *hybrid("sub", "r"), "cut1 AS (SELECT query_id, kb_id, 0 AS a, anchor FROM sub)", *variant_hits("cut1", "txt", C.ANCHOR_HITS),
        "beside AS (SELECT query_id, 0 AS list_no, chunk_id, rank, 'hybrid' AS source FROM r UNION ALL SELECT query_id, 1, chunk_id, rank, 'anchor-fts' FROM txt)", *merged("beside", "fu", "5"),
        "own AS (SELECT s.parent AS query_id, s.list_no, f.chunk_id, f.rank, f.source FROM fu f JOIN sub s ON s.query_id = f.query_id)",
        "cut2 AS (SELECT q.query_id, s.kb_id, unnest(range(len(a))) AS a, unnest(a) AS anchor FROM quotes q JOIN split s ON s.query_id = q.query_id)", *variant_hits("cut2", "qt", 10),
        "every AS (SELECT query_id, -1 AS list_no, chunk_id, rank, 'quote-fts' AS source FROM qt UNION ALL SELECT * FROM own)", *with_quota("every", "own", "mq", 15),
        f"res AS (SELECT query_id, chunk_id, rank, round({_ONE} / (60 + rank), 6) AS score, 0.5 AS quality FROM mq WHERE rank <= 5)", *evidence("split", "res", "ev"),
        f"kept AS (SELECT res.query_id, chunk_id, score, rank, 'multi_hop' AS source FROM res JOIN ev ON ev.query_id = res.query_id WHERE {_gate(True).replace('n IS NOT NULL', 'ev.n IS NOT NULL')})",
        "fts AS (SELECT query_id, -1 AS list_no, chunk_id, rank, 'quote-fts' AS source FROM qt UNION ALL SELECT s.parent, s.list_no, t.chunk_id, t.rank, 'anchor-fts' FROM txt t JOIN sub s ON s.query_id = t.query_id)",
        "lost AS (SELECT * FROM fts WHERE query_id IN (SELECT query_id FROM split) AND query_id NOT IN (SELECT query_id FROM kept))", "lostq AS (SELECT * FROM lost WHERE list_no >= 0)", *with_quota("lost", "lostq", "back", 5),
    ),
    "wn12_pack_context": _sql(
        "SELECT query_id, length(c) AS n_chars, md5(c) AS context_md5 FROM (SELECT query_id, string_agg(CASE WHEN upto <= 4500 THEN t ELSE concat(substr(t, 1, CAST(4500 - before AS BIGINT)), '…') END, chr(10) || chr(10) ORDER BY rank) AS c FROM (SELECT *, sum(length(t)) OVER w AS upto, sum(length(t)) OVER w - length(t) AS before FROM (SELECT h.query_id, h.rank, concat('[来源 ', CAST(row_number() OVER (PARTITION BY h.query_id ORDER BY h.rank) AS VARCHAR), '] ', c.content) AS t FROM h JOIN fx_chunks c ON c.chunk_id = h.chunk_id WHERE h.rank <= 5) x WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)) y WHERE before < 4500 GROUP BY 1) z",
        "asked AS (SELECT item_id AS query_id, CAST(NULL AS VARCHAR) AS kb_id, substr(text, 1, 120) AS question FROM benchmark)", *bm25("asked", "h"),
    ),
}
