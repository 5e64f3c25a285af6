"""Text functions as Spark column expressions: terms, routing, query rewriting, predicates.

All take and return columns, so they stay inside one generated stage. Word lists below are fixed
values that results depend on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation and particles that end a CJK run.
CJK_BREAKS = "[，。；、！？\\s·…—,.;!?与和及或的]+"
#: Terms of question templates that carry no topic.
TEMPLATE_TERMS = ["本知", "知识", "识库", "请介", "介绍", "详细", "记录", "是什么", "根据", "要点", "解释", "综合", "说明", "章节", "内容", "相关", "有何", "关联", "关于"]
#: Cues of the routes.
CHITCHAT_CUES = ["你好", "您好", "hello", "hi", "hey", "谢谢", "感谢", "多谢", "再见", "拜拜", "早上好", "下午好", "晚上好", "在吗", "你是谁", "你能做什么"]
GREETINGS = ["你好", "您好", "hello", "hi"]
RELATION_CUES = ["关系", "区别", "差异", "对比", "比较", "不同", "相同", "相似", "联系", "关联", "两段", "多跳", " versus ", " vs "]
RELATION_PATTERN = "和.*的|与.*的"
OVERVIEW_CUES = ["总结", "综述", "概述", "归纳", "有哪些", "包括哪些", "列举", "全面", "整体", "分别是什么"]
TWO_PART_CUES = ["关联", "两段", "之间", "关系"]
#: What an expanded query leaves out.
RETRY_STOP = ["什么", "如何", "怎么", "为什么", "哪些", "之间", "关系", "区别", "对比", "和", "与", "的", "是"]
#: Anchors that are noise, and runs that name no entity.
ANCHOR_STOP = ["综合两段内容", "之间有什么联系", "有何关联", "通过提升", "通过属于", "通过存在", "通过承担", "通过包含", "通过导致", "通过教导", "通过是", "通过频率", "通过缓解方式", "通过由", "引起", "关系", "联系", "关联", "论文", "技术", "小时", "个月", "周龄", "版本", "文档编号"]
SEED_STOP = ["综合", "知识库", "内容", "说明", "有何", "关联", "两段", "之间", "关系", "有什么区别", "有什么", "是什么", "如何", "怎么", "哪些", "涉及", "包含"]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _has(c: Column, cues: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in cues])


def format_for_ingest(content: Column, heading_path: Column, page_no: Column) -> Column:
    """The chunk with its section, or else its page, in front."""
    body = _strip(content)
    section = F.concat(F.lit("[章节: "), heading_path, F.lit("]\n"), body)
    page = F.concat(F.lit("[第"), page_no.cast("string"), F.lit("页]\n"), body)
    return F.when(F.length(F.coalesce(heading_path, F.lit(""))) > 0, section).when(page_no.isNotNull(), page).otherwise(body)


def retrieval_terms(text: Column) -> Column:
    """The set of ASCII words of two or more characters and of CJK pieces of one or two."""
    low = F.lower(F.coalesce(text, F.lit("")))
    pieces = _all(F.regexp_replace(low, CJK_BREAKS, " "), "[一-鿿]{1,2}")
    return F.array_distinct(F.concat(_all(low, "[0-9A-Za-z_]{2,}"), pieces))


def unicode_terms(text: Column) -> Column:
    """The set of lower-cased runs of two or more word characters of any script."""
    return F.array_distinct(_all(F.lower(F.coalesce(text, F.lit(""))), "(?U)[\\w一-鿿]{2,}"))


def fts_query_terms(query: Column) -> Column:
    """Words, then single CJK characters, twenty at most; else the first 32 characters; null for a blank query."""
    q = _strip(F.coalesce(query, F.lit("")))
    found = F.slice(F.concat(_all(q, "[0-9A-Za-z_]{2,}"), _all(q, "[一-鿿]")), 1, 20)
    return F.when(F.length(q) == 0, F.lit(None)).when(F.size(found) == 0, F.array(F.substring(q, 1, 32))).otherwise(found)


def fts_match_expression(query: Column) -> Column:
    return F.array_join(F.transform(fts_query_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def substantive_terms(query: Column) -> Column:
    return F.array_except(retrieval_terms(query), _words(TEMPLATE_TERMS))


#: Quoted spans, what a question says between fixed words, Latin words of an entity or a text, and the templates of questions about
#: two entities, in order.
QUOTED, NAMED_PART, LATIN_WORD = "[「『]([^」』]+)[」』]", "本知识库中\\s*(.+?)(?:章节|的详细|$)", "[A-Za-z][0-9A-Za-z_.-]{1,20}"
PAIR_TEMPLATES = [
    "「([^」]+)」\\s*[与和]\\s*「([^」]+)」\\s*之间有什么联系",
    "「?([^」与和、,，]+)」?\\s*[与和、]\\s*「?([^」与和、,，]+)」?\\s*(?:的)?(?:关系|区别|对比|关联|异同)",
    "综合.*?[「『](.+?)[」』]\\s*[与和]\\s*[「『](.+?)[」』]\\s*有何关联",
]


def anchor_terms(query: Column) -> Column:
    """Substantive terms of quoted spans, and of what stands between 本知识库中 and 章节, 的详细 or the end."""
    q = F.coalesce(query, F.lit(""))
    spans = _all(q, QUOTED, 1)
    tail = F.regexp_extract(q, NAMED_PART, 1)
    return F.array_distinct(F.flatten(F.transform(F.concat(spans, F.array(tail)), substantive_terms)))


def quote_anchors(query: Column) -> Column:
    """Quoted spans of two or more characters, the first of each 80-character prefix, three at most."""
    spans = F.filter(F.transform(_all(F.coalesce(query, F.lit("")), "「([^」]+)」", 1), _strip), lambda s: F.length(s) >= 2)
    prefixes = F.transform(spans, lambda s: F.substring(s, 1, 80))
    # a prefix's first place marks the span to keep
    firsts = F.filter(F.transform(spans, lambda s, i: F.when(F.array_position(prefixes, F.substring(s, 1, 80)) == i + 1, s)), lambda s: s.isNotNull())
    return F.slice(firsts, 1, 3)


def search_variants(span: Column) -> Column:
    """A long entity's full-text queries: itself, two cuts, without brackets, its Latin words; five at most."""
    t = _strip(F.coalesce(span, F.lit("")))
    bare = _strip(F.regexp_replace(F.regexp_replace(t, "[《》「」『』\"'（）()]", " "), "(?U)\\s+", " "))
    long = F.length(t) > 24
    cuts = F.when(long, F.array(_strip(F.substring(t, 1, 24)), _strip(F.substring(t, 1, 40)))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.array(t), cuts, F.array(bare), F.slice(_all(t, LATIN_WORD), 1, 4))
    return F.slice(F.array_distinct(F.filter(found, lambda v: F.length(v) >= 2)), 1, 5)


def _pair(query: Column, pattern: str) -> Column:
    both = F.transform(F.array(F.regexp_extract(query, pattern, 1), F.regexp_extract(query, pattern, 2)), _strip)
    return F.when(query.rlike(pattern), F.filter(both, lambda s: F.length(s) >= 2))


def entity_seeds(query: Column) -> Column:
    """Entities of a relational question by the first template that fits, else its CJK runs; five at most of the latter."""
    q = F.coalesce(query, F.lit(""))
    runs = F.slice(F.filter(_all(q, "[一-鿿]{2,}"), lambda w: ~w.isin(SEED_STOP)), 1, 5)
    return F.coalesce(*[_pair(q, t) for t in PAIR_TEMPLATES], runs)


def multi_hop_anchors(query: Column) -> Column:
    """Quoted anchors if there are two, else entity seeds; without noise, five at most."""
    quotes = quote_anchors(query)
    raw = F.transform(F.when(F.size(quotes) >= 2, quotes).otherwise(entity_seeds(query)), _strip)
    return F.slice(F.array_distinct(F.filter(raw, lambda a: (F.length(a) >= 2) & ~a.isin(ANCHOR_STOP))), 1, 5)


def route_query(query: Column) -> Column:
    """chitchat, relational, comprehensive or factual, by the first rule that fits."""
    text = _strip(F.coalesce(query, F.lit("")))
    cue = _has(F.lower(text), CHITCHAT_CUES) | _has(text, CHITCHAT_CUES)
    asks = text.contains("?") | text.contains("？")
    small_talk = (F.length(text) <= 24) & cue & (~asks | _has(text, GREETINGS))
    relational = text.rlike(RELATION_PATTERN) | _has(text, RELATION_CUES) | (text.contains("综合") & _has(text, TWO_PART_CUES))
    return F.when(F.length(text) == 0, "chitchat").when(small_talk, "chitchat").when(relational, "relational").when(_has(text, OVERVIEW_CUES), "comprehensive").otherwise("factual")


def route_top_k(route: Column, query: Column, default: int = 5) -> Column:
    """How many rows a route retrieves; short questions get at least four, long ones one more (ten at most)."""
    n = F.length(_strip(F.coalesce(query, F.lit(""))))
    base = F.when(route.isin("factual", "relational"), F.least(F.lit(5), F.lit(default))).when(route == "comprehensive", F.least(F.lit(4), F.lit(default))).otherwise(F.lit(default))
    sized = F.when(F.length(F.coalesce(query, F.lit(""))) == 0, base).when(n < 15, F.greatest(base, F.lit(4))).when(n > 80, F.least(base + 1, F.lit(10))).otherwise(base)
    return F.when(route == "chitchat", F.lit(0)).otherwise(sized)


def dynamic_top_k(query: Column, default: int = 5) -> Column:
    n = F.length(_strip(F.coalesce(query, F.lit(""))))
    return F.when(n < 15, F.lit(max(3, default - 1))).when(n > 80, F.lit(min(10, default + 2))).otherwise(F.lit(default))


#: What parts of a compound question are joined by, in the order tried.
SUB_SPLIT = "[？?；;]"
SUB_JOINERS = ["以及", "并且", "还有", "另外", "同时"]


def sub_queries(query: Column, most: int = 3, joiners: list[str] | None = None) -> Column:
    """The parts of a compound question, the first of equal ones, or the question alone; none if blank."""
    text = _strip(F.coalesce(query, F.lit("")))

    def parts(c: Column) -> Column:
        return F.filter(F.transform(c, _strip), lambda p: F.length(p) >= 4)

    found = parts(F.split(text, SUB_SPLIT))
    choice = F.when(F.size(found) >= 2, found)
    for joiner in SUB_JOINERS if joiners is None else joiners:
        by = parts(F.split(text, joiner))
        choice = choice.when(text.contains(joiner) & (F.size(by) >= 2), by)
    chosen = choice.otherwise(F.array(text))
    lowered = F.transform(chosen, F.lower)
    firsts = F.filter(F.transform(chosen, lambda s, i: F.when(F.array_position(lowered, F.lower(s)) == i + 1, s)), lambda s: s.isNotNull())
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.slice(firsts, 1, most))


def expand_query_for_retry(query: Column, route: Column) -> Column:
    """For relational and comprehensive questions: the first six key terms, joined by spaces; else the question."""
    keys = F.slice(F.filter(_all(query, "(?U)[\\w一-鿿]{2,}"), lambda t: ~t.isin(RETRY_STOP)), 1, 6)
    return F.when(route.isin("relational", "comprehensive") & (F.size(keys) > 0), F.array_join(keys, " ")).otherwise(query)


#: Phrases that say nothing is known, how an answer declines, and what marks a stated fact.
NO_INFO_PHRASES = ["暂无相关信息", "暂无相关内容", "知识库中暂无", "目前知识库中暂无", "没有相关信息", "未找到相关", "无法找到相关", "no relevant information", "no information available", "not found in the knowledge"]
REFUSAL_PHRASE, REFUSAL_START = "暂无相关信息", "目前知识库"
FACT_CUES = ["是", "为", "等于", "指的是", "定义为", "应该", "需要"]


def is_refusal(answer: Column) -> Column:
    """Also true for a blank answer."""
    a = _strip(F.coalesce(answer, F.lit("")))
    return (F.length(a) == 0) | a.contains(REFUSAL_PHRASE) | a.startswith(REFUSAL_START)


def has_no_info_phrase(answer: Column) -> Column:
    return _has(F.coalesce(answer, F.lit("")), NO_INFO_PHRASES)


def looks_like_user_fact(message: Column) -> Column:
    """Twelve characters or more, a cue of a statement and no question mark."""
    m = _strip(F.coalesce(message, F.lit("")))
    return (F.length(m) >= 12) & _has(m, FACT_CUES) & ~m.contains("?") & ~m.contains("？")


def first_sentence(text: Column, most: int = 80) -> Column:
    """Up to the first mark of 。！？. that the text has, in that order."""
    t = F.regexp_replace(_strip(F.coalesce(text, F.lit(""))), "(?U)\\s+", " ")
    cut = F.when(t.contains("。"), F.substring_index(t, "。", 1)).when(t.contains("！"), F.substring_index(t, "！", 1)).when(t.contains("？"), F.substring_index(t, "？", 1))
    return F.substring(cut.when(t.contains("."), F.substring_index(t, ".", 1)).otherwise(t), 1, most)


#: CJK runs that make no term, and the term of a text without any.
TERM_STOP = ["知识库", "文档", "内容", "相关", "要点", "介绍"]
NO_TERM = "该主题"


def extract_term(content: Column) -> Column:
    """The first Latin word (24 characters at most), else the first CJK run of 2 to 8 that is no stop word, else the first sentence's start."""
    text = F.coalesce(content, F.lit(""))
    latin = F.regexp_extract(text, LATIN_WORD, 0)
    runs = F.filter(_all(text, "[一-鿿]{2,8}"), lambda r: ~r.isin(TERM_STOP))
    start = first_sentence(text, 12)
    return F.when(latin != "", F.substring(latin, 1, 24)).when(F.size(runs) > 0, F.element_at(runs, 1)).when(start != "", start).otherwise(NO_TERM)


SOURCE_TYPE = "array<struct<chunk_id:bigint,score:double>>"


def parse_sources(sources: Column, kind: str = SOURCE_TYPE) -> Column:
    """A tolerant parse: what is no JSON list becomes an empty list."""
    return F.coalesce(F.from_json(sources, kind), F.array().cast(kind))


def parse_chunk_ids(ids: Column) -> Column:
    """Ids of a JSON list as text, blank ones left out."""
    return F.filter(F.coalesce(F.from_json(ids, "array<string>"), F.array().cast("array<string>")), lambda i: F.length(F.coalesce(i, F.lit(""))) > 0)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def ctx_hash(a: Column, b: Column) -> Column:
    """Twelve hex digits that name a pair of contexts."""
    return F.substring(F.md5(F.concat(F.substring(F.coalesce(a, F.lit("")), 1, 200), F.substring(F.coalesce(b, F.lit("")), 1, 200))), 1, 12)


def overlap(terms: Column, other: Column) -> Column:
    """The share of ``terms`` that ``other`` has; 0 for no terms."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, other)) / F.size(terms)).otherwise(F.lit(0.0))
