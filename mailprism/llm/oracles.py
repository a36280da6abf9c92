"""SQL of the corpus queries for DuckDB, where SQL can express them."""

from __future__ import annotations

from mailprism.llm import chat, lexical_search, line_quality, phrase_index, top_k, url_filter

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lower(value: str) -> str:
    return f"translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"cast(regexp_matches(u, '(^|[^a-z]){t}([^a-z]|$)') as int)" for t in terms)


def _url_filter() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0]))

    def fits(rule: str) -> str:
        domain, _, start = rule.partition("/")
        return f"((host = '{domain}' or ends_with(host, '.{domain}')) and starts_with(path, '/{start}'))"

    rule = " ".join(f"when {fits(text)} then '{text}'" for text, _ in rules)
    verdict = " ".join(f"when {fits(text)} then '{says}'" for text, says in rules)
    return f"""
    with cut as (
      select page_id, {_lower("coalesce(url, '')")} as u,
        case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
    ), parts as (
      select page_id, u, {_lower("regexp_extract(rest, '^[^/?#]*')")} as host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from cut
    ), hits as (
      select *, cast({_terms(url_filter.STRICT)} as int) as strict_hits, cast({_terms(url_filter.SOFT)} as int) as soft_hits from parts
    )
    select page_id, host, path, case {rule} end as rule,
      case {verdict} when strict_hits > 0 or soft_hits >= {url_filter.SOFT_LIMIT} then 'block' else 'allow' end as verdict,
      strict_hits, soft_hits from hits"""


def _chat() -> str:
    order = "order by turn, role, body"
    return f"""
    with said as (
      select distinct conv_id, turn, replace(coalesce(role, '{chat.NOBODY}'), '<|', '< |') as role,
        replace(coalesce(text, ''), '<|', '< |') as body from conversations
    ), speakers as (select distinct conv_id, role as speaker from said where role <> '{chat.NARRATOR}'),
    sides as (
      select s.conv_id, speaker, turn, role, body, cast(floor(turn / {chat.WINDOW_TURNS}) as bigint) as w,
        case when role = '{chat.NARRATOR}' then '<|system|>' || chr(10) when role = speaker then '<|assistant|>' || chr(10)
          else '<|user name=' || role || '|>' || chr(10) end as head
      from said s join speakers p on s.conv_id is not distinct from p.conv_id
    ), placed as (
      select *, length(head) + length(body) + {len(chat.END) + 1} as n,
        sum(length(head) + length(body) + {len(chat.END) + 1}) over (partition by conv_id, speaker, w {order}) as upto from sides
    )
    select conv_id, speaker, w as window, cast(0 as int) as part, count(*) as n_messages,
      string_agg(head || body || '{chat.END}' || chr(10), '' {order}) as text,
      coalesce(string_agg(case when role = speaker then (upto - n + length(head)) || ':' || (upto - 1) end, ',' {order}), '') as mask_spans
    from placed group by conv_id, speaker, w"""


def _line_quality() -> str:
    q = line_quality
    return f"""
    with base as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
    worded as (select *, regexp_extract_all(t, '{WORD}') as w, string_split(t, chr(10)) as all_lines from base),
    lined as (select *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from worded),
    places as (select rid, w, unnest(range(1, len(w) - 1)) as p from lined),
    grams as (select rid, p, (w[p], w[p + 1], w[p + 2]) as g from places),
    twice as (select rid, p from (select rid, p, count(*) over (partition by rid, g) as n from grams) where n > 1),
    covered as (select rid, count(distinct p + d) as n from twice, (values (0), (1), (2)) v(d) group by rid),
    norm as (
      select rid, doc_id, source, t, x,
        regexp_replace({_lower(f"trim(regexp_replace(x, '{SPACE}+', ' ', 'g'))")}, '[0-9]', '0', 'g') as line
      from (select rid, doc_id, source, t, unnest(lines) as x from lined)
    ), frequent as (
      select f.source, line, first from (
        select source, line, min(doc_id) as first, count(distinct t) as n from norm group by source, line having n > {q.MAX_TEXTS}
      ) f join (select source, count(distinct t) as n_texts from base group by source) h on f.source is not distinct from h.source
      where 100 * n > {q.MAX_TEXTS_PERCENT} * n_texts
    ), removed as (
      select rid, sum(len(regexp_extract_all(x, '{WORD}'))) as n from norm n join frequent f
        on n.line = f.line and n.source is not distinct from f.source where n.doc_id is distinct from f.first group by rid
    ), counted as (
      select doc_id, len(w) as n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
        coalesce(c.n, 0) as n_repeat_words, cast(coalesce(r.n, 0) as bigint) as removed_words
      from lined l left join covered c using (rid) left join removed r on r.rid = l.rid
    ), failed as (
      select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words as base_failed from counted
    )
    select *, not base_failed and not (removed_words > 0 and (n_words - removed_words < {q.MIN_LEFT_WORDS}
      or 100 * (n_words - removed_words) < {q.MIN_LEFT_PERCENT} * n_words)) as kept from failed"""


def _top_k() -> str:
    k = top_k
    return f"""
    with v as (
      select vec_id, list_transform(embedding, lambda x: cast(floor({k.SCALE} * cast(x as double)) as bigint)) as e from embeddings
      where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ), scored as (
      select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id % {k.EVERY} = 0 and q.vec_id <> c.vec_id
    ), ranked as (
      select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scored
    )
    select query_id, rank, vec_id, score from ranked where rank <= {k.K}"""


def _words(text: str) -> str:
    """The words of the two word indexes; NULL has none."""
    return f"regexp_extract_all({_lower(f"coalesce({text}, '')")}, '{LETTERS}')"


def _phrase_index() -> str:
    q = phrase_index
    return f"""
    with d as (select row_number() over () as rid, doc_id, {_words("text")} as w from documents),
    b as (select coalesce(cast(item_id as varchar), '') as item, {_words("text")} as w from benchmark),
    cut as (select item, w, unnest(range(1, greatest(len(w) - {q.WINDOW} + 1, least(len(w), 1)) + 1)) as p from b),
    win as (select distinct item, w[p : p + {q.WINDOW - 1}] as g from cut),
    kinds as (select row_number() over () as wid, g, len(g) as k from (select distinct g from win)),
    slices as (
      select rid, p, k, w[p : p + k - 1] as g
      from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from kinds))
    ), hits as (select rid, p, s.k, wid from slices s join kinds on s.g = kinds.g),
    covered as (select rid, count(distinct p + o) as n from (select rid, p, unnest(range(0, k)) as o from hits) group by rid),
    named as (select distinct h.rid, item from hits h join kinds using (wid) join win on win.g = kinds.g),
    need as (select wid, k, x, count(*) as often from (select wid, k, unnest(g) as x from kinds) group by all),
    said as (select rid, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
    present as (
      select wid, rid from need join (select rid, x, count(*) as n from said group by all) t on t.x = need.x and n >= often
      group by wid, rid having count(*) = (select count(*) from need m where m.wid = need.wid)
    ), places as (
      select need.wid, need.k, present.rid, need.x, often, p from present join need on need.wid = present.wid
      join said on said.rid = present.rid and said.x = need.x
    ), enough as (
      select a.wid, a.rid, a.p, b.x from places a join places b
        on a.wid = b.wid and a.rid = b.rid and b.p between a.p and a.p + a.k + {q.SLACK - 1}
      group by a.wid, a.rid, a.p, b.x, b.often having count(distinct b.p) >= b.often
    ), whole as (
      select distinct wid, rid from (select wid, rid, p, count(*) as n from enough group by all) e
      where n = (select count(*) from need m where m.wid = e.wid)
    ), close as (select rid, count(distinct item) as n from whole join kinds using (wid) join win on win.g = kinds.g group by rid)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(covered.n, 0) as n_hit, coalesce(i.n, 0) as n_items,
      sha256(coalesce(i.items, '')) as items_sha256, coalesce(covered.n, 0) > 0 as contaminated, coalesce(close.n, 0) as n_near_items
    from d left join covered using (rid) left join close using (rid)
      left join (select rid, count(*) as n, string_agg(item, ',' order by item) as items from named group by rid) i using (rid)"""


def _lexical_search() -> str:
    q = lexical_search
    return f"""
    with d as (select row_number() over () as rid, doc_id, {_words("text")} as w from documents),
    said as (select rid, x, count(*) as tf from (select rid, unnest(w) as x from d) group by all),
    total as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d where len(w) > 0),
    weights as (select x, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as weight
      from (select x, count(*) as df from said group by x), total),
    asked as (select k, item_id, unnest(w) as x from (select row_number() over () as k, item_id, {_words("text")} as w from benchmark)),
    lengths as (select rid, doc_id, 100 - 25 + (25 * len(w) * n_docs) // n_terms as m from d, total where len(w) > 0),
    scored as (
      select k, item_id, rid, doc_id, cast(sum(weight * ((cast({q.SCALE} as bigint) * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from asked join weights using (x) join said using (x) join lengths using (rid) group by all
    ), ranked as (
      select *, cast(row_number() over (partition by k order by score desc, doc_id nulls last) as int) as rank from scored where score > 0
    )
    select item_id, rank, doc_id, score from ranked where rank <= {q.K}"""


ORACLES = {
    "op3_url_filter": _url_filter(),
    "op4_perspectives": _chat(),
    "op9_line_quality": _line_quality(),
    "op10_top_k": _top_k(),
    "op11_phrase_index": _phrase_index(),
    "op12_lexical_search": _lexical_search(),
}
