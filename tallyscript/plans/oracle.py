"""SQL that DuckDB can run for what the engine computes, written from the definitions and not from the code that it checks.

Pieces are strings: `pairs` is a query of (ex_id, ref, hyp), `tokens` makes the SQL of a text column's tokens.
"""

from __future__ import annotations

from collections.abc import Callable

#: Levenshtein distance of the texts {a} and {b}; DuckDB's own counts bytes, so others than ASCII take the long way.
_LEVENSHTEIN = """case when strlen({a}) = length({a}) and strlen({b}) = length({b}) then levenshtein({a}, {b}) else
 list_reduce(string_split({a}, ''), lambda prev, x: list_reduce(range(1, length({b}) + 1),
  lambda cur, j: list_append(cur, least(prev[j] + (case when string_split({b}, '')[j] = x then 0 else 1 end), prev[j + 1] + 1, cur[-1] + 1)),
  [prev[1] + 1]), range(0, length({b}) + 1))[-1] end"""


def levenshtein(a: str, b: str) -> str:
    return _LEVENSHTEIN.format(a=a, b=b)


def spans(text: str, pattern: str, normal: Callable[[str], str], key: str, source: str) -> str:
    """(key, s, t, p, n): a text's tokens, their pieces with the gaps before them, and the normalized tokens."""
    return f"""(select *, list_transform(t, lambda x: {normal('x')}) as n from (select {key}, s, regexp_extract_all(s, '{pattern}') as t,
 regexp_extract_all(s, '(?s:.*?)(?:{pattern})') as p from (select {key}, {text} as s from {source})))"""


def joined(tokens: str = "n") -> str:
    """The tokens as one text, with a space where there was a gap, over `spans`."""
    return f"array_to_string(list_transform(range(1, len(t) + 1), lambda i: case when i > 1 and length(p[i]) > length(t[i]) then ' ' else '' end || {tokens}[i]), '')"


#: Where the token number i (from 1) of `spans` ends.
END = "list_sum(list_transform(p[1:{i}], lambda x: length(x)))"


def scripts(pairs: str, tokens: Callable[[str], str]) -> str:
    """A `with` prefix that defines `ops` (ex_id, o, type, i, j, rt, ht): each operation of each pair's edit script, its
    number from 0, the numbers from 0 of its tokens, or null, and these tokens.

    The common head and tail are matched. Between them the table of distances is walked from its end back: a step up
    (a deletion) where that cell is smaller by one; else a step left (an insertion) where the cell to the left is
    smaller than the one above that; else a diagonal step.
    """
    return f"""with recursive
  paired as (select ex_id, {tokens('ref')} as r, {tokens('hyp')} as h from ({pairs})),
 heads as (select *, coalesce(list_min(list_filter(range(1, least(len(r), len(h)) + 1), lambda k: r[k] <> h[k])) - 1, least(len(r), len(h))) as head from paired),
 tails as (select *, coalesce(list_min(list_filter(range(1, least(len(r), len(h)) - head + 1), lambda k: r[len(r) + 1 - k] <> h[len(h) + 1 - k])) - 1, least(len(r), len(h)) - head) as tail from heads),
 inner_part as (select ex_id, r as rall, h as hall, head, tail, r[head + 1 : len(r) - tail] as r, h[head + 1 : len(h) - tail] as h from tails),
 tables as materialized (select *, list_reduce(range(1, len(r) + 1), lambda d, k: list_append(d, list_reduce(range(1, len(h) + 1),
   lambda cur, j: list_append(cur, least(d[-1][j] + (case when h[j] = r[k] then 0 else 1 end), d[-1][j + 1] + 1, cur[-1] + 1)), [k])), [range(0, len(h) + 1)]) as d from inner_part),
 walk as (
  select ex_id, len(r) as i, len(h) as j, -1 as step, '' as type from tables
  union all
  select ex_id, i - (case when type in ('D', 'G') then 1 else 0 end), j - (case when type in ('I', 'G') then 1 else 0 end), step + 1, type from (
   select w.ex_id, w.i, w.j, w.step, case when w.j = 0 then 'D' when w.i = 0 then 'I' when d[w.i + 1][w.j + 1] = d[w.i][w.j + 1] + 1 then 'D'
     when w.j > 1 and d[w.i + 1][w.j] = d[w.i][w.j] - 1 then 'I' else 'G' end as type from walk w join tables t on w.ex_id = t.ex_id where w.i > 0 or w.j > 0)),
 middle as (select w.ex_id, head + w.i as i, head + w.j as j, case w.type when 'D' then 'DELETE' when 'I' then 'INSERT' else case when rall[head + w.i + 1] = hall[head + w.j + 1] then 'MATCH' else 'SUBSTITUTE' end end as type,
   head + max(step) over (partition by w.ex_id) - step as o from walk w join inner_part t on w.ex_id = t.ex_id where step >= 0),
 walked as (select ex_id, count(*) as k from middle group by ex_id),
 sizes as (select t.ex_id, head, tail, len(rall) as n, len(hall) as m, head + coalesce(k, 0) as after from inner_part t left join walked w on t.ex_id = w.ex_id),
 every as (select ex_id, o, type, i, j from middle
  union all select ex_id, k, 'MATCH', k, k from (select ex_id, unnest(range(0, head)) as k from sizes)
  union all select ex_id, after + k, 'MATCH', n - tail + k, m - tail + k from (select *, unnest(range(0, tail)) as k from sizes)),
 ops as materialized (select e.ex_id, cast(o as int) as o, type, case when type <> 'INSERT' then cast(i as int) end as i, case when type <> 'DELETE' then cast(j as int) end as j,
   case when type <> 'INSERT' then r[i + 1] end as rt, case when type <> 'DELETE' then h[j + 1] end as ht from every e join paired b on e.ex_id = b.ex_id)
"""


def counts() -> str:
    """The counts of operations by example, over `ops` and `paired`."""
    n = lambda *types: "cast(count(o) filter (type in (" + ", ".join(f"'{t}'" for t in types) + ")) as bigint)"
    return f"""select b.ex_id, {n('MATCH')} as num_matches, {n('SUBSTITUTE')} as num_substitutions, {n('INSERT')} as num_insertions, {n('DELETE')} as num_deletions,
 {n('SUBSTITUTE', 'INSERT', 'DELETE')} as num_edits, cast(count(o) as bigint) as num_ops from paired b left join ops o on b.ex_id = o.ex_id group by b.ex_id"""


def matches(vocab: str, most: int, subset: bool = False) -> str:
    """More of a `with` prefix after `scripts`: `found` (ex_id, side, s, e), the spans of the terms in the sides' tokens.

    `vocab` is a query of (toks), distinct lists of at most `most` tokens. Spans inside others are left out, unless `subset`.
    """
    windows = " union all ".join(f"select ex_id, side, k as s, k + {n} as e, toks[k + 1 : k + {n}] as w from (select *, unnest(range(0, len(toks) - {n - 1})) as k from sides)" for n in range(1, most + 1))
    kept = "select ex_id, side, s, e from hits" if subset else "select ex_id, side, s, e from hits a where not exists (select 1 from hits b where a.ex_id = b.ex_id and a.side = b.side and b.s <= a.s and b.e >= a.e and b.e - b.s > a.e - a.s)"
    return f""", sides as (select ex_id, 'ref' as side, r as toks from paired union all select ex_id, 'hyp', h from paired),
 terms as ({vocab}),
 hits as materialized (select distinct ex_id, side, s, e from ({windows}) join terms on w = terms.toks),
 found as ({kept})"""


def term_stats() -> str:
    """num_ref_terms, num_hyp_terms, num_tp, num_fn and num_fp by example, over `found`, `ops` and `paired`: a term is right
    when all operations from its first token's to its last one's are matches, insertions between them included."""
    judged = """select f.ex_id, f.side, f.s, f.e, count(*) filter (x.type <> 'MATCH') > 0 as bad from found f
 join ops a on a.ex_id = f.ex_id and (case f.side when 'ref' then a.i else a.j end) = f.s
 join ops z on z.ex_id = f.ex_id and (case f.side when 'ref' then z.i else z.j end) = f.e - 1
 join ops x on x.ex_id = f.ex_id and x.o between a.o and z.o group by all"""
    n = lambda c: f"cast(count(*) filter ({c}) as bigint)"
    return f"""select b.ex_id, {n("side = 'ref'")} as num_ref_terms, {n("side = 'hyp'")} as num_hyp_terms, {n("side = 'ref' and not bad")} as num_tp,
 {n("side = 'ref' and bad")} as num_fn, {n("side = 'hyp' and bad")} as num_fp from paired b left join ({judged}) j on b.ex_id = j.ex_id group by b.ex_id"""
