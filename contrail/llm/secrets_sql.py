"""DuckDB SQL of the secret scan, from the same fixed values."""

from __future__ import annotations

import re

from contrail.llm.secrets import KINDS, PARTNERS, REACH, STRONG


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def either_case(pattern: str) -> str:
    """A pattern with (?i) as one that spells out both cases of its key words: RE2's (?i) folds letters beyond ASCII."""
    if not pattern.startswith("(?i)"):
        return pattern
    words, end = re.match(r"\(\?i\)(\([^)]*\))", pattern).group(1, 0)
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words) + pattern[len(end):]


def spans_sql(docs: str, reach: int = REACH) -> str:
    """Common table expressions up to ``found(doc_id, n_..., base, spans)`` over the relation ``docs``."""
    parts = []
    for no, (_, cls, pattern, group, least) in enumerate(KINDS):
        p = _quoted(either_case(pattern))
        parts.append(f"""
    select doc_id, {no} as kind, '{cls}' as cls, e - size as start, e as "end", word from (
      select doc_id, word, size, sum(coalesce(gap, 0) + coalesce(size, 0)) over (partition by doc_id order by i) as e from (
        select doc_id, i, length(gaps[i]) as gap, length(hits[i]) as size, words[i] as word from (
          select doc_id, gaps, hits, words, unnest(range(1, len(gaps) + 1)) as i from (
            select doc_id, regexp_split_to_array(text, {p}) as gaps, regexp_extract_all(text, {p}, 0) as hits,
                   regexp_extract_all(text, {p}, {group}) as words from {docs} where regexp_matches(text, {p}))))) where length(word) >= {least}""")
    weak_class = " or ".join(f"(w.cls = '{c}' and p.cls in ({', '.join(map(_quoted, o))}))" for c, o in PARTNERS.items())
    label = "case kind " + " ".join(f"when {no} then '{k[0]}'" for no, k in enumerate(KINDS)) + " end"
    counts = ", ".join(f"count(*) filter (kind = {no}) as n_{k[0]}" for no, k in enumerate(STRONG))
    return f"""
  raw as ({' union all '.join(parts)}),
  mixed as (select * from raw where kind <> 4 or (regexp_matches(word, '[a-z]') and regexp_matches(word, '[A-Z]') and regexp_matches(word, '[0-9]'))),
  parts as (select * from mixed w where kind < {len(STRONG)} or not exists (select 1 from mixed p where p.doc_id = w.doc_id
    and (p.kind < {len(STRONG)} or (w.kind = 4 and p.kind <> 4 and p.cls = 'endpoint')) and p."end" > w.start and p.start < w."end")),
  linked as (select *, {label} || ':' || cast(start as bigint) || ':' || cast("end" as bigint) as span from parts w where kind < {len(STRONG)}
    or exists (select 1 from parts p where p.doc_id = w.doc_id and ({weak_class}) and p."end" >= w.start - {reach} and p.start <= w."end" + {reach})),
  found as (select doc_id, {counts}, count(*) filter (kind >= {len(STRONG)}) as n_weak,
    coalesce(string_agg(span, ',' order by start, kind) filter (kind < {len(STRONG)}), '') as base, string_agg(span, ',' order by start, kind) as spans
    from linked group by doc_id)"""


def secrets_sql() -> str:
    return f"""with {spans_sql('documents')}
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_weak, 0) as n_weak
from documents d left join found using (doc_id)"""
