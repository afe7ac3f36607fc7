"""Check SQL of the operators that SQL can express."""

from auditlake.llm.licences import EQUIVALENT, KNOWN



def crc_of(expression: str, rows: str) -> str:
    """CRC-32 of the UTF-8 bytes of each distinct ``t``, as DuckDB has no such function: the table by its rule, then a fold over the bytes."""
    return f"""
crc_table as (
  select list(c order by i) as tab from (
    select i, list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from range(256) r(i))
),
crc as (
  select t, xor(list_reduce([4294967295::bigint] || list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: ('0x' || h)::bigint),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from (select distinct {expression} as t from {rows}), crc_table
)
"""


SHARDING = f"""
with {crc_of("coalesce(text, '')", "documents")},
sized as (
  select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + 8 as size from documents
),
placed as (
  select doc_id, t, size, sum(size) over (order by md5(t), doc_id nulls first rows unbounded preceding) - size as before,
         sum(size) over () as total
  from sized
),
cut as (
  select *, ((2 * before + size) * 24 // (2 * total))::int as shard from placed
)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard,
       row_number() over (partition by shard order by before, doc_id) - 1 as slot, null::int as grown_shard
from cut join crc using (t)
"""

MIXING = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as number from sized group by 1
),
weighed as (
  select *, [5, 2, 1][(number - 1) % 3 + 1] as weight, source_size * 2 as most, source_size * 2 / [5, 2, 1][(number - 1) % 3 + 1] as per_weight
  from sources
),
levelled as (
  select *, (1.5::double * sum(source_size) over ()::double
             - coalesce(sum(most) over (order by per_weight, number rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(weight) over (order by per_weight, number rows between current row and unbounded following)::double as level
  from weighed
),
water as (
  select min_by(level, row(per_weight, number)) as water from levelled where level <= per_weight
),
targets as (
  select source, source_size, least(most::double, weight::double * water) as target from levelled, water
),
drawn as (
  select doc_id, size, source_size, target, floor(target)::bigint as budget,
         coalesce(sum(size) over (partition by s.source order by md5('mix' || doc_id), doc_id
                  rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (budget // source_size * size + greatest(0, least(size, budget % source_size - before)))::bigint as taken
from drawn
"""

EXACT_DEDUP = r"""
with normal as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256
  from documents
),
stay as (
  select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id
  from normal
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from stay
"""

def _licences() -> str:
    """The canonical form as SQL: the same fixed values, in SQL functions."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    lines = r"^[ \t#*/;-]*(copyright[ \t]*(\(c\)|©|:|<|\[|[0-9]{4})|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
    text = f"regexp_replace(lower(coalesce(text, '')), {quoted('(?m)' + lines)}, '', 'g')"
    words = f"' ' || trim(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g'), ' ') || ' '"
    for a, b in EQUIVALENT:
        words = f"replace({words}, {quoted(' ' + a.replace(' ', '  ') + ' ')}, {quoted(' ' + b.replace(' ', '  ') + ' ')})"
    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN)
    return f"""
with rows as (select doc_id, null as license_id, trim({words}, ' ') as canon from documents),
known as (select min(license_id) as license_id, sha256(canon) as digest from (
  select license_id, trim({words}, ' ') as canon from (values {known}) k(license_id, text)) where canon <> '' group by 2)
select doc_id, (case when canon = '' then 0 else len(string_split(canon, '  ')) end)::bigint as n_words, sha256(canon) as digest,
       known.license_id
from rows left join known on known.digest = sha256(rows.canon)
"""


SPELLING = rf"""
with recursive runs as (
  select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as run
  from documents
),
counted as (
  select doc, run, count(*) as n from runs where length(run) >= 6 group by all
),
{crc_of("doc || ':' || run", "counted")},
faulty as (
  select case when text_crc32 % 199 = 0
         then left(run, (text_crc32 % length(run))::int) || substr(run, (text_crc32 % length(run))::int + 2) else run end as word, n
  from counted join crc on t = doc || ':' || run
),
words as (
  select word, sum(n)::bigint as n from faulty where length(word) >= 6 group by 1 having sum(n) >= 5
),
less as (
  select word, length(word) as size, k, left(word, (k - 1)::int) || substr(word, (k + 1)::int) as rest
  from (select word, unnest(range(1, length(word) + 1)) as k from words)
),
near as (
  select a.word, b.word as other from less a join less b on a.rest = b.rest and a.k = b.k and a.size = b.size and a.word <> b.word
  union
  select a.rest as word, a.word as other from less a join words w on w.word = a.rest
  union
  select a.word, a.rest as other from less a join words w on w.word = a.rest
),
best as (
  select near.word, count(*) as n_near, arg_min(other, row(-o.n, other)) as form, max(o.n) as form_n
  from near join words o on o.word = other group by 1
),
forms as (
  select word, case when best.form_n >= 5 * n then best.form end as form, n, coalesce(n_near, 0)::bigint as n_near,
         case when best.form_n >= 5 * n then best.form_n end as form_n
  from words left join best using (word)
),
steps as (
  select word, word as here, 0 as depth from forms
  union all
  select steps.word, forms.form, depth + 1 from steps join forms on forms.word = here where forms.form is not null
)
select word, form, root, n, n_near, form_n from forms join (select word, arg_max(here, depth) as root from steps group by 1) using (word)
"""

CONVERSATIONS = rf"""
with recursive {crc_of("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')", "conversations")},
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
         case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fate = 3 then [1, 2] else [1] end) as copy
  from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, text_crc32 % 20 as fate
        from conversations join crc on t = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))
  where fate <> 0
),
placed as (
  select *, coalesce(conv_id::varchar, '') as conv, left(role, 1) as initial,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last,
         row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as place
  from damaged
),
faults as (
  select *, case when last = '' then 'blank'
                 when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                 when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
         lag(initial) over (partition by conv_id order by place) as previous
  from placed
),
counts as (
  select conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (place > 1 and previous || initial not in ('su', 'ua', 'au')) as illegal, max(place) as n
  from faults group by 1, 2
),
inserts(state, here, cost, letters, said) as (
  values (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')
),
paths(conv, place, state, cost, audit, said) as (
  select conv, 0::bigint, 0, 0, '', '' from counts
  union all
  select conv, place, state, min(cost), arg_min(audit, row(cost, audit)), arg_min(said, row(cost, audit))
  from (
    select f.conv, f.place, e.state, p.cost + i.cost + e.cost + case when fault = 'truncated' and e.letter <> 'D' then 1 else 0 end as cost,
           p.audit || i.letters || e.letter as audit,
           p.said || i.said || case e.letter when 'D' then '' when 'K' then chr(10) || f.role || ':' || f.text else chr(10) || e.role || ':' || f.text end as said
    from paths p join faults f on f.conv = p.conv and f.place = p.place + 1 join inserts i on i.state = p.state
    join (values (0, 0, 'D', 3, ''), (1, 1, 'D', 3, ''), (2, 2, 'D', 3, ''), (3, 3, 'D', 3, ''),
                 (0, 2, 'R', 2, 'user'), (1, 2, 'R', 2, 'user'), (2, 3, 'R', 2, 'assistant'), (3, 2, 'R', 2, 'user'),
                 (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u')) e(here, state, letter, cost, role)
      on e.here = i.here and (e.letter = 'D' or fault in ('', 'truncated') and (e.letter = 'R' or f.initial = e.role))
  ) group by all
),
ends as (
  select p.conv, min(p.cost + e.cost) as cost, arg_min(audit || e.letters, row(p.cost + e.cost, audit || e.letters)) as audit,
         arg_min(p.said || e.said, row(p.cost + e.cost, audit || e.letters)) as said
  from paths p join counts c on c.conv = p.conv and c.n = p.place
  join (values (0, 0, '', ''), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 'I', chr(10) || 'assistant:'), (3, 0, '', '')) e(state, cost, letters, said)
    on e.state = p.state
  group by 1
)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(substr(said, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) g
left join counts c on c.conv = coalesce(g.conv_id::varchar, '') left join ends e on e.conv = c.conv
"""


ORACLES = {
    "op11_spelling_variants": SPELLING,
    "op13_conversation_repair": CONVERSATIONS,
    "op4_licence_scan": _licences(),
    "op3_sharding": SHARDING,
    "op5_mixing": MIXING,
    "op10_exact_dedup": EXACT_DEDUP,
}
