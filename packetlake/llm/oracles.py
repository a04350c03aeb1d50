"""SQL of the operators that need long texts: conversation repair and collocations."""

#: crc32 of an ASCII text, bit by bit.
CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}, ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295)"
)


def _then(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """The cheapest edits so far that end in a state, gone on by one edit."""
    lines = f"{state}.l || chr(10) || {line}" if line else f"{state}.l"
    return f"case when {state} is not null then {{c: {state}.c + {cost}, a: {state}.a || '{edit}', l: {lines}}} end"


def _least(*options: str) -> str:
    return "list_min([" + ", ".join(options) + "])"


def _with_inserts(rows: str) -> str:
    user = [_then(s, "2", "I", "'user:'") for s in ("s0", "s1", "s3")]
    first = f"select conv_id, i, s0, s1, {_least('s2', *user)} as s2, s3 from ({rows})"
    return f"select conv_id, i, s0, s1, s2, {_least('s3', _then('s2', '2', 'I', repr('assistant:')))} as s3 from ({first})"


def _row() -> str:
    """The four states after one more row (initial, fault, role, text)."""
    keep, user, assistant = "role || ':' || text", "'user:' || text", "'assistant:' || text"
    may = lambda test, x: f"case when fault not in ('blank', 'duplicate') and {test} then {x} end"
    end = "(fault = 'truncated')::bigint"
    gone = {k: _then(f"s{k}", "3", "D") for k in range(4)}
    s1 = _least(gone[1], may("initial = 's'", _then("s0", end, "K", keep)))
    s2 = _least(gone[2], *(may("initial = 'u'", _then(s, end, "K", keep)) for s in ("s0", "s1", "s3")), *(may("true", _then(s, f"2 + {end}", "R", user)) for s in ("s0", "s1", "s3")))
    s3 = _least(gone[3], may("initial = 'a'", _then("s2", end, "K", keep)), may("true", _then("s2", f"2 + {end}", "R", assistant)))
    return f"select r.conv_id, r.i, {gone[0]} as s0, {s1} as s1, {s2} as s2, {s3} as s3 from best b join faults r on r.conv_id is not distinct from b.conv_id and r.i = b.i + 1"


_NONE = "null::struct(c bigint, a varchar, l varchar)"
CONVERSATIONS = f"""
with recursive hurt as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as d from conversations
), after as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when d = 3 then 2 else 1 end)) as copy
  from hurt where d <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, left(role, 1) as initial from after
), faults as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when seen > 1 then 'duplicate'
    when regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from placed
), best as (
  {_with_inserts(f"select distinct conv_id, 0::bigint as i, {{c: 0::bigint, a: '', l: ''}} as s0, {_NONE} as s1, {_NONE} as s2, {_NONE} as s3 from faults")}
  union all
  {_with_inserts(_row())}
), pairs as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair from faults
), counts as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from pairs group by conv_id
), ended as (select c.*, {_least("b.s0", "b.s3")} as best from counts c join best b on b.conv_id is not distinct from c.conv_id and b.i = c.n)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(substr(best.l, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join ended e on a.conv_id is not distinct from e.conv_id"""


COLLOCATIONS = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), lists as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from pieces
), grams as (
  select lang, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) as p from lists
), counts as (select lang, p, count(*) as f from grams group by lang, p
), totals as (select lang, sum(f)::bigint as n from counts where len(p) = 1 group by lang
), candidates as (select lang, p, f from counts where len(p) > 1 and f >= 30
), cuts as (select lang, p, f, unnest(range(1, len(p))) as k from candidates
), tried as (
  select c.*, x.f as l, y.f as r, (2000000::hugeint * c.f // (x.f::hugeint + y.f))::bigint as score
  from cuts c join counts x on x.lang = c.lang and x.p = c.p[:c.k] join counts y on y.lang = c.lang and y.p = c.p[c.k + 1:]
), best as (select *, row_number() over (partition by lang, p order by score, k) as place from tried
), held as (
  select distinct b.lang, b.p from candidates c, unnest(range(2, len(c.p))) as q(k), unnest(range(1, len(c.p) - k + 2)) as s(i)
  join candidates b on b.lang = c.lang and b.p = c.p[i:i + k - 1] where 100 * c.f >= 80 * b.f
), ranked as (
  select lang, array_to_string(p, ' ') as phrase, f as a, l, r, score, row_number() over (partition by lang order by score desc, f desc, array_to_string(p, ' ')) as rank
  from best b where place = 1 and not exists (select 1 from held h where h.lang = b.lang and h.p = b.p)
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000"""
