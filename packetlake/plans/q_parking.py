"""Registered queries of parking messages over crafted XML, each with the same question in SQL."""

from pyspark.sql import functions as F

from packetlake.operators import parking
from packetlake.plans.packets import ORACLE, packets

#: Agencies of the query: code, state.
AGENCIES = ((4, "NY"), (6, "PA"), (12, "DE"), (64, "--"))
_VIEW = """
select pkt_id, ts_ms, src_ip, case when h % 9 = 0 then 31769 else src_port end as src_port, case when h % 9 = 1 then 31770 else 31769 end as dst_port,
  concat(case when h % 4 = 0 then 'xx' else '' end, '<msg><', t, '> UpdateTicket </', t, '>', case when h % 3 = 0 then concat('<senderid>gate', cast(h % 5 as {text}), ' </senderid>') else '' end,
    case when h % 5 = 0 then '' else concat('<TicketNumber>', cast(h % 1000 as {text}), '</TicketNumber>') end, case m
    when 0 then concat('<LastFour>', cast(1000 + h % 60 as {text}), '</LastFour>', case when h % 2 = 0 then '<CardType>VISA</CardType>' else '' end)
    when 1 then concat('<EntryCredential>:', cast(h % 70 as {text}), ':', cast(1000000 + h % 40 as {text}), '</EntryCredential>')
    when 2 then concat('<entrycredential> ', cast(60 + h % 10 as {text}), ':', cast(1234 + h % 3 as {text}), '</entrycredential>')
    when 3 then concat('<EntryCredential>:', cast(1000 + h % 9000 as {text}), '</EntryCredential>')
    when 4 then concat('<AccountId>acc', cast(h % 7 as {text}), '</AccountId>')
    else '<LastFour>12</LastFour>' end, '</msg>') as payload
from (select *, pkt_id % 6 as m, case when h % 2 = 0 then 'Command' else 'CommandType' end as t from {packets})
"""


def _made(s, d):
    return s.sql(_VIEW.format(text="string", packets="{packets}"), packets=packets(s, d))


def _find(s, d):
    return parking.findings(_made(s, d), s.createDataFrame([(c, x, x) for c, x in AGENCIES], "code int, state string, name string"))


_ELEMENTS = ", ".join(f"regexp_extract(payload, '(?i){p}', 1) as \"{n}\"" for n, p in parking.ELEMENTS.items())
_ROWS = f"""with {ORACLE}, made as ({_VIEW.format(text='varchar', packets='packets')}), m as (select *, {_ELEMENTS} from made where dst_port = 31769 or src_port = 31769),
  g as (select *, case when sender = '' then src_ip else trim(sender) end as gate from m)"""
QUERIES = {"x15_parking": _find, "x15_parking_commands": lambda s, d: parking.commands(_made(s, d)).select("pkt_id", "command", "ticket", "gate", "account")}
SQL = {
    "x15_parking": f"""{_ROWS}, tags as (select *, split_part(tag, ':', 1) as agency, split_part(tag, ':', 2) as id from g where tag <> ''),
  t as (select *, agency = '68' or (agency::int > 60 and length(id) <= 5) as near, case agency::int {' '.join(f"when {c} then '{x}'" for c, x in AGENCIES)} end as state from tags),
  f as (select pkt_id, ts_ms, last4 || ':' || coalesce(nullif(card_type, ''), 'Unknown') as key, 'CARD' as kind, 'CRITICAL' as severity, coalesce(nullif(card_type, ''), 'Unknown') || ' ****' || last4 as masked, ticket, gate from g where last4 <> ''
    union all select pkt_id, ts_ms, tag, case when near then 'CONTACTLESS' else 'TRANSPONDER' end, case when near then 'HIGH' else 'CRITICAL' end, agency || ':' || repeat('*', length(id) - 3) || right(id, 3) || case when not near and state is not null then ' ' || state else '' end, ticket, gate from t
    union all select pkt_id, ts_ms, 'ticket ' || pkt_id, 'CARD_AS_TICKET', 'HIGH', '****' || as_ticket, ticket, gate from g where as_ticket <> '' and tag = '' and last4 = '')
  select pkt_id, ts_ms, kind, severity, masked, ticket, gate, n from (select *, row_number() over (partition by key order by ts_ms, pkt_id) as place, count(*) over (partition by key) as n from f) where place = 1""",
    "x15_parking_commands": f"{_ROWS} select pkt_id, command, ticket, gate, trim(account) as account from g where command <> '' and last4 = '' and tag = ''",
}
