"""Registered queries of binary payloads over crafted messages of a dozen kinds, each with the same question in SQL over the same bytes."""

from pyspark.sql import functions as F

from packetlake.operators import binary
from packetlake.plans.packets import ORACLE, packets

QUERIES, SQL = {}, {}


def _hex(x):
    """Two hexadecimal digits of a number under 256, in any SQL."""
    return f"concat(substr('0123456789ABCDEF', cast(1 + ({x}) {{div}} 16 as int), 1), substr('0123456789ABCDEF', cast(1 + ({x}) % 16 as int), 1))"


_HEAD = f"concat('01010600', '39{{z2}}', {_hex('h % 256')}, '00000000', case when h % 5 = 0 then 'C0A80122' else '00000000' end, case when h % 7 = 0 then 'C0A80144' else '00000000' end, '0000000000000000', case when h % 11 = 0 then '000000000000' else concat('02AA0000', {_hex('h % 50')}, '07') end, repeat('00', 10), repeat('00', 192))".replace("{z2}", "03")
_HOST, _VENDOR, _ASKED, _KIND = f"concat('0C03', '7063', '3', cast(h % 10 as {{text}}))", "'3C084D53465420352E30'", f"concat('3204C0A801', {_hex('h % 200')})", f"concat('3501', {_hex('1 + h % 9')})"
_VIEW = f"""
select pkt_id, ts_ms, src_ip, dst_ip, src_mac, h,
  case m when 8 then 10001 when 9 then 47808 when 3 then 5355 else src_port end as src_port,
  case when m in (0, 1) then 67 when m in (2, 4, 10) then 5353 when m = 3 then 5355 when m in (5, 6) then 502 when m in (7, 8) then 47808 else dst_port end as dst_port,
  case m
    when 0 then concat({_HEAD}, case when h % 6 = 3 then '00000000' else '63825363' end, case h % 6
        when 0 then concat({_KIND}, {_HOST}, {_VENDOR}, {_ASKED}, 'FF') when 1 then concat({_ASKED}, '0000', {_VENDOR}, {_HOST}, {_KIND}, 'FF00', {_HOST})
        when 2 then concat({_KIND}, {_ASKED}, '0C147063', '3', cast(h % 10 as {{text}})) when 3 then concat({_KIND}, 'FF') when 4 then concat('350200', '01', {_HOST}, 'FF') else concat({_KIND}, '0C02C328', '3C') end)
    when 1 then concat('01010600', repeat('00', 100))
    when 2 then concat('000084000000000100000000', case h % 4
        when 0 then concat('0463616D3', cast(h % 9 as {{text}}), 'C019', '000000000000', '056C6F63616C00') when 1 then concat('0463616D3', cast(h % 9 as {{text}}), 'C011', '0000') when 2 then concat('0463616D3', cast(h % 9 as {{text}}), '056C6F63616C00', '0001') else '00' end)
    when 3 then concat('000080000001', case when h % 3 = 0 then '0000' else '0001' end, '00000000', '067365727665723', cast(h % 8 as {{text}}), '00')
    when 4 then concat('000000000001000100000000', '0463616D3', cast(h % 9 as {{text}}), '00')
    when 5 then concat('000100000006', {_hex('h % 7')}, {_hex("case h % 6 when 0 then 5 when 1 then 6 when 2 then 3 when 3 then 16 when 4 then 43 else 99 end")}, case when h % 5 = 0 then '01' else concat({_hex('h % 256')}, '10', '00', {_hex('h % 199')}) end)
    when 6 then '0001000000'
    when 10 then concat('000084000000000100000000', '3F', repeat('61', 63), '056C6F63616C00')
    when 11 then '81'
    else concat(case when h % 13 = 0 then '82' else '81' end, '0A001001', case h % 5 when 0 then '00' when 1 then '20FFFF00FF' when 2 then '20000102AABBFF' when 3 then '08000201C5' else '28000101AA000302BBCCFF' end,
        case when h % 2 = 0 then concat('00', '04', {_hex("case h % 7 when 0 then 12 when 1 then 14 when 2 then 15 when 3 then 16 when 4 then 20 when 5 then 3 else 8 end")}, '0011')
          when h % 3 = 0 then concat('10', {_hex("case h % 4 when 0 then 8 when 1 then 0 when 2 then 7 else 8 end")}, '00') else '30' end)
  end as raw
from (select *, pkt_id % 12 as m from {{packets}})
"""  # fmt: skip


def binaries(spark, sf_dir):
    """A binary message of one of twelve kinds for each packet."""
    rows = spark.sql(_VIEW.format(div="div", text="string", packets="{packets}"), packets=packets(spark, sf_dir))
    return rows.withColumn("payload_raw", F.unhex("raw"))


_BYTES = "binaries as (" + _VIEW.format(div="//", text="varchar", packets="packets") + "), byted as (select *, length(raw) // 2 as n, list_transform(range(length(raw) // 2), lambda i: ('0x' || substr(raw, (2 * i + 1)::int, 2))::int) as b from binaries)"
_SAID = "decode(case when len({0}) = 0 then ''::blob else from_hex({0}) end)"


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with recursive {ORACLE}, {_BYTES}, {sql}"


def _ip(at):
    return "concat_ws('.', " + ", ".join(f"b[{at + k + 1}]" for k in range(4)) + ")"


_TYPES = "case kind " + " ".join(f"when {k} then '{v}'" for k, v in binary.DHCP_TYPES.items()) + " else 'Type ' || kind end"
# names as hexadecimal, so that broken UTF-8 compares by its bytes; in text the broken byte is the replacement character
add("x23_dhcp", lambda s, d: binary.dhcp(binaries(s, d)),
    f"""msg as (select *, case when b[3] = 6 then lower(concat_ws(':', substr(raw, 57, 2), substr(raw, 59, 2), substr(raw, 61, 2), substr(raw, 63, 2), substr(raw, 65, 2), substr(raw, 67, 2))) else src_mac end as mac from byted where (dst_port in (67, 68) or src_port in (67, 68)) and n >= 240),
  walk as (select pkt_id, 240 as pos, 0 as kind, '' as host, '' as vendor, null::int[] as asked, raw, b, n from msg where substr(raw, 473, 8) = '63825363' and n > 240 union all
    select pkt_id, case when b[pos + 1] = 0 then pos + 1 else pos + 2 + b[pos + 2] end, case when b[pos + 1] = 53 and b[pos + 2] = 1 then b[pos + 3] else kind end, case when b[pos + 1] = 12 then substr(raw, (2 * (pos + 2) + 1)::int, (2 * b[pos + 2])::int) else host end,
      case when b[pos + 1] = 60 then substr(raw, (2 * (pos + 2) + 1)::int, (2 * b[pos + 2])::int) else vendor end, case when b[pos + 1] = 50 and b[pos + 2] = 4 then b[pos + 3:pos + 6] else asked end, raw, b, n from walk where pos < n - 1 and b[pos + 1] <> 255),
  last as (select pkt_id, max_by(kind, pos) as kind, max_by(host, pos) as host, max_by(vendor, pos) as vendor, max(array_to_string(asked, '.')) as asked from walk group by pkt_id),
  said as (select m.pkt_id, ts_ms, mac, {_ip(16)} as yours, {_ip(12)} as own, coalesce(asked, '') as asked, coalesce(kind, 0) as kind, coalesce(host, '') as host, coalesce(vendor, '') as vendor from msg m left join last using (pkt_id) where mac not in ('', '00:00:00:00:00:00'))
  select pkt_id, ts_ms, mac, case when yours <> '0.0.0.0' then yours when own <> '0.0.0.0' then own when asked not in ('', '0.0.0.0') then asked else '' end as ip,
    case when host = 'C328' then chr(65533) || '(' else {_SAID.format('host')} end as hostname, {_SAID.format('vendor')} as vendor, {_TYPES} as type from said""")  # fmt: skip
add("x24_poisoned_names", lambda s, d: binary.poisoned_names(binaries(s, d)),
    f"""resp as (select *, case when 5353 in (dst_port, src_port) then 'mDNS' else 'LLMNR' end as protocol from byted where (dst_port in (5353, 5355) or src_port in (5353, 5355)) and n >= 12 and b[3] >= 128 and b[7] * 256 + b[8] > 0),
  walk as (select pkt_id, 12 as pos, '' as name, 0 as jumps, 0 as steps, b, raw, n from resp union all
    select pkt_id, case when b[pos + 1] >= 192 then (b[pos + 1] - 192) * 256 + b[pos + 2] else pos + 1 + b[pos + 1] end, case when b[pos + 1] < 64 then name || case when name = '' then '' else '2E' end || substr(raw, (2 * (pos + 1) + 1)::int, (2 * b[pos + 1])::int) else name end,
      jumps + (b[pos + 1] >= 192)::int, steps + 1, b, raw, n from walk where pos < n and b[pos + 1] > 0 and (b[pos + 1] < 64 or (b[pos + 1] >= 192 and jumps < {binary.JUMPS} and pos + 1 < n)) and steps < {binary.LABELS + binary.JUMPS}),
  names as (select pkt_id, max_by(name, steps) as name from walk group by pkt_id),
  firsts as (select protocol, name, src_ip, min(row(ts_ms, pkt_id)) as pos from resp join names using (pkt_id) where name <> '' group by protocol, name, src_ip),
  placed as (select *, row_number() over (partition by protocol, name order by pos) as place from firsts)
  select struct_extract(max(pos), 2) as pkt_id, struct_extract(max(pos), 1) as ts_ms, max_by(src_ip, pos) as src_ip, protocol, {_SAID.format('name')} as name, case protocol when 'mDNS' then 'HIGH' else 'CRITICAL' end as severity, string_agg(src_ip, ', ' order by src_ip) as responders
  from placed where place <= 2 group by protocol, name having count(*) > 1""")  # fmt: skip
_FUNCTIONS = "case f " + " ".join(f"when {k} then '{v}'" for k, v in binary.MODBUS_NAMES.items()) + " else 'Function ' || f end"
add("x13_modbus", lambda s, d: binary.modbus(binaries(s, d)),
    f"""m as (select *, b[8] as f, b[8] in {binary.MODBUS_WRITES} as w from byted where dst_port = 502 or src_port = 502)
  select pkt_id, ts_ms, src_ip, dst_ip, case when n < 8 then 'Modbus/SCADA' when w then 'Modbus WRITE' else 'Modbus READ' end as kind, case when n < 8 or w then 'CRITICAL' else 'INFO' end as severity,
    case when n < 8 then 'no authentication' when w then 'Unit ' || b[7] || ', ' || {_FUNCTIONS} || case when n >= 12 then ', Register ' || (b[9] * 256 + b[10]) || ' = ' || (b[11] * 256 + b[12]) else '' end else {_FUNCTIONS} end as detail from m""")  # fmt: skip
add("x14_bacnet", lambda s, d: binary.bacnet(binaries(s, d)),
    """m as (select *, (b[6] & 32) > 0 as dest, (b[6] & 8) > 0 as sourced from byted where (dst_port = 47808 or src_port = 47808) and not list_has_any([dst_port, src_port], [10001, 8443]) and b[1] = 129),
  o as (select *, case when dest then 9 + b[9] else 6 end as s from m), a as (select *, case when sourced then s + 3 + b[s + 3] else s end + dest::int as a from o),
  v as (select *, case b[a + 1] // 16 when 1 then b[a + 2] when 0 then b[a + 3] end as v from a where n > a + 2),
  k as (select *, case when v = 8 then 'BACnet Discovery' when v = 0 then 'BACnet Device' when v in (15, 16) then 'BACnet WRITE' when v = 20 then 'BACnet RESET' when v in (12, 14) then 'BACnet READ' end as kind from v)
  select pkt_id, ts_ms, src_ip, dst_ip, kind, case when v = 8 then 'MEDIUM' when v in (0, 12, 14) then 'INFO' else 'CRITICAL' end as severity, 'Service ' || v as detail from k where kind is not null""")  # fmt: skip
