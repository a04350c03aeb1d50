"""Registered query of process verdicts, over a process for each row of `events`, with the same question in SQL."""

from packetlake.operators import processes

#: pid, parent (a tree of three children each, whose root is its own parent), name, path, publisher and the other facts by the event's number.
_VIEW = """
select h % 3 as host, e as pid, case when e < 3 then e else (e {div} 9) * 3 + e % 3 end as parent,
  case h % 23 when 0 then 'WScript.exe' when 1 then 'mshta.exe' when 2 then 'cmd.exe' when 3 then 'powershell.exe' when 4 then 'svchost.exe' when 5 then 'lsass.exe' when 6 then 'csrss.exe' else 'app.exe' end as name,
  case h % 7 when 0 then 'C:{b}Windows{b}System32{b}x.exe' when 1 then 'C:{b}Program Files (x86){b}x.exe' when 2 then 'C:{b}Users{b}a{b}Downloads{b}x.exe' when 3 then 'D:{b}tools{b}x.exe' when 4 then 'C:{b}Windows{b}Temp{b}x.exe' when 5 then null else 'C:{b}ProgramData{b}x.exe' end as path,
  h % 31 <> 0 as present, case h % 5 when 0 then 'Microsoft Corporation' when 1 then 'Valve Corp.' when 2 then 'Small Shop' else null end as publisher,
  cast(h % 4 as double) / 2 as age_days, md5(cast(h % 40 as {text})) as sha256, case when h % 3 = 0 then null else h % 8 end as detections
from (select event_id as e, cast((event_id * 7919 + 13) % 10007 as int) as h from {events})
"""


def facts(s, d):
    view = _VIEW.format(div="div", text="string", events="{events}", b="\\\\")
    return s.sql(view, events=s.read.parquet(f"{d}/events.parquet").select("event_id"))


_KNOWN = "select distinct sha256 from facts where detections = 0"
QUERIES = {"v19_process_verdicts": lambda s, d: processes.verdicts(facts(s, d), facts(s, d).where("detections = 0").select("sha256"))}
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_HAS = lambda column, xs: "(" + " or ".join(f"contains({column}, '{x}')" for x in xs) + ")"
_FROM = lambda column, xs: "(" + " or ".join(f"starts_with({column}, '{x}')" for x in xs) + ")"
SQL = {
    "v19_process_verdicts": f"""with recursive facts as materialized ({_VIEW.format(div='//', text='varchar', events='events', b=chr(92))}),
  up as (select host, pid, parent as above, 1 as level from facts union all select u.host, u.pid, f.parent, level + 1 from up u join facts f on f.host = u.host and f.pid = u.above where level < {processes.LEVELS}),
  scripts as (select distinct u.host, u.pid from up u join facts f on f.host = u.host and f.pid = u.above where lower(f.name) in {_LIST(processes.SCRIPT_HOSTS)}),
  shells as (select distinct c.host, c.pid from facts c join facts p on p.host = c.host and p.pid = c.parent where lower(p.name) in {_LIST(processes.SHELLS)} and lower(c.name) in {_LIST(processes.OWNED)}),
  parts as (select f.*, case when publisher is null then -1 when {_HAS('lower(publisher)', processes.TRUSTED)} then 3 else 1 end
      + case when {_FROM('lower(path)', processes.SYSTEM_PLACES)} then case when age_days < 1 then 0 else 2 end when {_FROM('lower(path)', processes.PROGRAM_PLACES)} then 1 when {_HAS('lower(path)', processes.ODD_PLACES)} then -2 else 0 end
      + case when sha256 in ({_KNOWN}) then 3 else 0 end + case when detections is null then 0 when detections = 0 then 2 when detections <= 2 then -1 when detections <= 5 then -3 else -5 end
      - case when s.pid is not null or sh.pid is not null then 2 else 0 end as total from facts f left join scripts s on s.host = f.host and s.pid = f.pid left join shells sh on sh.host = f.host and sh.pid = f.pid)
  select host, pid, case when path is not null and present then total end::int as score,
    case when path is null then 'UNKNOWN' when not present then 'SUSPICIOUS' when total >= 4 then 'VERIFIED_SAFE' when total >= 2 then 'LIKELY_SAFE' when total >= -1 then 'UNKNOWN' when total >= -3 then 'SUSPICIOUS' else 'MALICIOUS' end as verdict,
    case when path is not null and present then least(abs(total) / 5.0::double, 1.0::double) else 0.0::double end as confidence from parts""",  # fmt: skip
}
