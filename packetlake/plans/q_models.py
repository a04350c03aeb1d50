"""Registered queries of the anomaly models and what is made of their scores, each with the same question in SQL: the draws are MD5, so SQL grows the same trees."""

from pyspark.sql import functions as F

from packetlake.operators import features, models
from packetlake.operators.features import FEATURES
from packetlake.operators.stored import stored
from packetlake.plans.packets import ORACLE, packets
from packetlake.plans.q_traffic import _DEV, FEATURE_SQL, LONG, PRIVATE_SQL, VALUE

QUERIES, SQL = {}, {}


def add(name, run, sql):
    QUERIES[name], SQL[name] = run, f"with recursive {ORACLE}, {sql}"


def _draw(*names):
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(names)})), 1, 8))::bigint"


_X = ", ".join(FEATURES)
_ROWS = f"""{FEATURE_SQL},
  num as materialized (select slot, row_number() over (order by slot) - 1 as number, [{_X}] as x from feat),
  born as materialized (select slot as b from num where number = {models.GATE - 1}),
  sched as materialized (select (slot - b) // {models.EVERY} as cell, min(slot) as model, min(number) + 1 as high, greatest(min(number) + 1 - {models.HISTORY}, 0) as low from num, born where slot >= b group by 1),
  draws as (select model, tree, low + {_draw('model', 'tree', 'j', "'s'")} % (high - low) as number, j from sched, unnest(range({models.TREES})) as t(tree), unnest(range({2 * models.SAMPLE})) as u(j)),
  picked as (select model, tree, number, row_number() over (partition by model, tree order by min(j)) as place from draws group by model, tree, number),
  lv0 as materialized (select model, tree, x, 1 as node from picked join num using (number) where place <= {models.SAMPLE})"""
_MOST = 8


def _level(d):
    low = ", ".join(f"min(x[{k}])" for k in range(1, len(FEATURES) + 1))
    high = ", ".join(f"max(x[{k}])" for k in range(1, len(FEATURES) + 1))
    leaf = "false" if d < _MOST else "true"
    out = f""",
  st{d} as (select model, tree, node, count(*) as size, [{low}] as lo, [{high}] as hi from lv{d} group by model, tree, node),
  wd{d} as (select *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: hi[i] > lo[i]) as wide from st{d}),
  fe{d} as (select *, case when {leaf} or size <= 1 or len(wide) = 0 then null else wide[1 + {_draw('model', 'tree', 'node', "'f'")} % len(wide)] end as f from wd{d}),
  nd{d} as materialized (select model, tree, node, size, {d} as depth, f, lo[f] + {_draw('model', 'tree', 'node', "'c'")} / 4294967296.0::double * (hi[f] - lo[f]) as cut from fe{d})"""
    if d < _MOST:
        out += f""",
  lv{d + 1} as materialized (select model, tree, x, 2 * node + (x[f] >= cut)::int as node from lv{d} join nd{d} using (model, tree, node) where f is not null)"""
    return out


_TREES = _ROWS + "".join(map(_level, range(_MOST + 1))) + ", nodes as materialized (" + " union all ".join(f"select * from nd{d}" for d in range(_MOST + 1)) + ")"
_PATH = "case when {0} > 2 then 2 * (ln({0} - 1) + 0.5772156649::double) - 2 * ({0} - 1) / {0}::double when {0} = 2 then 1.0::double else 0.0::double end"
_SCORES = f"""{_TREES},
  served as (select n.slot, max(s.model) as model from num n join sched s on s.model < n.slot group by n.slot),
  asked as materialized (select s.model, n.slot, x, true as own, high - low as size from sched s join num n on n.number >= low and n.number < high union all select model, slot, x, false, high - low from served join num using (slot) join sched using (model)),
  walk as (select model, slot, own, size as seen, x, tree, 1 as node from asked, unnest(range({models.TREES})) as t(tree) union all
    select w.model, w.slot, w.own, w.seen, w.x, w.tree, 2 * w.node + (w.x[n.f] >= n.cut)::int from walk w join nodes n on n.model = w.model and n.tree = w.tree and n.node = w.node where n.f is not null),
  deep as (select w.model, slot, own, any_value(seen) as seen, avg(depth + {_PATH.format('size')}) as mean from walk w join nodes n on n.model = w.model and n.tree = w.tree and n.node = w.node where n.f is null group by w.model, slot, own),
  anom as materialized (select model, slot, own, 2.0::double ** (-(mean / ({_PATH.format(f'least({models.SAMPLE}, seen)')}))) as anomaly from deep),
  cuts as (select model, quantile_cont(anomaly, {1 - models.CONTAMINATION}) as cut from anom where own group by model),
  forest as materialized (select slot, model, anomaly, least(greatest(anomaly - cut, 0), 1) as forest from anom join cuts using (model) where not own)"""


def _history(s, d):
    return stored(features.features(packets(s, d)))  # read by the models and by the scores


add("l3_model_table", lambda s, d: models.scored(_history(s, d))[1].select("model", "tree", "node", "feature", F.round("cut", 6).alias("cut"), "size", "depth"),
    f"{_TREES} select model, tree::int as tree, node::int as node, coalesce(f - 1, -1)::int as feature, round(coalesce(cut, 0.0), 6) as cut, size::int as size, depth::int as depth from nodes")
add("l4_forest_scores", lambda s, d: models.scored(_history(s, d))[0].select("slot", "model", F.round("anomaly", 6).alias("anomaly"), F.round("forest", 6).alias("forest")),
    f"{_SCORES} select slot, model, round(anomaly, 6) as anomaly, round(forest, 6) as forest from forest")


def _combined(s, d):
    """slot, trained, anomaly, reasons: all four scores of each window; before the first model the forest's is 0.

    The planner takes the sides of these joins for small by the bytes of compressed tables, and would broadcast them.
    """
    rows = _history(s, d)
    seen = packets(s, d)
    beacon = seen.select("dst_ip", F.floor(F.col("ts_ms") / 5000).alias("slot")).distinct().hint("merge").join(features.beacons(seen).select("dst_ip", "score"), "dst_ip").groupBy("slot").agg(F.max("score").alias("beacon"))
    dns = features.dns_scores(seen, 5).select("slot", F.col("dns_score").alias("dns"))
    forest = models.scored(rows)[0].select("slot", F.round("forest", 4).alias("forest"), F.lit(True).alias("trained"))
    all_of = features.deviation(rows).withColumn("deviation", F.round("deviation", 4)).hint("merge").join(rows, "slot")
    for part in (beacon, dns, forest):
        all_of = all_of.join(part.hint("merge"), "slot", "left")
    all_of = all_of.fillna(0.0, ["beacon", "dns", "forest"]).fillna(False, ["trained"])
    parts = [F.col(x) for x in ("deviation", "forest", "beacon", "dns")]
    return all_of.select("slot", "trained", features.combined(*parts).alias("anomaly"), features.reasons(*parts).alias("reasons"))


_DNS = """dq as (select ts_ms // 5000 as slot, pkt_id, dns_query, split_part(dns_query, '.', 1) as label from packets where dns_query <> '' and not ends_with(dns_query, '.local')),
  de as (select pkt_id, sum(-p * log2(p)) as h from (select pkt_id, count(*) / sum(count(*)) over (partition by pkt_id) as p from (select pkt_id, unnest(string_split(label, '')) as ch from dq) group by pkt_id, ch) group by pkt_id),
  db as (select slot, count(*) as n, count(*) filter (length(dns_query) > 60) as long, count(*) filter (length(label) > 25 and h > 4.0) as odd from dq join de using (pkt_id) group by slot),
  dns as (select slot, round(greatest(case when long >= 3 then least(long / n::double * 2, 1.0::double) else 0.0 end, case when odd >= 5 then 0.7 else 0.0 end, case when n / 5.0 > 50 then least(n / 5.0::double / 150, 1.0::double) else 0.0 end)::double, 6) as dns from db)"""
_BEACON = f"""bg as (select *, {VALUE.replace('(ip,', '(dst_ip,')} as v, (ts_ms - lag(ts_ms) over (partition by dst_ip order by ts_ms, pkt_id)) / 1000.0::double as gap from packets),
  bb as (select dst_ip, round(1 - stddev_pop(gap) / avg(gap), 6) as score from bg where not ({PRIVATE_SQL}) and not v between 3758096384 and 4026531839 group by dst_ip having count(*) >= 15 and avg(gap) between 5 and 300 and stddev_pop(gap) / avg(gap) < 0.05),
  beacon as (select ts_ms // 5000 as slot, max(score) as beacon from packets join bb using (dst_ip) group by 1)"""
_SCORED = f"""{_SCORES}, {_DNS}, {_BEACON}, {LONG}, {_DEV},
  dv as (select slot, round(case when any_value(n) < 10 then 0.0::double else 1 - 1 / (1 + least(10.0::double, avg(z)) / 3) end, 4) as dev from zs group by slot),
  parts as (select dv.slot, dev, round(coalesce(forest.forest, 0.0), 4) as iso, coalesce(beacon, 0.0) as beacon, coalesce(dns, 0.0) as dns, forest.model is not null as trained from dv left join forest using (slot) left join beacon using (slot) left join dns using (slot)),
  scored as (select slot, trained, round(0.30::decimal(3,2) * dev::decimal(12,6) + 0.35::decimal(3,2) * least(iso, 1.0::double)::decimal(12,6) + 0.15::decimal(3,2) * beacon::decimal(12,6) + 0.20::decimal(3,2) * dns::decimal(12,6), 4)::double as anomaly,
    concat_ws('|', case when dev > 0.5 then 'deviation' end, case when iso > 0.3 then 'forest' end, case when beacon > 0.5 then 'beacon' end, case when dns > 0.5 then 'dns' end, case when unique_dst_ports > 200 then 'ports' end,
      case when syn_ratio > 0.7 then 'syn' end, case when failed_conn_ratio > 0.5 then 'failed' end) as reasons from parts join feat using (slot))"""
add("l7_combined_scores", lambda s, d: _combined(s, d).select("slot", "trained", "anomaly", F.array_join("reasons", "|").alias("reasons")), f"{_SCORED} select slot, trained, anomaly, reasons from scored")
add("l9_anomaly_alerts", lambda s, d: features.anomaly_alerts(_combined(s, d).where("trained")),
    f"{_SCORED} select slot, 'ML-ANOMALY' as rule_id, case when anomaly > 0.8 then 'CRITICAL' when anomaly > 0.5 then 'HIGH' else 'MEDIUM' end as severity, anomaly, reasons from scored where trained and anomaly > 0.25 and contains(reasons, '|')")
add("a23_daily_summary", lambda s, d: features.daily_summary(_combined(s, d)),
    f"{_SCORED}, dec as (select slot, anomaly, anomaly::decimal(9,4) as a from scored) select slot * 5 // 86400 as day, round(sum(a)::double / count(*), 4) as avg_score, round(max(anomaly), 4) as max_score, round(min(anomaly), 4) as min_score, count(*) filter (anomaly > 0.25) as anomalies, count(*) as samples, round(100 * count(*) filter (anomaly > 0.25) / count(*)::double, 2) as pct from dec group by 1")
add("a24_recent_scores", lambda s, d: features.recent_scores(_combined(s, d), 5).select("slot", "anomaly"), f"{_SCORED} select slot, anomaly from scored where slot > (select max(slot) from scored) - 60")
