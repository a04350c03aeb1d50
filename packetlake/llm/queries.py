"""The registered queries of this subpackage and their oracle SQL."""

import importlib

from . import oracles

#: query -> module of this subpackage
MODULES = {
    "op1_ngram_jaccard_join": "ngram_join",
    "op2_embedding_near_dedup": "vector_dedup",
    "op3_html_extraction": "html_extract",
    "op4_toxicity": "toxicity",
    "op5_byte_bpe": "bpe",
    "op6_substring_dedup": "substring_dedup",
    "op7_quality_rules": "quality_rules",
    "op8_quality_classifier": "quality_classifier",
    "op9_best_fit_packing": "packing",
    "op10_kd_shards": "sharding",
    "op11_phrase_collocations": "collocations",
    "op12_lattice_lm": "lattice_lm",
    "op13_conversation_repair": "conversation_repair",
}


def queries() -> dict:
    def call(name):
        return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{MODULES[name]}"), name)(spark, sf_dir)

    return {name: call(name) for name in MODULES}


_REACH = """reach as (select a as x, b as y from links union select b, a from links union select r.x, l.b from reach r join (select a, b from links union all select b, a from links) l on l.a = r.y)"""

#: Only what SQL can say in full: the others learn models, pack greedily or decode, and are tested in tests/llm.
ORACLES = {
    "op1_ngram_jaccard_join": f"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w
), e as (select doc_id, len(sh) as n, unnest(sh) as h from s
), links as (
  select x.doc_id as a, y.doc_id as b from e x join e y on x.h = y.h and x.doc_id < y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 75 * (x.n + y.n - count(*))
), {_REACH}
select doc_id, len(sh)::bigint as n_shingles, least(doc_id, coalesce((select min(y) from reach where x = doc_id), doc_id)) as component_id from s""",
    "op2_embedding_near_dedup": f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id
  where list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98
), {_REACH}, n as (select id, count(*) as n from (select a as id from links union all select b from links) group by id)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce((select min(y) from reach where x = vec_id), vec_id)) as component_id,
  least(vec_id, coalesce((select min(y) from reach where x = vec_id), vec_id)) = vec_id as kept from embeddings left join n on id = vec_id""",
    "op11_phrase_collocations": oracles.COLLOCATIONS,
    "op13_conversation_repair": oracles.CONVERSATIONS,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
