"""The queries of this package, opN_* and pipeline, and the SQL that checks those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.chunkbpe import decode_ids, encode_texts
from vellum.llm.common import read_table
from vellum.llm.decontaminate import find_contamination
from vellum.llm.dialogues import repair_conversations
from vellum.llm.embeddup import near_embeddings
from vellum.llm.linededup import dedup_lines
from vellum.llm.mixing import mix_sources
from vellum.llm.pii import find_pii
from vellum.llm.resample import resample
from vellum.llm.secrets import find_secrets
from vellum.llm.simhash import simhash_components
from vellum.llm.tokencount import count_tokens
from vellum.llm.toxicity import score_toxicity
from vellum.llm.urls import judge_urls

#: Rules of op7: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors of all labels."""
    return near_embeddings(read_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: plain findings, linked sets, digests."""
    return find_secrets(read_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, sources near their targets."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, with the best window."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return find_contamination(docs, items)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, spans, scores, digests."""
    return find_pii(read_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document; held-out labels are never learned from."""
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score_toxicity(docs, labels)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, words and code points of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many it loses, and the digest of what stays."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) as kept_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's n-grams: five of 100 that have 20 words."""
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return resample(docs, items).select("doc_id", "n_features", "weight", "score", "rank")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    out = decode_ids(encode_texts(read_table(spark, sf_dir, "documents")))
    return out.selectExpr(
        "doc_id", "n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256", "n_chunks"
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    return repair_conversations(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_embedding_near_dedup,
            op2_secret_scan,
            op3_mix_sources,
            op4_simhash_near_dedup,
            op5_decontamination,
            op6_pii,
            op7_url_filter,
            op8_toxicity,
            op9_token_counts,
            op10_line_dedup,
            op11_importance_resampling,
            op12_bpe_round_trip,
            op13_conversation_repair,
            pipeline,
        )
    }


_VECTORS = r"""
with recursive vec as (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from vec a join vec b
    on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), own as (
  select v.vec_id, (select count(*) from links where a = v.vec_id) as n_links,
         least(v.vec_id, coalesce((select min(b) from reach where a = v.vec_id), v.vec_id)) as component_id
  from embeddings v
)
select vec_id, n_links, component_id, vec_id = component_id as kept from own
"""

_URL = r"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages
), rules(verdict, rule_host, rule_path) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
         ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits as (
  select page_id, host, path, verdict, rule_host || rule_path as rule,
         row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as n
  from parts join rules
    on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and f.n = 1
"""

_LINES = r"""
with doc as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (
  select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from doc
), keyed as (
  select doc_id, line, pos,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), firsts as (
  select key, min(doc_id) as first_doc from keyed where length(key) >= 10
  group by key having count(distinct doc_id) >= 2
), marked as (
  select k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first_doc, false) as dropped
  from keyed k left join firsts f on k.key = f.key
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), ''))
         as kept_sha256
from marked group by doc_id
"""

_RESAMPLE = r"""
with poly as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda r, b: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)) as step
), words as (
  select 'd' as kind, doc_id as id, row_number() over () as row, coalesce(text, '') as text from documents
  union all select 'b', null, row_number() over (), coalesce(text, '') from benchmark
), runs as (
  select kind, id, row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from words
), grams as (
  select kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as g
  from runs
), counted as (
  select kind, row, g, count(*) as n from grams group by all
), hexed as (
  select g, hex(encode(g)) as h from (select distinct g from counted)
), bucketed as (
  select g, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2),
                lambda i: ('0x' || substr(h, i, 2))::bigint)),
              lambda r, b: xor(r >> 8, step[(xor(r, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from hexed, poly
), sizes as (
  select bucket, coalesce(sum(n) filter (where kind = 'd'), 0) as s, coalesce(sum(n) filter (where kind = 'b'), 0) as t
  from counted join bucketed using (g) group by bucket
), totals as (
  select coalesce(sum(s), 0) as all_s, coalesce(sum(t), 0) as all_t from sizes
), gains as (
  select bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::double / ((s + 1) * (all_t + 10000))::double))::bigint as gain
  from sizes, totals
), weights as (
  select row, sum(n) as n_features, sum(n * gain)::bigint as weight
  from counted join bucketed using (g) join gains using (bucket) where kind = 'd' group by row
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5)::double
                                                    / 4294967296)))::bigint as score
  from runs left join weights using (row) where kind = 'd'
), ranked as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () * 5 // 100 as drawn
  from scored where n_words >= 20
)
select s.doc_id, n_features, weight, score, case when place <= drawn then place end as rank
from scored s left join ranked r on s.doc_id = r.doc_id
"""

_REPAIR = r"""
with recursive poly as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda r, b: case when r & 1 = 1 then xor(r >> 1, 3988292384) else r >> 1 end)) as step
), named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations
), hit as (
  select *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)),
                 lambda r, b: xor(r >> 8, step[(xor(r, b) & 255) + 1])), 4294967295) % 20 as kind
  from named, poly
), left_over as (
  select coalesce(conv_id::varchar, '') as conv, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when kind = 3 then [0, 1] else [0] end) as copy
  from hit where kind <> 0
), placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i from left_over
), judged as (
  select *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare,
         row_number() over (partition by conv, role, text order by i) as nth,
         lag(left(role, 1)) over (partition by conv order by i) as before
  from placed
), faults as (
  select *, case when bare = '' then 1 when nth > 1 then 2 when right(bare, 1) in ('.', '!', '?') then 0 else 3 end as fault
  from judged
), counts as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (where fault = 1) as blank, count(*) filter (where fault = 2) as duplicate,
         count(*) filter (where fault = 3) as truncated,
         count(*) filter (where i > 1 and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from faults group by conv
), moves(g, initial, h) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), given(initial, role) as (
  values ('u', 'user'), ('a', 'assistant')
), one as (
  select g, h, role || ':' as line from moves join given using (initial)
), gap as (
  select g, g as h, 0 as cost, '' as label, []::varchar[] as lines from (values (0), (1), (2), (3)) s(g)
  union all select g, h, 3, 'I', [line] from one
  union all select a.g, b.h, 6, 'II', [a.line, b.line] from one a join one b on a.h = b.g
), reads as (
  select conv, i, g, g as h, 4 as cost, 'D' as label, []::varchar[] as lines from faults, (values (0), (1), (2), (3)) s(g)
  union all
  select conv, i, g, h, case when fault = 3 then 3 else 0 end, 'K', [role || ':' || text]
  from faults join (select * from moves union all select g, '', g from (values (0), (1), (2), (3)) s(g)) m on m.initial = left(role, 1)
  where fault in (0, 3)
  union all
  select conv, i, g, h, case when fault = 3 then 6 else 3 end, 'R', [given.role || ':' || text]
  from faults, moves join given using (initial) where fault in (0, 3)
), walk as (
  select conv, 0::bigint as i, h as g, {'cost': cost::bigint, 'audit': label, 'lines': lines} as best
  from (select distinct conv from faults), gap where gap.g = 0
  union all
  select w.conv, r.i, gap.h, min({'cost': w.best.cost + r.cost + gap.cost, 'audit': w.best.audit || r.label || gap.label,
                                  'lines': list_concat(w.best.lines, r.lines, gap.lines)})
  from walk w join reads r on r.conv = w.conv and r.i = w.i + 1 and r.g = w.g join gap on gap.g = r.h
  group by w.conv, r.i, gap.h
), repaired as (
  select conv, min(best) as best from walk join counts using (conv) where i = n and g in (0, 3) group by conv
)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id, coalesce(conv_id::varchar, '') as conv from conversations) a
left join counts c on c.conv = a.conv left join repaired r on r.conv = a.conv
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": _VECTORS,
        "op7_url_filter": _URL,
        "op10_line_dedup": _LINES,
        "op11_importance_resampling": _RESAMPLE,
        "op13_conversation_repair": _REPAIR,
    }
