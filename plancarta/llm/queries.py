"""The opN_<name> queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import chat_format, conversations_as_records, digest
from .common import table
from .simhash import simhash_groups
from .lines import line_dedup
from .html import extract
from .embeddings import embedding_groups
from .mixing import mix, sizes
from .packing import pack
from .quality import quality_rules
from .langid import language_id
from .substring import substring_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sizes(table(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return digest(chat_format(conversations_as_records(rows))).drop("fingerprint")


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op6_mixing": op6_mixing,
    "op4_chat_format": op4_chat_format,
    "op7_embeddings": op7_embeddings,
    "op5_html": op5_html,
    "op3_line_dedup": op3_line_dedup,
    "op10_simhash": op10_simhash,
}

_OP1 = r"""with d as (select doc_id, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x<>'') as w from documents),
 n as (select doc_id, i, array_to_string(w[i:i+12], ' ') as s from (select doc_id, w, unnest(range(1, len(w)-11)) as i from d)),
 f as (select s, min(doc_id) as lo from n group by 1),
 g as (select doc_id, list(distinct p) as gone from (select doc_id, i+k as p from n join f using (s), (select unnest(range(13)) as k) where doc_id>lo) group by 1),
 r as (select doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id))
 select doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(array_to_string(list_filter(w, lambda x, j: not list_contains(gone, j)), ' ')) as kept_sha256 from r"""

_ESCAPED = r"replace(replace(replace(replace(replace(replace(replace({0},'\','\e'),'<s>','\ls>'),'</s>','\l/s>'),'[INST]','\bINST]'),'[/INST]','\b/INST]'),'[ROLE]','\bROLE]'),'[/ROLE]','\b/ROLE]')"
_SHOWN = f"""case when role='user' then concat('<s>[INST] ', {_ESCAPED.format('text')}, ' [/INST]</s>') when role='assistant' then concat('<s>', {_ESCAPED.format('text')}, '</s>')
 else concat('<s>[ROLE] ', {_ESCAPED.format('role')}, ' [/ROLE]', {_ESCAPED.format('text')}, '</s>') end"""
_OP4 = f"""with r as (select conv_id, turn, coalesce(role,'') as role, coalesce(text,'') as text from conversations union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
 select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn nulls first, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (where role='assistant'),0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role='assistant'),'')) as loss_sha256,
 sum(length({_SHOWN}))::bigint as formatted_chars from r group by 1"""

_OP7 = """with recursive e as (select a.vec_id as a, b.vec_id as b from embeddings a join embeddings b on a.vec_id<>b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[])>=0.9),
 w as (select vec_id as v, vec_id as r from embeddings union select e.b, w.r from w join e on e.a=w.v),
 c as (select v, min(r) as r from w group by 1)
 select vec_id, (select count(*) from e where e.a=vec_id) as n_links, r as component_id, r=vec_id as kept from embeddings join c on v=vec_id"""

_OP3 = r"""with l as (select doc_id, unnest(string_split(coalesce(text,''), chr(10))) as line, unnest(range(len(string_split(coalesce(text,''), chr(10))))) as j from documents),
 s as (select doc_id, j, line, t, len(t) as n from (select *, list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x<>'')) as t from l)),
 u as (select doc_id, j, n, unnest(t) as w from s),
 r as (select *, row_number() over (partition by doc_id, j order by c, w) as k from u join (select w, count(*) as c from u group by 1) using (w)),
 p as (select doc_id, j, n, w from r where k <= n - ceil(0.8*n-1e-9) + 1),
 c as (select distinct a.doc_id as ad, a.j as aj, b.doc_id as bd, b.j as bj from p a join p b using (w) where b.n>=0.8*a.n-1e-9 and a.n>=0.8*b.n-1e-9 and (b.doc_id<a.doc_id or b.doc_id=a.doc_id and b.j<a.j)),
 g as (select ad as doc_id, list(distinct aj) as gone from (select ad, aj, len(list_intersect(a.t, b.t)) as i, a.n+b.n as m from c join s a on a.doc_id=ad and a.j=aj join s b on b.doc_id=bd and b.j=bj) where i>=(m-i)*0.8-1e-9 group by 1),
 d as (select doc_id, text, string_split(coalesce(text,''), chr(10)) as w, coalesce(gone, []) as gone from documents left join g using (doc_id))
 select doc_id, case when len(gone)=0 then text else array_to_string(list_filter(w, lambda x, i: not list_contains(gone, i-1)), chr(10)) end as text, len(w)::bigint as n_lines, len(gone)::bigint as n_removed from d"""

#: DuckDB SQL, for the operators that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_line_dedup": _OP3, "op4_chat_format": _OP4, "op7_embeddings": _OP7}
