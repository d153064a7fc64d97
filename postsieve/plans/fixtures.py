"""Views over the given tables with the shapes that the operators take, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels pages conversations".split()

#: Arrival order without a sort of all rows: 60 bits of an MD5 over the whole row.
_SEQ = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), cast(round(l_discount * 100) as bigint), cast(round(l_tax * 100) as bigint), cast(l_shipdate as date), l_returnflag, l_linestatus)"

VIEWS = {
    "f_postings": f"""
        select {{hash60:{_SEQ}}} as seq, p_brand as company, p_name as title, n_name as location,
          case when l_linenumber = 6 then null else d.text end as description,
          cast(floor(l_extendedprice * 0.8) as bigint) as salary_min, cast(floor(l_extendedprice) as bigint) as salary_max,
          case l_returnflag when 'A' then 'linkedin' when 'N' then 'greenhouse-' || lower(replace(p_brand, '#', '')) else 'hackernews' end as source,
          case when l_linenumber % 5 = 0 then null else l_shipdate end as posted_at
        from (select *, l_partkey % (select max(doc_id) + 1 from documents) as doc_key from lineitem) li
        join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey left join documents d on d.doc_id = doc_key""",
    # The same postings with the key of their description in its stead.
    "f_posting_keys": f"""
        select {{hash60:{_SEQ}}} as seq, p_brand as company, p_name as title, n_name as location, case when l_linenumber = 6 then null else doc_key end as doc_key,
          cast(floor(l_extendedprice * 0.8) as bigint) as salary_min, cast(floor(l_extendedprice) as bigint) as salary_max,
          case l_returnflag when 'A' then 'linkedin' when 'N' then 'greenhouse-' || lower(replace(p_brand, '#', '')) else 'hackernews' end as source,
          case when l_linenumber % 5 = 0 then null else l_shipdate end as posted_at
        from (select *, l_partkey % (select max(doc_id) + 1 from documents) as doc_key from lineitem) li
        join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey""",
    "f_requirements": """
        select seq, kind, n, lo, case kind when 0 then 'wants ' || cast(n as string) || '+ years' when 1 then 'at least ' || cast(n as string) || ' years'
          when 2 then cast(lo as string) || '-' || cast(n as string) || ' years of experience' when 3 then 'with over ' || cast(n as string) || ' years of experience'
          else cast(n as string) || ' years of cloud experience' end as text
        from (select p_partkey as seq, p_partkey % 5 as kind, 1 + p_size % 12 as n, cast(floor((1 + p_size % 12) / 2.0) as int) as lo from part) q""",
    "f_audit": """
        select event_id as id, 'user' || cast(user_id as string) as job_fingerprint,
          case event_type when 'error' then 'stage_h1b' when 'view' then 'stage1_title' when 'click' then 'stage1_desc' else 'stage2_score' end as stage,
          case when event_type = 'purchase' then 'DAILY' else 'REJECT' end as verdict, event_type as reason,
          case when event_type in ('purchase', 'signup') then 1 + event_id % 5 else null end as confidence, cast(ts as date) as run_date, ts as created_at from events""",
    "f_feedback": """
        select o_orderkey as id, c_mktsegment as company, o_orderpriority || case when o_orderkey % 3 = 0 then ' (Remote)' else '' end as title,
          case c_nationkey % 4 when 0 then 'linkedin' when 1 then 'greenhouse-acme' when 2 then 'workday-acme' else null end as source,
          nullif(o_custkey % 6, 0) as screen_confidence, 'angle' || cast(o_orderkey % 3 as string) as resume_angle, substring(cast(cast(o_orderdate as date) as string), 1, 10) as date_applied,
          case when o_orderstatus = 'F' and o_orderkey % 7 = 0 then 'interview' when o_orderstatus = 'F' and o_orderkey % 7 = 1 then 'reached_out' when o_orderstatus = 'P' then 'skipped' when o_orderkey % 5 = 0 then 'rejected' else 'applied' end as outcome,
          case when o_orderkey % 4 = 0 then null else '["p' || cast(o_orderkey % 5 as string) || '","p' || cast(o_custkey % 5 as string) || '"]' end as projects_used,
          case o_orderkey % 3 when 0 then 'core' when 1 then 'it_identity' else null end as admission
        from orders join customer on o_custkey = c_custkey""",
    "f_usage": """
        select event_id as id, ts, nullif(event_type, 'error') as purpose, cast(floor(value * 100) as bigint) as input_tokens, cast(floor(value * 37) as bigint) as output_tokens, value / 100 as cost_usd from events""",
    "f_employers": """
        select p_partkey as seq, p_brand || case p_partkey % 6 when 0 then ', Inc.' when 1 then ' (Labs)' when 2 then ' Global Services' when 3 then ' | Partner' when 4 then ', a Widget Company' else '' end as company, p_brand as brand from part""",
    "f_filers": """
        select distinct 'H-1B' as visa_class, case when p_size % 5 = 0 then 'Denied' else 'Certified' end as case_status, upper(p_brand) || ' HOLDINGS LLC' as employer_name, case when p_size = 7 then p_type else null end as trade_name_dba
        from part where p_brand in ('Brand#12', 'Brand#3', 'Brand#21', 'Brand#25')""",
    "f_replies": """
        select d.doc_id, cast(floor(d.doc_id / 8.0) as bigint) as batch_no, case when l.doc_id % 11 = 0 then null else d.doc_id % 8 end as idx, 'doc' || cast(d.doc_id as string) as fingerprint,
          case when toxic = 1 then '9' when quality = 1 then '4' when l.doc_id % 2 = 0 then 'n/a' else '0' end as confidence, case when l.doc_id % 13 = 0 then 150 else l.doc_id % 100 end as interview_likelihood, d.doc_id as seq
        from labels l join documents d on d.doc_id = l.doc_id""",
    "f_jd_lines": """
        select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 as pos,
          case l_linenumber when 1 then 'Requirements:' when 3 then 'Nice to have:' when 5 then 'Benefits:' else '- ' || p_name || case when l_quantity > 40 then ' preferred' else '' end end as line
        from lineitem join part on l_partkey = p_partkey""",
}

#: As many keys as a real lexicon has, by a rule: pairs of syllables, together or apart.
LARGE_LEXICON = {f"{a}_{b}": f"{a}{b}|{b}[- ]{a}s?" for a in "tion ment ing the and of re er st an".split() for b in "ou en le ti ha on es nd at ea sh th wh ch ng".split()}


def _for(sql: str, spark: bool) -> str:
    hash60 = (lambda x: f"cast(conv(substr(md5({x}), 1, 15), 16, 10) as bigint)") if spark else (lambda x: f"cast('0x' || substr(md5({x}), 1, 15) as bigint)")
    return re.sub(r"\{hash60:(.*?)\}", lambda m: hash60(m[1]), sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame, with only the tables that it names."""
    sql = _for(VIEWS[name], True)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b(?! d\b| l\b)", rf"\1 {{{t}}} {t}", sql)
        sql = re.sub(rf"\b(from|join) {t}\b(?= (?:d|l)\b)", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **used)


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL: ``body`` after the fixture views that it uses."""
    return ("with " + ", ".join(f"{v} as ({_for(VIEWS[v], False)})" for v in views) + "\n" if views else "") + body
