"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from postsieve.functions.text import ASCII_MARKS

from .fixtures import LARGE_LEXICON, VIEWS, oracle

_FP = "lower(trim(company)) || '||' || lower(trim(title))"
_FRESH = "case when posted_at is not null then posted_at >= timestamp '2000-12-01 00:00:00' else source in ('linkedin', 'indeed', 'google') end"
_LATEST = f"latest as (select * from (select *, {_FP} as fp, {_FRESH} as fresh, row_number() over (partition by {_FP} order by ({_FRESH}) desc, (posted_at is not null) desc, posted_at desc nulls last, seq desc) as rn from f_postings) where rn = 1)"
_STAGE = """case when contains(lower(location), 'nation_1') then 'stage1_location' when regexp_matches(lower(title), '\\bold\\b') then 'stage1_title'
  when not regexp_matches(lower(title), '\\b(widget|gear|bolt|ring)\\b') then 'stage1_title_domain' when coalesce(salary_max < 20000, false) then 'stage1_salary'
  when description is null or trim(description, ' \t\n') = '' then 'stage1_no_desc' else 'stage1_pass' end"""
_REASON = """case stage when 'stage1_location' then 'Excluded location: ''' || location || '''' when 'stage1_title' then 'Title exclusion: ''old'' matched in ''' || title || ''''
  when 'stage1_title_domain' then 'No domain keyword in title: ''' || title || '''' when 'stage1_salary' then 'Salary max $' || format('{:,}', salary_max) || ' below floor $20,000'
  when 'stage1_no_desc' then 'No description' else 'Passed all rules' end"""
_SCORED = "scored as (select *, case when seq % 7 = 0 then null else cast(seq % 5 + 1 as int) end as confidence, cast(seq % 101 as int) as interview_likelihood from f_postings)"
_BEST = f"best as (select *, {_FP} as fp from scored qualify row_number() over (partition by {_FP} order by coalesce(confidence, 0) desc, seq) = 1)"
_VERDICT = "case seq % 3 when 0 then true when 1 then false else null end"
_DROPPABLE = "(source in ('linkedin', 'indeed', 'google') or source like 'workday-%' or source like 'greenhouse-%' or source like 'lever-%' or source like 'ashby-%')"
#: Documents with every letter and digit beyond ASCII as an x, as DuckDB's word boundary only knows ASCII.
_PLAIN_DOCS = "docs as (select doc_id, length(text) as n_text, regexp_replace(lower(coalesce(text, '')), '[^\\x00-\\x7F\\P{L}]|[^\\x00-\\x7F\\P{N}]', 'x', 'g') as text from documents)"
_SINCE = "timestamp '2024-01-26 00:00:00'"
_KNOWN = f"known as (select job_fingerprint from f_audit where id % 3 = 0 and created_at >= {_SINCE} union select job_fingerprint from f_audit where created_at >= {_SINCE} union select job_fingerprint from f_audit where reason = 'purchase')"
_RATES = "count(*) as apps, count(*) filter (outcome in ('phone_screen', 'interview', 'offer')) as callbacks, count(*) filter (outcome in ('phone_screen', 'interview', 'offer', 'reached_out')) as positives"
_APPLIED = "applied as (select * from f_feedback where outcome <> 'skipped')"
_CALLED = "outcome in ('phone_screen', 'interview', 'offer')"
_STATUS = "list_element(['Applied', 'Interview', ' ', 'Ready to Apply', 'Ghosted', 'Reached Out'], cast(id % 6 + 1 as int))"
_MAPPED = "case lower(trim(status)) when 'phone screen' then 'phone_screen' when 'reached out' then 'reached_out' when 'no response' then 'no_response' else lower(trim(status)) end"
_FULL_DOMAIN = "widget|gear|bolt|ring|plate"
_FAMILY = f"case when regexp_matches(t, '\\bplate\\b') and not regexp_matches(t, '\\b(widget|gear|red)\\b') then null when regexp_matches(t, '\\b({_FULL_DOMAIN})\\b') then 'core' when regexp_matches(t, '\\brod\\b') and not regexp_matches(t, '\\bblue\\b') then 'it_identity' end"
_EXCLUDED = "case when regexp_matches(t, '\\bold\\b') then 'old' when regexp_matches(t, '\\bgreen\\b') then 'green ' end"


_FULL_FAMILY, _FULL_EXCLUDED = _FAMILY.replace("(t,", "(lower(title),"), _EXCLUDED.replace("(t,", "(lower(title),")
_SUPPORT = " + ".join(f"regexp_matches(lower(title) || ' ' || coalesce(lower(description), ''), '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')::int" for w in ("the", "of", "and", "widget"))


def _with(views: str, ctes: list[str], body: str) -> str:
    """Fixture views, further common tables, then the query."""
    head = oracle("", *views.split()) if views else ""
    joined = ", ".join(ctes)
    if not head:
        return f"with {joined}\n{body}" if joined else body
    return head.rstrip() + (f", {joined}\n" if joined else "\n") + body


_CLEAN_LINE = "trim(rtrim(trim(lower(regexp_replace(line, '[*#_`>\\\\]+', '', 'g'))), ':'))"
_SECTIONS = f"""lines as (select *, {_CLEAN_LINE} as c from f_jd_lines), heads as (select *, case when length(c) <= 60 and c not like '%.' and not regexp_matches(c, '^[-•]')
  then case when c like 'benefits%' then 0.0 when c like '%nice to have%' then 0.5 when c like '%requirement%' then 1.0 end end as h from lines where c <> ''),
  carried as (select *, coalesce(last_value(h ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row), 0.8) as w from heads),
  sections as (select doc_id, pos, line, cast(case when c like '%preferred%' or c like '%nice to have%' then least(w, 0.5) else w end as double) as weight from carried)"""
_NOUNS = "(values ('widget'), ('gear'), ('bolt'), ('ring'), ('rod'), ('plate'), ('anvil'), ('gizmo')) as n(skill)"
_WEIGHTS = f"""{_SECTIONS}, jd as (select doc_id, 'gear engineer' || chr(10) || string_agg(lower(line), chr(10) order by pos) as body, string_agg(lower(line), chr(10) order by pos) as lines_only from f_jd_lines group by doc_id),
  freq as (select skill, count(*) as df, (select count(*) from jd where length(lines_only) > 0) as n from jd, {_NOUNS} where regexp_matches(lines_only, '\\b' || skill || '\\b') group by skill),
  in_lines as (select doc_id, skill, max(weight) as section from sections, {_NOUNS} where regexp_matches(lower(line), '\\b' || skill || '\\b') group by all),
  every as (select doc_id, skill, section, false as titled from in_lines where skill not in ('gear', 'rod') union all select doc_id, t, 1.0, true from jd, (values ('gear'), ('rod')) as x(t)),
  weights as (select e.doc_id, e.skill, greatest(0.1, ln(f.n / (1 + f.df))) * e.section * (1 + 0.5 * ln(least(greatest(len(regexp_extract_all(j.body, '\\b' || e.skill || '\\b')), 1), 4))) * case when titled then 2.0 else 1.0 end as weight
    from every e join jd j using (doc_id) join freq f using (skill) where e.section > 0)"""

_EMPLOYER = """cleaned as (select *, regexp_replace(regexp_replace(regexp_replace(company, '\\s*[\\(\\[][^\\)\\]]*[\\)\\]]', ' ', 'g'), '\\s*(\\||,\\s*(an?|part of)\\s+).*$', ''), ',\\s*Inc\\.?$', '') as stripped from f_employers),
  named as (select *, trim(stripped) as name, trim(regexp_replace(regexp_replace(lower(trim(stripped)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as spaced from cleaned),
  keyed as (select *, spaced as key, replace(spaced, ' ', '') as filer_key from named)"""
_FILERS = """filers as (select distinct replace(lower(replace(regexp_replace(name, ' LLC$', '', 'i'), '#', ' ')), ' ', '') as key from (select unnest([employer_name, trade_name_dba]) as name from f_filers where case_status like 'Certified%') where name is not null)"""
_TENANT = "regexp_extract(url, '^https?://([^./]+)\\.([^./]+)\\.example\\.(com|net|org)', {})"

#: What the query appends to each document, so that marks, signs and a ligature are in it.
_SUFFIX = " || ' \u2014 \u201cq\u201d at least  2 \u2265 5 \ufb01n \u2026 > 5 & more , x <b> < $3'"


def _sanitized(t: str) -> str:
    """Marks, signs, ampersands, then other characters: composition is that of the suffix's one ligature, as documents hold no other."""
    for mark, plain in ASCII_MARKS.items():
        quoted = plain.replace("'", "''")
        t = f"replace({t}, '{mark}', '{quoted}')"
    for pattern, plain in (("(at (?:least|most) )\\s+", "\\1"), ("<\\s*([\\d$.])", "under \\1"), (">\\s*([\\d$.])", "over \\1"), ("[<>]", " "), ("\\s+&\\s+", " and "), ("\ufb01", "fi"), ("[^\\x00-\\x7F]", " "), ("\\s+([,;])", "\\1"), ("[ \t]{2,}", " "), ("^\\s+|\\s+$", "")):
        t = f"regexp_replace({t}, '{pattern}', '{plain}', 'g')"
    return f"select doc_id, md5({t}) as digest from documents"


_POOL = "pool(id, pos, prefer) as (values ('p0', 0, 1), ('p1', 1, 0), ('p2', 2, 0), ('p3', 3, 0), ('p4', 4, 1)), tags(id, skill, depth) as (values ('p0', 'widget', 1.0::double), ('p0', 'gear', 0.5), ('p1', 'widget', 1.0), ('p1', 'bolt', 1.0), ('p2', 'ring', 1.0), ('p2', 'rod', 0.5), ('p2', 'gear', 0.2), ('p3', 'plate', 1.0), ('p3', 'anvil', 1.0), ('p3', 'gizmo', 0.5), ('p4', 'gizmo', 1.0), ('p4', 'ring', 0.2)), norms as (select id, sqrt(sum(depth * depth)) as norm from tags group by id)"


def _rounds(k: int) -> str:
    """Greedy picks, one round after the other: the score of each project that is left, the best, and what is covered then."""
    out = ["docs as (select distinct doc_id from f_jd_lines), cov0 as (select null::bigint as doc_id, null::varchar as skill, 0.0::double as cov where false), picks0 as (select null::bigint as doc_id, null::varchar as id, 0 as r where false)"]
    for r in range(1, k + 1):
        p = r - 1
        out.append(f"score{r} as (select d.doc_id, p.id, p.pos, p.prefer, coalesce(sum(w.weight * t.depth * (1 - 0.7 * coalesce(c.cov, 0))), 0) / any_value(n.norm) as score from docs d cross join pool p join norms n on n.id = p.id join tags t on t.id = p.id left join weights w on w.doc_id = d.doc_id and w.skill = t.skill left join cov{p} c on c.doc_id = d.doc_id and c.skill = t.skill where not exists (select 1 from picks{p} x where x.doc_id = d.doc_id and x.id = p.id) group by d.doc_id, p.id, p.pos, p.prefer)")
        out.append(f"picks{r} as (select * from picks{p} union all select doc_id, id, {r} from (select * from score{r} qualify row_number() over (partition by doc_id order by round(score, 11) desc, prefer desc, pos) = 1))")
        out.append(f"cov{r} as (select x.doc_id, t.skill, max(t.depth) as cov from picks{r} x join tags t using (id) group by all)")
    return ", ".join(out)


_PICKED = f"{_WEIGHTS}, {_POOL}, {_rounds(3)}, judged as (select d.doc_id, w.skill, w.weight, c.cov, row_number() over (partition by d.doc_id, c.cov is null order by w.weight desc, w.skill) as nth from docs d join weights w using (doc_id) left join cov3 c on c.doc_id = w.doc_id and c.skill = w.skill), summed as (select doc_id, sum(weight * least(1.0, coalesce(cov, 0))) / sum(weight) as coverage, string_agg(skill, ',' order by nth) filter (cov is null and nth <= 8) as uncovered from judged group by doc_id), selections as (select x.doc_id, string_agg(id, ',' order by r) as picks, any_value(coalesce(s.coverage, 0)) as coverage, any_value(coalesce(s.uncovered, '')) as uncovered from picks3 x left join summed s using (doc_id) group by x.doc_id)"

ORACLES: dict[str, str] = {
    "funnel_slice": _with("f_postings", [_LATEST], f"select stage, count(*) as n from (select case when fresh then {_STAGE} else 'stale' end as stage from latest) group by stage"),
    "dedup_prefer_fresh": _with("f_postings", [_LATEST], "select fp, seq, source, salary_max, posted_at from latest"),
    "split_fresh": _with("f_postings", [], f"select seq, source, {_FRESH} as fresh from f_postings"),
    "title_gate": f"select title, family, exclusion, exclusion is null and family is not null as passes, count(*) as n from (select p_name as title, {_FAMILY} as family, {_EXCLUDED} as exclusion from (select p_name, lower(p_name) as t from part)) group by all",
    "rule_gate": _with("f_postings", [], f"select seq, stage, {_REASON} as reason from (select *, {_STAGE} as stage from f_postings)"),
    "rule_gate_full": _with(
        "f_postings",
        [
            _LATEST,
            f"marked as (select *, lower(description) as dl, {_FULL_FAMILY} as family, {_FULL_EXCLUDED} as excluded, {_SUPPORT} as n from latest)",
            """staged as (select *, case when contains(lower(location), 'nation_1') or contains(lower(location), 'nation_20') then 'stage1_location' when excluded is not null then 'stage1_title'
              when family is null then 'stage1_title_domain' when coalesce(salary_max < 20000, false) then 'stage1_salary' when description is null or trim(description, ' \t\n') = '' then 'stage1_no_desc'
              when contains(dl, 'apache license') or contains(dl, 'trash') then 'stage1_desc' when n < 3 then 'stage1_keywords' else 'stage1_pass' end as stage from marked)""",
        ],
        """select fp, stage, case when stage = 'stage1_title' then 'Title exclusion: ''' || excluded || ''' matched in ''' || title || ''''
          when stage = 'stage1_desc' then 'Description hard-stop: ''' || case when contains(dl, 'apache license') then 'apache license' else 'trash' end || ''''
          when stage = 'stage1_keywords' then 'Only ' || n || '/3 required keywords found' else """ + _REASON + " end as reason from staged",
    ),
    "stale_verdicts": _with("f_employers", ["named as (select seq, seq % 6 as kind, company, lower(replace(brand, '#', ' ')) as b, cast(substr(brand, 7) as int) % 2 = 1 as odd from f_employers)", "cache as (select distinct case when kind in (0, 2) then b || ' global services' else b end as company_key, company as company_raw, kind, b, odd from named where not (kind = 5 and odd))", "yes as (select distinct b from named where kind = 5 and odd)"], "select company_key, company_raw, (select count(*) from named n where n.seq % 4 < 3 and case when n.kind = 2 then n.b || ' global services' else n.b end = company_key) as n_drops from cache where kind = 0 or (kind = 2 and b in (select b from yes))"),
    "title_only_gate": _with("f_postings", [], "select case when regexp_matches(lower(title), '\\bold\\b') then 'stage1_title' when not regexp_matches(lower(title), '\\b(widget|gear|bolt|ring)\\b') then 'stage1_title_domain' else 'stage1_pass' end as stage, count(*) as n from f_postings where description is null or trim(description, ' \t\n') = '' group by 1"),
    "experience_stop": _with("f_requirements", [], "select seq, kind, case when kind = 0 and n >= 4 then n || '+ years' when kind = 1 and n >= 4 then 'at least ' || n || ' years' when kind = 2 and lo >= 4 then lo || '-' || n || ' years' when kind = 4 and n >= 4 then n || ' years of cloud experience' end as stop from f_requirements"),
    "promote_filled": _with("f_postings", [_LATEST, "pending as (select * from latest where description is null or trim(description, ' \t\n') = '')", "details as (select title, max(description) as d from f_postings where seq % 3 = 0 and description is not null and trim(description, ' \t\n') <> '' group by title)", "filled as (select p.* replace (d.d as description) from pending p join details d using (title))"], f"select fp, {_STAGE} as stage from filled union all select fp, 'pending' from pending anti join details using (title)"),
    "sponsor_drops": _with("f_postings", [_LATEST], f"select source, verified, verified is not distinct from false and {_DROPPABLE} as gone, count(*) as n from (select *, {_VERDICT} as verified from latest) group by all"),
    "sponsor_stats": _with("f_postings", [_LATEST], f"select count(verified) as checked, count(*) filter (verified) as verified, count(*) filter (not verified and {_DROPPABLE}) as dropped, count(*) filter (not verified and not {_DROPPABLE}) as kept_unverified from (select source, {_VERDICT} as verified from latest)"),
    "funnel_counts": _with("f_postings", [_LATEST], f"select count(*) as scraped, count(*) filter (fresh) as fresh, count(*) filter (not fresh) as stale, count(*) filter (fresh and gone) as sponsor_dropped, count(*) filter (here and has) as with_description, count(*) filter (here and not has) as without_description, count(*) filter (here and ok) as passed, count(*) filter (here and not ok) as rejected, count(*) filter (here and ok and low) as below_cutoff, count(*) filter (here and ok and not low) as written from (select *, fresh and not gone as here, stage = 'stage1_pass' as ok from (select fresh, coalesce(trim(description, ' \t\n'), '') <> '' as has, {_STAGE} as stage, seq % 3 = 1 and regexp_matches(source, '^(linkedin|indeed|google)$|^(workday-|greenhouse-|lever-|ashby-)') as gone, seq % 7 <> 0 and seq % 5 + 1 < 3 as low from latest))"),
    "route_scored": _with("f_postings", [_SCORED], "select case when confidence is null then 'UNSCORED' when confidence >= 3 then 'DAILY' else 'REJECT' end as route, confidence is null or confidence >= 3 as daily, confidence, count(*) as n from scored group by all"),
    "dedup_best_confidence": _with("f_postings", [_SCORED, _BEST], "select fp, seq, confidence from best"),
    "top_scored": _with("f_postings", [_SCORED], "select seq, confidence, interview_likelihood from scored order by coalesce(confidence, 0) desc, interview_likelihood desc, seq limit 1"),
    "order_daily": _with("f_postings", [_SCORED, _BEST], "select seq, confidence, interview_likelihood from best"),
    "score_breakdown": _with("f_postings", [_SCORED], "select cast(l as int) as confidence, coalesce(n, 0) as n from (select unnest([1, 2, 3, 4, 5]) as l) left join (select confidence, count(*) as n from scored group by 1) on l = confidence union all select confidence, count(*) from scored where confidence is null group by 1"),
    "daily_rows": _with("f_postings", [_SCORED, _BEST, "aged as (select *, greatest(epoch(timestamp '2000-12-02') - epoch(posted_at), 0) as s from best)"], f"select company, title, location, confidence, '' as status, interview_likelihood as interview_score, replace(title, ' ', ', ') as risk_flags, 'https://p.example/' || seq as apply_link, case when posted_at is null then '' when s < 60 then 'just now' when s < 3600 then cast(floor(s / 60) as bigint) || 'm ago' when s < 86400 then cast(floor(s / 3600) as bigint) || 'h ago' else cast(floor(s / 86400) as bigint) || 'd ago' end as posted, source, title as reasoning, null::varchar as suggested_angle, split_part(title, ' ', 1) as match_signals, case {_VERDICT} when true then 'Verified sponsor' when false then 'No H-1B history' else 'Unknown' end as sponsorship, case when salary_min <> 0 and salary_max <> 0 then '$' || format('{{:,}}', salary_min) || ' - $' || format('{{:,}}', salary_max) when salary_min <> 0 then '$' || format('{{:,}}', salary_min) || '+' else '' end as salary_range, '' as notes from aged"),
    "below_cutoff_audit": _with("f_postings", [_SCORED], "select company, title, 'stage2_score' as stage, 'Confidence ' || confidence || '/5 (Daily needs 3+): ' || title as reason, source, 'https://p.example/' || seq as url from scored where confidence < 3"),
    "batch_index": _with("f_postings", [], "select seq, source, cast(floor(r / 8) as bigint) as batch_no, cast(r % 8 as int) as idx from (select seq, source, row_number() over (partition by source order by seq) - 1 as r from f_postings)"),
    "reconcile_replies": _with("f_replies", [], "select d.doc_id, case when ok then case r.confidence when '9' then 5 when '4' then 4 when '0' then 1 end end as confidence, case when ok then r.interview_likelihood end as interview_likelihood, coalesce(ok, false) as scored from documents d left join (select *, interview_likelihood between 0 and 100 as ok from f_replies) r using (doc_id)"),
    "clean_confidence": _with("f_replies", [], "select doc_id, case confidence when '9' then 5 when '4' then 4 when '0' then 1 end as confidence, interview_likelihood between 0 and 100 as valid from f_replies"),
    "known_keys": _with("f_audit", [_KNOWN], "select job_fingerprint from known"),
    "drop_known": _with("f_audit", [_KNOWN], "select 'user' || c_custkey as key, c_custkey from customer where 'user' || c_custkey not in (select job_fingerprint from known)"),
    "known_subset": _with("f_audit", [], "select 'user' || c_custkey as key from customer where 'user' || c_custkey in (select job_fingerprint from f_audit)"),
    "append_new": _with("f_postings", [f"rows as (select *, {_FP} as fp from f_postings)"], "select fp, coalesce(min(seq) filter (seq % 3 = 0), min(seq)) as seq from rows group by fp"),
    "merge_in_parts": _with(
        "f_postings",
        [f"rows as (select seq, {_FP} as fp, case when seq % 5 <> 0 then source else ' ' end as note from f_postings)", "one as (select fp, min(seq) as seq, arg_min(note, seq) as first, max(case when trim(note) <> '' then {'s': seq, 'v': note} end).v as said from rows where seq % 2 = 0 group by fp)",
         "two as (select fp, min(seq) as seq, arg_min(note, seq) as first, max(case when trim(note) <> '' then {'s': seq, 'v': note} end).v as said from rows where seq % 2 = 1 and fp like 'brand#1%' group by fp)"],
        "select coalesce(one.fp, two.fp) as fp, coalesce(one.seq, two.seq) as seq, coalesce(two.said, one.said, one.first, two.first) as note from one full join two on one.fp = two.fp",
    ),
    "merge_latest": _with("f_postings", [f"rows as (select {_FP} as fp, seq, source, cast(length(description) as varchar) as description from f_postings)", "base as (select fp, min(seq) as seq from rows where source = 'hackernews' group by fp)", "firsts as (select fp, seq from base union all select fp, min(seq) from rows where fp not in (select fp from base) group by fp)", "filled as (select fp, max_by(description, seq) as d from rows where description is not null group by fp)"], "select f.fp, f.seq, r.source, coalesce(d.d, r.description) as description from firsts f join rows r using (fp, seq) left join filled d on d.fp = f.fp"),
    "upsert_verdict": "with cache as (select 'k' || user_id as company_key, event_type = 'purchase' as verified, ts as checked_at from events where event_type <> 'view'), latest as (select * from cache qualify row_number() over (partition by company_key order by checked_at desc, verified desc) = 1) select * from latest where date_diff('day', cast(checked_at as date), date '2024-01-31') < case when verified then 30 else 7 end",
    "apply_outcomes": _with("f_feedback", [f"sheet as (select id as seq, company, title, {_STATUS} as status from f_feedback)", "both_sheets as (select *, 0 as p from sheet where seq % 2 = 0 union all select *, 1 from sheet where seq % 5 = 0)", f"said as (select {_FP} as fp, max_by({_MAPPED}, p * 1000000000000 + seq) as o from both_sheets where trim(status) <> '' and lower(trim(status)) <> 'ready to apply' group by 1)"], f"select id, coalesce(o, outcome) as outcome from (select *, {_FP} as fp from f_feedback) left join said using (fp)"),
    "promote_applied": _with("f_feedback", [f"sheet as (select id as seq, company, title, {_STATUS} as status, date_applied as generated, {_FP} as fp from f_feedback)"], "select cast(generated as date) as date_applied, company, title, 'Remote' as location, '' as apply_link, '' as status, cast(generated as date) + 7 as follow_up, 'No' as follow_up_sent, '' as notes, cast(seq % 5 as int) as confidence from (select * from sheet where seq % 2 = 0 and seq % 5 <> 0 and status = 'Applied' qualify row_number() over (partition by fp order by seq) = 1) where fp not in (select fp from sheet where seq % 5 = 0 and company like 'B%')"),
    "pending_generation": _with("f_feedback", [f"sheet as (select id as seq, company, title, {_STATUS} as status, {_FP} as fp from f_feedback)"], "select seq, company, title from sheet where seq % 5 = 0 and fp not in (select fp from sheet where seq % 2 = 0 and seq % 11 = 0 and status = 'Ready to Apply')"),
    "select_status": _with("f_feedback", [f"sheet as (select id as seq, {_STATUS} as status from f_feedback where id % 2 = 0)"], "select seq, case status when 'Applied' then 'applied' else 'ready' end as kind from sheet where status in ('Applied', 'Ready to Apply')"),
    "frequency_json": _with("f_postings", ["c as (select company, count(*) as n from f_postings group by 1 order by 2 desc, 1 limit 100)"], "select '{' || string_agg('\"' || company || '\":' || n, ',' order by company) || '}' as json from c"),
    "feedback_rows": _with("f_feedback", [], "select id, '[\"p' || id % 5 || '\"]' as projects_used, case when id % 2 = 0 then 'core' end as admission, cast(null as double) as coverage from f_feedback"),
    "attach_descriptions": _with("f_postings", [f"texts as (select {_FP} as fp, max(description) as d from f_postings group by 1)"], "select p_partkey, md5(nullif(d, '')) as digest from part left join texts on fp = lower(p_brand) || '||' || lower(p_name)"),
    "applied_with_description": _with("f_postings", ["pairs as (select distinct lower(p_brand) || '||' || lower(p_name) as fp, p_name as title from part where '2000-0' || (p_size % 9 + 1) || '-01' >= '2000-05-01')"], f"select fp as job_fingerprint, title, count(distinct description) as n from pairs join (select {_FP} as fp, description from f_postings where length(description) > 200) using (fp) group by all"),
    "distinct_filers": _with("f_filers", [_FILERS], "select key from filers"),
    "prefix_match": _with("f_filers f_employers", [_FILERS], "select distinct brand, replace(lower(brand), '#', '') as q from f_employers where exists (select 1 from filers where starts_with(key, replace(lower(brand), '#', '')))"),
    "clean_company": "with e as (select p_partkey as seq, p_brand || case when p_partkey % 6 = 2 then ' Global Services' else '' end as name, 'brand ' || substr(p_brand, 7) as key, p_partkey % 6 = 2 as long from part) select seq, name, key || case when long then ' global services' else '' end as key, replace(key, ' ', '') || case when long then 'globalservices' else '' end as filer_key, case when long then key || ' global services|' || key || ' global|' || key else key end as forms from e",
    "inherit_verdict": "select distinct 'brand ' || substr(p_brand, 7) || ' global services' as name from part where p_partkey % 6 = 2 and p_brand like '%1'",
    "resolve_sponsor": _with("f_filers f_employers", [_FILERS], "select brand, company, brand = 'Brand#7' or exists (select 1 from filers where starts_with(key, replace(lower(brand), '#', ''))) as verified, count(*) as n from f_employers group by all"),
    "merge_candidates": f"with p as (select page_id, {_TENANT.format(1)} as tenant, {_TENANT.format(2)} as server from pages), o as (select tenant, min(server) as server from p where page_id % 2 = 0 and tenant <> '' group by 1), f as (select tenant, min(server) as server from p where page_id % 3 = 0 and tenant <> '' and tenant not in (select tenant from p where page_id = 1) group by 1) select coalesce(o.tenant, f.tenant) as tenant, coalesce(o.server, f.server) as server, case when o.tenant is null then date '2024-02-01' else date '2024-01-01' end as first_seen, case when f.tenant is not null then date '2024-02-01' else date '2024-01-02' end as last_seen, cast(case when o.tenant is null then 1 when f.tenant is null then 3 else 4 end as int) as n_seen, cast(case when o.tenant is null then 0 else 1 end as int) as promotion_attempts from o full join f on o.tenant = f.tenant",
    "text_scalars": _with("f_feedback", [], "select id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) as norm, regexp_replace(substring(regexp_replace(regexp_replace(trim(replace(company || ' / ' || title, '/', '')), ' +', '-', 'g'), '-+', '-', 'g'), 1, 50), '[-. ]+$', '') as slug, substring(title, 1, 7) as cut, coalesce(lower(split_part(source, '-', 1)), 'unknown') as family, case outcome when 'interview' then 'call' else outcome end as mapped, case outcome when 'applied' then 'Applied' else replace(outcome, '_', ' ') end as label from f_feedback"),
    "section_weights": _with("f_jd_lines", [_SECTIONS], "select doc_id, pos, weight from sections"),
    "extract_skills": f"with {_PLAIN_DOCS}, k(skill) as (values ('the'), ('of'), ('tion'), ('and'), ('rights'), ('license'), ('apache'), ('version')) select doc_id, coalesce(string_agg(skill, ',' order by skill) filter (regexp_matches(text, '\\b' || skill || '\\b')), '') as skills from docs, k group by doc_id",
    "count_skills": f"with {_PLAIN_DOCS}, k(skill) as (values ('the'), ('of'), ('tion'), ('and'), ('rights'), ('license'), ('apache'), ('version')) select doc_id, skill, cast(len(regexp_extract_all(text, '\\b' || skill || '\\b')) as int) as n from docs, k where regexp_matches(text, '\\b' || skill || '\\b')",
    "document_frequency": f"with {_PLAIN_DOCS}, k(skill) as (values ('the'), ('of'), ('tion'), ('and'), ('rights'), ('license'), ('apache'), ('version')), n as (select count(*) as n_docs from docs where n_text > 200) select skill, count(*) as df, any_value(n_docs) as n_docs, round(greatest(0.1, ln(any_value(n_docs) / (1 + count(*)))), 9) as idf from docs, k, n where n_text > 200 and regexp_matches(text, '\\b' || skill || '\\b') group by skill",
    "posting_skill_weights": _with("f_jd_lines", [_WEIGHTS], "select doc_id, skill, round(weight, 9) as weight from weights"),
    "project_skill_join": "with tags(id, skill, depth) as (values ('p0', 'widget', 1.0), ('p0', 'gear', 0.5), ('p1', 'widget', 1.0), ('p1', 'bolt', 1.0), ('p2', 'ring', 1.0), ('p2', 'rod', 0.5), ('p2', 'gear', 0.2), ('p3', 'plate', 1.0), ('p3', 'anvil', 1.0), ('p3', 'gizmo', 0.5), ('p4', 'gizmo', 1.0), ('p4', 'ring', 0.2)) select id, skill, count(*) as n, round(sum(p_size * cast(depth as double)), 6) as score from tags join part on skill = split_part(p_name, ' ', -1) group by all",
    "replay_summary": _with("f_jd_lines", [_PICKED], "select id, count(*) as n_picked, count(*) filter (r = 1) as n_first, round(count(*) / (select count(*) from docs), 9) as share from picks3 group by id"),
    "audit_rows": _with("f_postings", [f"gated as (select *, {_FP} as fp, {_STAGE} as stage from f_postings)"], "select fp as job_fingerprint, stage, 'REJECT' as verdict, date '2000-12-02' as run_date, count(*) as n from gated where stage <> 'stage1_pass' group by all"),
    "failed_only": "select event_id, event_type in ('error', 'view') as failed from events",
    "dedup_tokens": "with t as (select p_brand, lower(p_type) as k, min(p_partkey) as m from part group by all) select p_brand, string_agg(case when m % 2 = 0 then upper(k) else k end, ',' order by m) as tokens from t group by p_brand",
    "humanize_token": "select p_partkey, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' Board ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') as name from part",
    "skill_items": "select p_partkey, p_type || '|Blue|AWS|AWS EC2|aa|bb|cc|CI/CD|**xx**|yy' as items from part",
    "sanitize_ascii": _sanitized("text" + _SUFFIX),
    "sanitize_ascii_full": _sanitized("text"),
    "slug_candidates": "select distinct company, array_to_string(case when rest = '' then [lower(j), j, 'brand', 'Brand'] else [lower(j), j, 'brand', 'Brand', 'brand' || w2, 'Brand' || w2] end, '|') as tokens from (select *, 'Brand' || w2 || rest as j, 'Brand' || w2 || rest as c from (select p_brand || case p_partkey % 6 when 0 then ', Inc.' when 1 then ' (Labs)' when 2 then ' Global Services' when 3 then ' | Partner' when 4 then ', a Widget Company' else '' end as company, substr(p_brand, 7) as w2, case when p_partkey % 6 = 2 then 'GlobalServices' else '' end as rest from part))",
    "keyword_coverage": "with f as (select doc_id, lower(regexp_replace(replace(coalesce(text, ''), '*', ''), '\\s+', ' ', 'g')) as t from documents), m as (select doc_id, list_filter(['the', 'rights', 'Apache'], lambda k: not contains(t, lower(k))) as x from f) select doc_id, round(1 - len(x) / 3.0, 9) as share, array_to_string(x, ',') as missing from m",
    "dedup_outcomes": _with("f_feedback", [], "select id, company, outcome from f_feedback qualify row_number() over (partition by lower(company), trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) order by case outcome when 'offer' then 6 when 'interview' then 5 when 'phone_screen' then 4 when 'reached_out' then 3 when 'rejected' then 2 when 'no_response' then 1 else 0 end desc, id) = 1"),
    "rate_by_family": _with("f_feedback", [_APPLIED], f"select coalesce(lower(split_part(source, '-', 1)), 'unknown') as key, {_RATES}, round(callbacks / apps, 9) as callback_rate, round(positives / apps, 9) as positive_rate, apps < 30 as low_n from applied group by 1"),
    "rate_by_project": _with("f_feedback", [_APPLIED, "spread as (select outcome, unnest(coalesce(cast(cast(projects_used as json) as varchar[]), [null])) as key from applied)"], f"select coalesce(key, 'None') as key, {_RATES}, count(*) < 30 as low_n from spread group by 1 having count(*) >= 5"),
    "rate_by_title_class": _with("f_feedback", [_APPLIED], f"select case when title ilike '%urgent%' then 'urgent' when title ilike '%(remote)%' then 'remote' when title like '2%' then 'high' else 'Other' end as key, {_RATES} from applied group by 1"),
    "feedback_summary": _with("f_feedback", [_APPLIED, "spread as (select 'source' as dimension, source as key, outcome from applied union all select 'resume_angle', resume_angle, outcome from applied union all select 'confidence', cast(screen_confidence as varchar), outcome from applied union all select 'admission', admission, outcome from applied where admission is not null union all select 'project', unnest(cast(cast(projects_used as json) as varchar[])), outcome from applied)"], f"select dimension, key, count(*) as applied, cast(count(*) filter ({_CALLED}) as bigint) as callbacks, round(count(*) filter ({_CALLED}) / count(*), 9) as rate from spread group by all"),
    "project_usage": _with("f_feedback", [], f"select project, count(*) as used, count(*) filter ({_CALLED}) as callbacks from (select unnest(cast(cast(projects_used as json) as varchar[])) as project, outcome from f_feedback) group by 1"),
    "before_after": _with("f_feedback", [_APPLIED], f"select case when coalesce(date_applied, '') < '1998-01-01' then 'before' else 'after' end as period, {_RATES} from applied group by 1"),
    "outcome_counts": _with("f_feedback", [], "select outcome, count(*) as n, min(date_applied) as first, max(date_applied) as last from f_feedback group by 1"),
    "feedback_by_date": _with("f_feedback", [], "select id, substring(date_applied, 1, 7) as month, date_applied from f_feedback"),
    "usage_rollup": _with("f_usage", ["spread as (select *, unnest(['all'] || case when ts >= timestamp '2024-01-24' then ['7d'] else [] end || case when ts >= timestamp '2024-01-31' then ['today'] else [] end) as span from f_usage)"], "select span, case when grouping(purpose) = 1 then 'TOTAL' else purpose end as purpose, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, round(sum(cost_usd), 6) as cost_usd from (select * replace (coalesce(purpose, 'other') as purpose) from spread) group by grouping sets ((span, purpose), (span))"),
    "usage_since": _with("f_usage", [], "select count(*) as calls, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens, cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens, round(coalesce(sum(cost_usd), 0), 6) as cost_usd, coalesce(max(id), 0) as high_water from f_usage where id > 100"),
    "stage_counts": _with("f_audit", [], "select stage, verdict, count(*) as n from f_audit where run_date = date '2024-01-10' group by all"),
    "company_frequency": _with("f_postings", [], "select company, count(*) as n from f_postings where length(company) > 2 group by 1 order by 2 desc, 1 limit 10"),
    "apply_log_summary": "with log as (select case event_type when 'error' then 'blocked' when 'purchase' then 'submitted' else event_type end as status, 'r' || user_id % 12 as reason, 'portal' || user_id % 3 as portal from events) select 'status' as kind, status as key, count(*) as n from log group by all union all (select 'reason', reason, count(*) from log where status = 'blocked' group by all order by 3 desc, 2 limit 8) union all select 'portal', portal, count(*) from log where status = 'submitted' group by all",
    "seen_recently": _with("f_audit", [], f"select distinct job_fingerprint from f_audit where created_at >= {_SINCE}"),
    "md_unescape": _with("f_requirements", [], "select seq, text from f_requirements"),
    "date_scalars": "select o_orderkey, cast(cast(o_orderdate as date) as timestamp) + interval '5 hours 6 minutes 7 seconds' as iso, cast(null as timestamp) as bad, date_trunc('second', o_orderdate) as epoch, date_trunc('second', o_orderdate) as millis, timestamp '2000-12-02' - to_days(cast(o_orderkey % 40 as int)) as relative from orders",
    "resolve_location": "select s_suppkey, case when s_suppkey % 3 = 2 then s_name else 'New York - Site ' || s_nationkey end as location from supplier",
    "extract_tenant": f"select page_id, {_TENANT.format(1)} as tenant, {_TENANT.format(2)} as server from pages where {_TENANT.format(1)} <> ''",
    "json_from_reply": "select event_id, case when event_id % 7 in (2, 5, 6) then null else cast(json_extract(props, '$.k') as bigint) end as k from events",
    "discover_tenants": f"select tenant, server from (select page_id, {_TENANT.format(1)} as tenant, {_TENANT.format(2)} as server from pages) where tenant <> '' qualify row_number() over (partition by tenant order by page_id) = 1",
    "decide_candidates": "with r as (select s_suppkey, case s_suppkey % 3 when 0 then true when 1 then false end as alive, s_nationkey % 9 as hits, s_nationkey % 6 as tries from supplier) select s_suppkey, alive, hits, cast(tries + (alive is null)::int as int) as promotion_attempts, case when not alive then 'reject' when alive is null then case when tries + 1 >= 5 then 'reject' else 'retry' end when hits >= 6 then 'promote' when hits = 0 then 'reject' else 'hold' end as decision from r",
    "board_relevance": "select p_brand as board, count(*) as total, count(*) filter (regexp_matches(lower(p_name), '\\b(widget|gear|bolt|ring)\\b') and not contains(lower(p_name), 'old')) as relevant from part group by 1 having relevant >= 1",
    "domain_hits": "select p_brand as board, count(distinct p_name) filter (regexp_matches(lower(p_name), '\\b(widget|gear|bolt|ring)\\b')) as hits from part group by 1",
    "best_board": "with h as (select p_type as kind, p_name as name, p_brand as token, p_size as total, p_partkey % 11 as relevant, p_partkey as seq from part), u as (select * from (select * from h qualify row_number() over (partition by kind, lower(name) order by total desc, seq) = 1) union select * from (select * from h qualify row_number() over (partition by kind, lower(token) order by total desc, seq) = 1)) select kind, token, relevant, total, seq from (select * from u qualify row_number() over (partition by kind, lower(token) order by relevant desc, total desc, seq) = 1) where (kind, token) not in (select (p_type, p_brand) from part where p_size = 7)",
    "repair_names": "select lower(n_name) as token, case when n_nationkey % 2 = 0 then case when lower(n_name) like '%\\_1%' escape '\\' then 'Found' else 'Nation ' || n_nationkey end else 'Named' end as name from nation",
    "validate_registry": "select p_brand as token from part group by 1 having count(*) filter (p_size = 7) > 0",
    "merge_newer_wins": "with n as (select distinct c_nationkey as k from customer where c_acctbal > 9000), o as (select distinct s_nationkey as k from supplier) select k as s_nationkey, 'new' as v from n union all select k, 'old' from o where k not in (select k from n)",
    "classify_tenant": "select n_name as tenant, case when n_regionkey < 2 then 'r' || n_regionkey else 'off_domain' end as reason from nation",
    "pipe_posts": "select p_partkey, p_brand as company, p_name as title, case when p_size % 2 = 0 then p_type else 'Not specified' end as location, 'https://x.example/a' as post_url, 'see https://x.example/a b' as description from part",
    "board_payloads": "select 0 as source_ord, 'greenhouse-' || p_brand as source, p_name as title, p_type as description, p_brand as location, timestamp '2000-01-02 03:04:05' as posted_at, count(*) as n from part where regexp_matches(p_name, '\\b(widget|gear|bolt|ring)\\b') and not regexp_matches(p_name, '\\bold\\b') group by all union all select 1, 'lever-' || p_brand, p_name, p_type, null, timestamp '2000-01-02 03:04:05', count(*) from part group by all",
    "relative_feed": "select 'workday-' || p_brand as source, p_type as location, timestamp '2000-12-02' - to_days(cast(p_size % 4 as int)) as posted_at, count(*) as n from part where p_size % 4 <= 2 group by all",
    "scraped_table": "select c_name as title, case when c_custkey % 2 = 0 then 'Remote' else 'x' end as location, cast(null as varchar) as description, cast(trunc(c_acctbal) as bigint) as salary_min, case when c_custkey % 3 = 0 then null else cast(trunc(c_acctbal) as bigint) end as salary_max, timestamp '2000-01-02' as posted_at from customer where c_custkey % 5 <> 0",
    "latest_thread": "select conv_id as id from conversations where contains(lower(text), 'the') and contains(lower(text), 'of') order by turn desc, conv_id desc limit 1",
    "read_filings": _with("f_filers", [], "select visa_class, case_status, employer_name, trade_name_dba from f_filers"),
    "stream_first_seen": "select distinct cast(user_id as varchar) as key from events",
    "stream_stage_counts": "select cast(ts as date) as day, event_type as stage, case when event_type = 'purchase' then 'DAILY' else 'REJECT' end as verdict, count(*) as n from events group by all",
    "stream_usage": "select cast(d as timestamp) as start, coalesce(nullif(event_type, 'error'), 'other') as purpose, count(*) as calls, cast(sum(cast(floor(value * 100) as bigint)) as bigint) as input_tokens from events, (select unnest(generate_series(date_trunc('day', min(ts)) - interval 7 day, max(ts), interval 1 day)) as d from events) where ts >= d and ts < d + interval 7 day group by all",
    "diversified_topk": _with("f_jd_lines", [_PICKED], "select doc_id, picks, round(coverage, 6) as coverage, uncovered from selections"),
    "replay_overview": _with("f_jd_lines", [_PICKED], "select 'coverage' as kind, '' as key, count(*) as n, round(avg(coverage), 6) as share from selections union all (select 'uncovered', skill, count(*), round(count(*) / (select count(*) from docs), 6) from judged where cov is null and nth <= 3 group by skill order by 3 desc, 2 limit 12)"),
    "outcome_overall": _with("f_feedback", [], f"select {_RATES}, round(callbacks / greatest(count(*), 1), 9) as callback_rate, round(positives / greatest(count(*), 1), 9) as positive_rate, min(date_applied) as first, max(date_applied) as last from f_feedback where outcome <> 'skipped'"),
    "outcome_matches": _with("f_feedback", [f"sheet as (select id as seq, {_FP} as fp, {_STATUS} as status from f_feedback)", f"known as (select distinct {_FP} as fp from f_feedback where company <> 'MACHINERY')", "both_sheets as (select 'materials' as sheet, * from sheet where seq % 2 = 0 union all select 'tracker', * from sheet where seq % 5 = 0)"], "select sheet, count(*) filter (fp in (select fp from known)) as matched, count(*) filter (fp not in (select fp from known)) as unmatched from both_sheets where trim(status) <> '' and lower(trim(status)) <> 'ready to apply' group by sheet"),
    "detail_url": "select page_id, case when page_id % 5 <> 0 then 'https://t' || page_id || '.wd3.myworkdayjobs.com/wday/cxs/t' || page_id || '/Site/job/a/b_1' end as url from pages",
    "candidate_counts": f"with p as (select page_id, {_TENANT.format(1)} as tenant from pages), o as (select distinct tenant from p where page_id % 2 = 0 and tenant <> ''), f as (select distinct tenant from p where page_id % 3 = 0 and tenant <> '' and tenant not in (select tenant from p where page_id = 1)) select count(*) filter (tenant not in (select tenant from o)) as n_new, count(*) filter (tenant in (select tenant from o)) as n_repeat from f",
    "ashby_feed": "select p_name as title, p_brand as company, p_type as location, case when p_size % 2 = 0 then p_name else p_type end as description, 'https://a.example/x' as url, 'ashby-' || p_brand as source, case when p_size % 3 = 0 then timestamp '2000-03-04 05:06:07' else timestamp '2000-01-02' end as posted_at, count(*) as n from part group by all",
    "remote_feed": "select p_name as title, p_brand as company, case when p_size % 2 = 0 then 'Remote' else 'Lima' end as location, p_type as description, case when p_size % 3 = 0 then null else cast(p_size as bigint) end as salary_min, cast(null as bigint) as salary_max, 'remoteok' as source, timestamp '2000-01-02 03:04:05' as posted_at, count(*) as n from part where p_size % 7 <> 0 group by all",
    "union_landed": "select '0' as source, 'rows' as kind, count(*) as n from part where p_brand not like '%1' union all select '1', 'rows', count(*) from part union all select 'ashby', 'payload', count(distinct p_brand) from part where p_brand like '%1' union all select 'gone', 'source', 1",
    "outcome_log": _with("f_feedback", [], "select id, title, outcome from f_feedback"),
    "audit_table": _with("f_postings", [f"gated as (select *, {_FP} as fp, {_STAGE} as stage from f_postings)"], "select fp as job_fingerprint, stage, case when seq % 2 = 0 then date '2000-12-02' else date '2000-12-03' end as run_date, count(*) as n, 0 as n_confidence from gated where stage <> 'stage1_pass' group by all"),
    "stream_split_fresh": "select event_id, case when event_type <> 'view' then ts >= timestamp '2024-01-24' else user_id % 2 = 0 end as fresh from events",
    "stream_verdict_ttl": """with recursive v as (select 'k' || user_id as company_key, event_type <> 'error' as verified, ts, row_number() over (partition by user_id order by ts, event_type <> 'error') as i from events where event_type in ('purchase', 'signup', 'error')),
        chain as (select * from v where i = 1 union all select n.* from (select c.company_key, min(v.i) as i from chain c join v on v.company_key = c.company_key and v.i > c.i and (v.verified <> c.verified or v.ts >= c.ts + case when c.verified then interval 5 days else interval 2 days end) group by c.company_key) x join v n on n.company_key = x.company_key and n.i = x.i)
        select company_key, verified, ts from chain""",
}
_LARGE = "k(skill, p) as (values " + ", ".join(f"('{k}', '{p}')" for k, p in LARGE_LEXICON.items()) + ")"
ORACLES |= {
    "skill_mentions": f"with {_LARGE} select doc_id, skill, cast(len(regexp_extract_all(lower(text), p)) as int) as n from documents, k where regexp_matches(lower(text), p)",
    "skills_present": f"with {_LARGE}, n as (select skill, p, row_number() over () as i from k) select doc_id, coalesce(string_agg(skill, ',' order by i) filter (regexp_matches(lower(coalesce(text, '')), p)), '') as skills from documents, n group by doc_id",
    "top_skills": f"with counts as ({ORACLES['count_skills']}) select d.doc_id, coalesce(s, '') as skills from documents d left join (select doc_id, string_agg(skill, ',' order by n desc, skill) as s from (select *, row_number() over (partition by doc_id order by n desc, skill) as r from counts) where r <= 6 group by doc_id) t on t.doc_id = d.doc_id",
    "filer_index": _with("f_filers", [_FILERS], "select key from filers where key <> ''"),
    "seeded_sample": "select doc_id, lang from documents order by md5(doc_id || ':7'), doc_id limit 20",
    "candidate_tokens": f"""with counts as (select company, count(*) as n from ({VIEWS['f_employers']}) where length(company) > 2 group by company order by n desc, company limit 20), shapes as ({ORACLES['slug_candidates']}),
        each as (select c.company, unnest(string_split(tokens, '|')) as token, generate_subscripts(string_split(tokens, '|'), 1) as pos from counts c join shapes s on s.company = c.company)
        select company, token from (select *, row_number() over (partition by lower(token) order by pos, company desc) as r from each) where r = 1 and lower(token) not in ('brand12', 'brand3')""",
    "landed_feeds": """select 'rows' as kind, p_name as title, p_type as location, sum(case when p_brand like '%1' then 1 else 2 end)::bigint as n from part group by all
        union all select 'files', s, count(distinct p_brand)::varchar, count(distinct p_brand) from part, (values ('ashby'), ('cut')) t(s) where s = 'ashby' or p_brand not like '%1' group by s
        union all select 'errors', 'zipped', count(distinct p_brand)::varchar, count(distinct p_brand) from part union all select 'errors', 'gone', '0', 1
        union all select 'errors', 'cut', count(distinct p_brand)::varchar, count(distinct p_brand) from part where p_brand like '%1'""",
}
