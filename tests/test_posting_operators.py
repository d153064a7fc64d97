"""Cases with known answers, as data."""

from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.functions import dates as D
from postsieve.functions import text as T
from postsieve.operators import dedup, entity, registry, report, rules, skills, state
from postsieve.sources import boards, filings
from postsieve.sources.html import page_text

AS_OF = datetime(2024, 1, 10, 12)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def many(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", column(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("we want 5+ years of it", "5+ years"), ("five or more years", "five or more years"), ("at least 4 years", "at least 4 years"), ("4-6 years", "4-6 years"), ("4\\-6 years", "4-6 years"),
        ("2-5 years of experience", None), ("with over 26 years of experience, we", None), ("6 years of cloud experience", "6 years of cloud experience"), ("3+ years then 8+ years", None), ("35 years of experience", None), ("three years of experience", None), ("", None), (None, None),
    ],
)
def test_experience_stop(spark, text, hit):
    found = one(spark, text, lambda c: rules.experience_stop(c, 4))
    assert found == hit


def test_gate_order_and_reasons(spark):
    cfg = rules.GateConfig(domain_words=("data", "software"), title_exclusions=("senior", "sr.", "vp,"), location_patterns=("india", " uk,"), salary_floor=50_000, description_stops=("top secret",), sponsorship_stops=("no sponsorship",), required_words=("python", "sql", "c++"), required_count=2, min_years=4)
    rows = [
        (1, "Senior Data Engineer", "Pune, India", "x", None), (2, "Sr. Data Engineer", "NY", "x", None), (3, "Nurse", "NY", "x", None), (4, "Data Engineer", "NY", "x", 10), (5, "Data Engineer", None, " \t", None), (6, "Data Engineer", "NY", "TOP SECRET python sql", None),
        (7, "Data Engineer", "NY", "6+ years python sql", None), (8, "Data Engineer", "NY", "python only", None), (9, "Data Engineer", "NY", "python and sql", 60_000), (10, "Metadata Engineer", "NY", "python sql", None), (11, "Software", "NY", "no sponsorship python sql", None),
    ]
    df = spark.createDataFrame(rows, "seq int, title string, location string, description string, salary_max long")
    found = {r.seq: (r.stage, r.reason) for r in rules.rule_gate(df, cfg).collect()}
    stages = ["location", "title", "title_domain", "salary", "no_desc", "desc", "desc", "keywords", "pass", "title_domain", "pass"]
    assert [found[i][0] for i in range(1, 12)] == [f"stage1_{s}" for s in stages]
    assert found[2][1] == "Title exclusion: 'sr.' matched in 'Sr. Data Engineer'" and found[4][1] == "Salary max $10 below floor $50,000" and found[8][1] == "Only 1/2 required keywords found"
    assert {r.stage for r in rules.rule_gate(df.where("seq = 1"), cfg, title_only=True).collect()} == {"stage1_title"}


POSTING = "company string, title string, source string, posted_at timestamp, seq long"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A", " a"]), st.sampled_from(["T", "u"]), st.sampled_from(["linkedin", "x"]), st.sampled_from([None, 0, 20, 30])), max_size=9), st.randoms())
def test_dedup_is_a_fold_in_any_order(spark, rows, rng):
    rows = [(c, t, s, None if h is None else AS_OF - timedelta(hours=h), i) for i, (c, t, s, h) in enumerate(rows)]
    best = {}
    for r in rows:
        key = (r[0].strip().lower(), r[1].lower())
        fresh = (r[3] >= AS_OF - timedelta(hours=24)) if r[3] else r[2] == "linkedin"
        rank = (fresh, r[3] is not None, r[3] or datetime(1, 1, 1), r[4])
        if key not in best or rank > best[key][0]:
            best[key] = (rank, r[4])
    mixed = list(rows)
    rng.shuffle(mixed)
    found = dedup.dedup_prefer_fresh(spark.createDataFrame(mixed, POSTING), AS_OF, 24, ["linkedin"])
    assert {r.seq for r in found.collect()} == {s for _, s in best.values()}


def test_freshness_bound(spark):
    rows = [("a", "t", "x", AS_OF - timedelta(hours=24), 1), ("a", "t", "x", AS_OF - timedelta(hours=24, seconds=1), 2), ("a", "t", "x", None, 3), ("a", "t", "linkedin", None, 4), ("a", "t", None, None, 5)]
    fresh, stale = dedup.split_fresh(spark.createDataFrame(rows, POSTING), AS_OF, 24, ["linkedin"])
    assert {r.seq for r in fresh.collect()} == {1, 4} and {r.seq for r in stale.collect()} == {2, 3, 5}


@pytest.mark.parametrize(
    ("name", "forms"),
    [
        ("NTT Data North America", ["ntt data north america", "ntt data north", "ntt data"]), ("NVIDIA AI", ["nvidia ai", "nvidia"]), ("Hakkoda, an IBM Company", ["hakkoda"]), ("N2 Lab | Partner", ["n2 lab"]), ("Foo Holdings Inc.", ["foo holdings"]), ("Amazon.com", ["amazoncom", "amazon com"]), ("AT&T", ["at t"]),
        ("Inc.", []), ("Walmart Global Tech", ["walmart global tech", "walmart global", "walmart"]), ("Data Labs", ["data labs"]), ("IBM Cloud", ["ibm cloud"]), ("Accenture Federal Services (US)", ["accenture federal services", "accenture federal", "accenture"]),
    ],
)
def test_query_ladder(spark, name, forms):
    assert one(spark, name, entity.query_ladder) == forms


def test_prefix_match_and_inheritance(spark):
    filers = spark.createDataFrame([("amazoncomservices",), ("ab",), ("ibm",)], "key string")
    queries = spark.createDataFrame([("amazon",), ("ab",), ("a",), ("ib",), ("ibm",), ("",), ("zoncom",)], "q string")
    assert {r.q for r in entity.prefix_match(queries, "q", filers).collect()} == {"amazon", "ab", "ibm"}
    names = spark.createDataFrame([("amazon web services",), ("amazon",), ("allied staffing",), ("data labs",), ("ibm cloud",)], "n string")
    verified = spark.createDataFrame([("amazon",), ("allied motion",), ("data",), ("ibm",)], "company_key string")
    assert {r.n for r in entity.inherit_verdict(names, "n", verified).collect()} == {"amazon web services"}


def test_resolve_without_an_index(spark):
    rows = spark.createDataFrame([("Amazon Web Services",), ("Other",), ("Inc.",)], "company string")
    cache = spark.createDataFrame([("amazon", True, AS_OF)], "company_key string, verified boolean, checked_at timestamp")
    assert {r.company: r.verified for r in entity.resolve_sponsor(rows, cache, None, AS_OF).collect()} == {"Amazon Web Services": True, "Other": None, "Inc.": None}


def test_states_are_idempotent(spark):
    target = spark.createDataFrame([("a", 1, "old")], "k string, seq int, v string")
    rows = spark.createDataFrame([("a", 2, "x"), ("b", 4, " "), ("b", 3, "y"), ("c", 5, None)], "k string, seq int, v string")
    new = state.append_new(target, rows, "k")
    assert sorted((r.k, r.seq) for r in new.collect()) == [("b", 3), ("c", 5)]
    assert state.append_new(target.union(new), rows, "k").count() == 0
    merged = state.merge_latest(target, rows, "k", "v")
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", "x"), ("b", "y"), ("c", None)]
    assert sorted(merged.collect()) == sorted(state.merge_latest(merged, rows, "k", "v").collect(), key=lambda r: r.k)


def test_outcomes(spark):
    feedback = spark.createDataFrame([(1, "A", "T", "applied"), (2, "a ", "t", "applied"), (3, "B", "T", "applied")], "id int, company string, title string, outcome string")
    materials = spark.createDataFrame([(1, "A", "T", "Rejected"), (2, "B", "T", "Ready to Apply")], "seq int, company string, title string, status string")
    tracker = spark.createDataFrame([(1, "A", "T", "Interview"), (2, "C", "T", "Offer"), (3, "B", "T", " ")], "seq int, company string, title string, status string")
    assert sorted((r.id, r.outcome) for r in state.apply_outcomes(feedback, materials, tracker).collect()) == [(1, "interview"), (2, "interview"), (3, "applied")]


def test_ranking_discounts_what_is_covered(spark):
    weights = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.9), (2, "z", 1.0)], "doc_id int, skill string, weight double")
    projects = spark.createDataFrame([("p", "p", "catalog", 0), ("q", "q", "catalog", 1), ("r", "r", "profile", 2)], "id string, name string, kind string, pos int")
    tags = spark.createDataFrame([("p", "a", 1.0), ("q", "a", 1.0), ("r", "b", 1.0)], "id string, skill string, depth double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    found = {r.doc_id: r for r in skills.diversified_topk(docs, weights, projects, tags, 2).collect()}
    assert found[1].picks == ["p", "r"] and found[1].coverage == pytest.approx(1.0) and found[1].uncovered == []
    assert found[2].picks == ["r", "p"] and found[2].uncovered == ["z"] and found[3].coverage == 0


def test_section_weights(spark):
    lines = ["intro text about python", "Requirements:", "- python", "- go preferred", "Nice to have", "- rust", "About us", "- perks python", "About the role", "- sql", "A long line that ends with a full stop and so is no header."]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, pos int, line string")
    assert [r.weight for r in skills.section_weights(df).orderBy("pos").collect()] == [0.8, 1.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0, 1.0, 1.0, 1.0]


def test_scalars(spark):
    assert many(spark, ["3", "9", "0", "2.9", "true", "x", None, "NaN"], T.clean_confidence) == [3, 5, 1, 2, None, None, None, None]
    assert many(spark, ["acmeCorp-labs", "IBM_cloud", "x"], T.humanize_token) == ["Acme Corp Labs", "IBM Cloud", "X"]
    assert many(spark, ["a/b: c?", "  x   y. ", "-"], T.slugify) == ["ab-c", "x-y", ""]
    assert many(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02", "soon", None], D.parse_iso) == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 1, 4, 5), datetime(2024, 1, 2), None, None]
    assert many(spark, ["Posted Today", "Posted Yesterday", "Posted 30+ Days Ago", "x"], lambda c: D.parse_relative(c, F.lit(AS_OF))) == [AS_OF, AS_OF - timedelta(days=1), AS_OF - timedelta(days=30), None]
    assert many(spark, ["say ```json\n{\"a\": 1}\n``` ok", "x [1, 2] y", "none"], T.json_from_reply) == ['{"a": 1}', "[1, 2]", None]
    assert one(spark, ["A", "b", "a", "B"], T.dedup_tokens, "array<string>") == ["A", "b"]
    assert one(spark, {"a": 1.0, "b": 3.0, "c": 3.0}, lambda c: skills.top_of_map(c, 2), "map<string, double>") == ["b", "c"]


def test_skill_items(spark):
    rows = ["AWS (EC2, S3)", "Ansible (RH294 certified)", "Java (Spring Boot)", "JavaScript/TypeScript", "TCP/IP", "**Go; rust**", "go", "Foo (Bar) baz", "a/b/c/d"]
    found = one(spark, rows, T.normalize_skill_items, "array<string>")
    assert found == ["AWS", "AWS EC2", "AWS S3", "Ansible", "Java", "Spring Boot", "JavaScript", "TypeScript", "TCP/IP", "**Go**", "rust", "Foo baz"]
    assert one(spark, [], T.normalize_skill_items, "array<string>") == []


def test_sanitize(spark):
    texts = ["a \u2014 b \u2022 c", "p99 <1s and >50% of <b>", "R&D & more", "\ufb01ve \u2265 3", "caf\u00e9", None]
    assert many(spark, texts, T.sanitize_ascii) == ["a - b, c", "p99 under 1s and over 50% of b", "R&D and more", "five at least 3", "caf", None]


def test_slugs(spark):
    assert one(spark, "The Acme Widgets, Inc. (NY)", T.slug_candidates) == ["acmewidgets", "AcmeWidgets", "acme", "Acme"]
    assert one(spark, "LLC", T.slug_candidates) == []


def test_registry(spark):
    cands = spark.createDataFrame([("a", "s", date(2024, 1, 1), date(2024, 1, 1), 2, 0)], "tenant string, server string, first_seen date, last_seen date, n_seen int, promotion_attempts int")
    found = spark.createDataFrame([("a", "s"), ("b", "t"), ("b", "t"), ("C", "u"), ("", "v"), (None, "w")], "tenant string, server string")
    out = registry.merge_candidates(cands, found, spark.createDataFrame([("c",)], "tenant string"), spark.createDataFrame([], "tenant string"), date(2024, 2, 1))
    assert sorted((r.tenant, r.n_seen, r.last_seen) for r in out.collect()) == [("a", 3, date(2024, 2, 1)), ("b", 1, date(2024, 2, 1))]


def test_sources(spark):
    raw = spark.createDataFrame([("t", None, '{"jobs": [{"title": "Dev", "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "location": {"name": "NY"}, "updated_at": "2024-01-02T00:00:00Z"}, {"title": " ", "location": "LA"}]}'), ("u", "U", "[]"), ("v", None, "broken")], "token string, name string, payload string")
    rows = boards.normalize_greenhouse(raw).collect()
    assert [(r.title, r.company, r.location, r.source) for r in rows] == [("Dev", "t", "NY", "greenhouse-t")]
    feed = spark.createDataFrame([('[{"legal": "x"}, {"position": "Dev", "company": "C", "salary_min": 0, "salary_max": 9, "epoch": "86400"}]',)], "payload string")
    r = boards.normalize_remoteok(feed).first()
    assert (r.title, r.location, r.salary_min, r.salary_max, r.posted_at) == ("Dev", "Remote", None, 9, datetime(1970, 1, 2))
    ashby = spark.createDataFrame([("t", None, '{"jobs": [{"title": "Dev", "applyUrl": "u", "publishedDate": "2024-01-05", "descriptionHtml": "<p>Hi</p>"}]}')], "token string, name string, payload string")
    r = boards.normalize_ashby(ashby).first()
    assert (r.url, r.description, r.posted_at) == ("u", "Hi", datetime(2024, 1, 5))
    ok, bad = boards.split_errors(raw, "jobs array<struct<title: string>>")
    assert bad.count() == 1 and ok.count() == 2


def test_filer_index_round_trip(spark, tmp_path):
    path = str(tmp_path / "index")
    filings.write_filer_index(spark.createDataFrame([("b",), ("a",), ("a",), ("",)], "key string"), path, date(2024, 1, 1), ["q1"])
    assert sorted(r.key for r in filings.read_filer_index(spark, path).collect()) == ["a", "b"]
    assert filings.read_filer_index(spark, str(tmp_path / "none")) is None
    filings.write_filer_index(spark.createDataFrame([], "key string"), path, date(2024, 1, 1), [])
    assert filings.read_filer_index(spark, path) is None


def test_pages():
    wanted = frozenset({".job-description", "article"})
    body = "word " * 20
    assert page_text(f"<html><script>no</script><nav>no</nav><p>{body}</p></html>", wanted) == body.strip()
    assert page_text(f"<div>out</div><div class='x job-description'><p>{body}</p></div>", wanted) == body.strip()
    assert page_text("<p>short</p>", wanted) is None and page_text(None, wanted) is None


def test_reports(spark):
    rows = spark.createDataFrame([("a", "interview"), ("a", "applied"), (None, "offer")], "k string, outcome string")
    found = {r.key: (r.apps, r.callbacks, r.low_n) for r in report.rate_table(rows, "k").collect()}
    assert found == {"a": (2, 1, True), "None": (1, 1, True)}
    assert [(r.confidence, r.n) for r in report.score_breakdown(spark.createDataFrame([(5,), (None,)], "confidence int")).orderBy("confidence").collect()] == [(None, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1)]
    picks = spark.createDataFrame([(["p", "q"],), (["p"],)], "picks array<string>")
    assert {r.id: (r.n_picked, r.n_first, r.share) for r in skills.replay_summary(picks).collect()} == {"p": (2, 2, 1.0), "q": (1, 0, 0.5)}


def test_first_balanced_json(spark):
    from postsieve.functions import text as T

    cases = [
        ('{"a": 1}', '{"a": 1}'), ('a {"a":1} and {"b":2} end', '{"a":1}'), ('```json\n{"a": [1, 2]}\n```', '{"a": [1, 2]}'), ('x ```\n[1]\n``` {"b": 1}', "[1]"),
        ('see {"t": "} \\" ]", "u": {"v": []}} }', '{"t": "} \\" ]", "u": {"v": []}}'), ("[1, [2]] x", "[1, [2]]"), ("{cut", None), ("{bad} {\"a\": 1}", None), ("none", None), ("", None), (None, None), ("```json\n```", None), ('é {"k": "ü😀{"} z', '{"k": "ü😀{"}'),
    ]
    found = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string").select("i", T.json_from_reply(F.col("c")).alias("j")).collect()
    assert {r.i: r.j for r in found} == {i: want for i, (_, want) in enumerate(cases)}


def test_detail_url(spark):
    from postsieve.functions import dates as D

    cases = {
        "https://acme.wd5.myworkdayjobs.com/Jobs/job/Lima/Dev_R1": "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Jobs/job/Lima/Dev_R1",
        "https://acme.wd12.myworkdayjobs.com/en-US/Jobs/job/x": "https://acme.wd12.myworkdayjobs.com/wday/cxs/acme/Jobs/job/x",
        "https://acme.wd12.myworkdayjobs.com/EN-gb/Jobs/job/x": "https://acme.wd12.myworkdayjobs.com/wday/cxs/acme/Jobs/job/x",
        "https://acme.example.com/Jobs/job/x": None, "https://acme.wd5.myworkdayjobs.com/Jobs": None, "": None,
    }
    found = spark.createDataFrame([(u,) for u in cases], "u string").select("u", D.detail_url(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in found} == cases


def test_blank_descriptions_agree_in_gate_and_funnel(spark):
    from datetime import datetime

    from postsieve.operators import report, rules

    rows = [("widget", "a", "x", d, None, "linkedin", None) for d in ("\n \t\n", "\u00a0\u2003", "", None, "text", " \n y")]
    df = spark.createDataFrame(rows, "title string, company string, location string, description string, salary_max long, source string, posted_at timestamp")
    gated = rules.rule_gate(df, rules.GateConfig(domain_words=("widget",)))
    assert gated.where("stage = 'stage1_no_desc'").count() == 4
    row = report.funnel(gated, datetime(2000, 1, 1), 24, ("linkedin",)).first()
    assert (row.with_description, row.without_description, row.passed, row.written, row.below_cutoff, row.sponsor_dropped) == (2, 4, 2, 2, 0, 0)


def test_batches_do_not_depend_on_the_parts(spark, monkeypatch):
    from postsieve.operators import reconcile

    df = spark.createDataFrame([(i * i, "a" if i % 3 else None, "d" * 9) for i in range(60)], "seq long, source string, description string")
    found = []
    for parts in (1, 7, 4096):
        monkeypatch.setattr(reconcile, "STRETCHES", parts)
        found.append(sorted((r.seq, r.batch_no, r.idx) for r in reconcile.batch_index(df, 4, chars=5).collect()))
    assert found[0] == found[1] == found[2]
    assert [x for x in found[0] if x[0] % 9 == 0] == [((3 * i) ** 2, i // 4, i % 4) for i in range(20)]
    assert reconcile.batch_index(df.limit(0)).count() == 0
