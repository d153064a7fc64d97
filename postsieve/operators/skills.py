"""Weighted skills of postings, and the ranking of a project pool against them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import Lexicon
from .picks import Pool, lazy_picks

# Weights, and the shapes of section headers and of inline preferences.
DEFAULT_WEIGHT, PREFERRED_WEIGHT, TITLE_BOOST, REPEAT_DISCOUNT, MENTION_CAP, IDF_FLOOR = 0.8, 0.5, 2.0, 0.7, 4, 0.1
ROLE_HEADER = r"about (the|this) (role|job|position|opportunity)"
ZERO_HEADER = (
    r"^(about\b|benefits|perks|what we offer|equal (employment )?opportunity|eeo\b|compensation|pay (range|transparency)|salary|base pay|why (join|work)"
    r"|our (values|culture|mission|story)|life at|who we are|additional information|disclaimer|accommodation|total rewards)"
)
PREFERRED_HEADER = r"preferred|nice[- ]to[- ]have|bonus|desired|pluses|good to have|a plus|extra credit"
REQUIRED_HEADER = (
    r"requirement|qualification|must[- ]have|what you('| wi)ll (need|do|bring)|what we('re| are) looking for|you (have|bring|will)|responsibilit|skills"
    r"|experience|your impact|the role|day[- ]to[- ]day"
)
PREFERRED_INLINE = r"preferred|nice[- ]to[- ]have|\ba plus\b|\bbonus\b|desirable"


def extract_skills(text: Column, lexicon: Mapping[str, str]) -> Column:
    """Keys of the patterns that occur in the lower-cased text, in the lexicon's order; one scan tells which of them may (``lexicon.Lexicon``)."""
    return Lexicon(lexicon).present(F.lower(F.coalesce(text, F.lit(""))))


def count_skills(text: Column, lexicon: Mapping[str, str]) -> Column:
    """Map of key to number of mentions, those above 0."""
    return Lexicon(lexicon).counted(F.lower(F.coalesce(text, F.lit(""))))


def title_hints(title: Column, hints: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Skills that words of the title imply."""
    t = F.lower(title)
    empty = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.array(*[F.when(t.rlike(p), F.array(*map(F.lit, skills))).otherwise(empty) for p, skills in hints]))) if hints else empty


def clean_line(line: Column) -> Column:
    text = F.lower(F.regexp_replace(F.regexp_replace(line, r"[*#_`>\\]+", ""), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(text, ":+$", ""), r"(?U)^\s+|\s+$", "")


def header_weight(clean: Column) -> Column:
    """The section weight that a header line sets; null for lines that set none."""
    header = (F.length(clean) <= 60) & (F.size(F.split(clean, r"\s+")) <= 7) & ~F.endswith(clean, F.lit(".")) & ~clean.rlike(r"^(?:[-•·–◦▪]|\d+[.)])\s*")
    return F.when(header, F.when(clean.rlike(ROLE_HEADER), 1.0).when(clean.rlike(ZERO_HEADER), 0.0).when(clean.rlike(PREFERRED_HEADER), PREFERRED_WEIGHT).when(clean.rlike(REQUIRED_HEADER), 1.0))


def section_weights(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """``lines`` that aren't blank, with ``weight``: that of the last header so far, at most half for an inline preference."""
    clean = lines.withColumn("__c", clean_line(F.col(line))).where("__c <> ''")
    so_far = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.coalesce(F.last(header_weight(F.col("__c")), ignorenulls=True).over(so_far), F.lit(DEFAULT_WEIGHT))
    marked = clean.withColumn("weight", weight)
    return marked.withColumn("weight", F.when(F.col("__c").rlike(PREFERRED_INLINE), F.least("weight", F.lit(PREFERRED_WEIGHT))).otherwise(F.col("weight"))).drop("__c")


#: Where a line ends, as far as Python's own splitter sees it.
LINE_END = r"\R|[\x0b\x0c\x1c-\x1e\x85]"


def description_lines(postings: DataFrame, doc: str, description: str = "description") -> DataFrame:
    return postings.select(doc, F.posexplode(F.split(F.coalesce(description, F.lit("")), LINE_END)).alias("pos", "line"))


def document_frequency(docs: DataFrame, lexicon: Mapping[str, str], text: str = "text", min_chars: int = 200) -> DataFrame:
    """(skill, df, n_docs) over texts longer than ``min_chars``; the documents are counted in the same pass."""
    long = docs.where(F.length(text) > min_chars)
    marked = long.select(F.explode(F.concat(extract_skills(F.col(text), lexicon), F.array(F.lit("")))).alias("skill"))
    counts = marked.groupBy("skill").agg(F.count("*").alias("df"))
    return counts.select("*", F.max(F.when(F.col("skill") == "", F.col("df"))).over(Window.partitionBy(F.lit(0))).alias("n_docs")).where("skill <> ''")  # a row a skill


def idf(df: DataFrame) -> DataFrame:
    return df.select("skill", F.greatest(F.lit(IDF_FLOOR), F.log(F.col("n_docs") / (1 + F.col("df")))).alias("idf"))


def posting_skill_weights(postings: DataFrame, lexicon: Mapping[str, str], idf_table: DataFrame, hints: Sequence[tuple[str, Sequence[str]]] = (), doc: str = "doc_id") -> DataFrame:
    """(doc, skill, weight): idf x best section x mentions, doubled for skills of the title.

    All but the idf is a function of the row: its lines are gone through once, with the weight of the last header and each lexicon key's best
    section so far, so that nothing is shuffled.  Rows that repeat a document give their weights each.
    """
    keys = list(lexicon)
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # a value that several places use is computed once
    described = F.coalesce("description", F.lit(""))
    lines = F.split(described, LINE_END)

    def step(state: Column, line: Column, maybe) -> Column:
        def with_clean(c: Column) -> Column:
            carried = F.coalesce(header_weight(c), state["weight"])
            own = lambda w: F.when(c.rlike(PREFERRED_INLINE), F.least(w, F.lit(PREFERRED_WEIGHT))).otherwise(w)
            weights = bound(F.struct(carried.alias("carried"), F.lower(line).alias("t")), lambda x: F.struct(x["carried"].alias("carried"), own(x["carried"]).alias("own"), x["t"].alias("t")))
            return F.when(c == "", state).otherwise(bound(weights, with_weights))

        def with_weights(x: Column) -> Column:
            hits = F.array(*[F.when(maybe(k), x["t"].rlike(p)).otherwise(False) for k, p in lexicon.items()])
            best = F.zip_with(state["best"], hits, lambda b, hit: F.when(hit, F.greatest(b, x["own"])).otherwise(b))
            return F.struct(x["carried"].alias("weight"), best.alias("best"))

        return bound(clean_line(line), with_clean)

    start = F.struct(F.lit(DEFAULT_WEIGHT).alias("weight"), F.array_repeat(F.lit(-1.0), len(keys)).alias("best"))
    best_sections = lambda _, maybe: F.aggregate(lines, start, lambda state, line: step(state, line, maybe))["best"]
    titled = F.array_union(extract_skills(F.col("title"), lexicon), title_hints(F.col("title"), hints))
    rows = postings.select(doc, Lexicon(lexicon).over(F.lower(described), best_sections).alias("best"), titled.alias("titled"), count_skills(F.concat_ws("\n", "title", described), lexicon).alias("mentions"))
    in_lines = F.filter(F.transform("best", lambda b, i: F.struct(F.get(F.array(*map(F.lit, keys)), i).alias("skill"), b.alias("section"))), lambda x: (x["section"] >= 0) & ~F.array_contains("titled", x["skill"]))
    every = F.concat(in_lines, F.transform("titled", lambda k: F.struct(k.alias("skill"), F.lit(1.0).alias("section"))))
    found = rows.select(doc, "titled", "mentions", F.explode(every).alias("e")).select(doc, "e.*", F.array_contains("titled", F.col("e.skill")).alias("in_title"), F.coalesce(F.col("mentions")[F.col("e.skill")], F.lit(1)).alias("n"))
    own_idf = idf_table.where(F.col("skill").isin(keys)).groupBy("skill").agg(F.max("idf").alias("idf"))  # at most a row a lexicon key
    found = found.where("section > 0").join(F.broadcast(own_idf), "skill", "left")
    reps = 1 + 0.5 * F.log(F.least(F.greatest("n", F.lit(1)), F.lit(MENTION_CAP)).cast("double"))
    weight = F.coalesce("idf", F.lit(1.0)) * F.col("section") * reps * F.when(F.col("in_title"), TITLE_BOOST).otherwise(1.0)
    return found.select(doc, "skill", weight.alias("weight"))


#: Tags of a pool up to which it is broadcast.
MOST_TAGS = 100_000


def project_skill_join(weights: DataFrame, tags: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Posting skills x project tags on equal skills; up to ``MOST_TAGS`` tags, a list that a person keeps, go to where the postings are."""
    few = tags.limit(MOST_TAGS + 1).count() <= MOST_TAGS
    return weights.join(F.broadcast(tags) if few else tags, "skill").select(doc, "id", "skill", "weight", "depth")


#: Projects of a pool that rides along with every posting as a literal; a larger one, up to ``MOST_POOL``, is broadcast with an index of its tags.
MOST_PROJECTS = 200
MOST_POOL = 100_000


def diversified_topk(docs: DataFrame, weights: DataFrame, projects: DataFrame, tags: DataFrame, k: int = 3, doc: str = "doc_id") -> DataFrame:
    """(doc, picks, scores, coverage, uncovered): greedy picks, a skill already covered counting 1 - 0.7 x its covered depth.

    Ties go to profile projects, then to the earlier position in the pool.  Weights are gathered once per posting (at most
    one a lexicon key); a small pool rides along as one literal array, and the k rounds run within the row, without a shuffle.  For
    a larger one they are lazy: scores of an earlier round are upper bounds (``picks``).
    """
    pool = projects.join(tags.groupBy("id").agg(F.collect_list(F.struct("skill", "depth")).alias("tags"), F.sqrt(F.sum(F.col("depth") * F.col("depth"))).alias("norm")), "id")
    listed = sorted(pool.limit(MOST_POOL + 1).collect(), key=lambda r: r.pos)
    if len(listed) > MOST_POOL:
        raise ValueError(f"a pool of more than {MOST_POOL} projects")
    one = lambda r: F.struct(F.lit(r.id).alias("id"), F.lit(1 if r.kind == "profile" else 0).alias("prefer"), F.lit(-r.pos).alias("order"), F.lit(float(r.norm)).alias("norm"), F.map_from_arrays(F.array(*[F.lit(t.skill) for t in r.tags]), F.array(*[F.lit(float(t.depth)) for t in r.tags])).alias("tags"))
    gathered = weights.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("skill", "weight"))).alias("w"))
    state = docs.select(doc).distinct().join(gathered, doc, "left").withColumn("w", F.coalesce("w", F.expr("cast(array() as array<struct<skill: string, weight: double>>)")))
    if len(listed) > MOST_PROJECTS:
        entries = [(r.id, 1 if r.kind == "profile" else 0, r.pos, float(r.norm), {t.skill: float(t.depth) for t in r.tags}) for r in listed]
        shared = docs.sparkSession.sparkContext.broadcast(Pool(entries))
        kind = docs.schema[doc].dataType.simpleString()
        found = state.select(F.col(doc).alias("doc"), "w").mapInArrow(lazy_picks(shared, k, REPEAT_DISCOUNT), f"doc {kind}, picks array<string>, scores array<double>, coverage double, uncovered array<string>")
        return found.withColumnRenamed("doc", doc)
    pool_column = F.array(*[one(r) for r in listed])
    state = state.withColumn("picks", F.expr("cast(array() as array<string>)")).withColumn("scores", F.expr("cast(array() as array<double>)")).withColumn("covered", F.expr("cast(map() as map<string, double>)"))
    for _ in range(min(k, len(listed))):
        def score(p: Column) -> Column:
            return F.aggregate(F.col("w"), F.lit(0.0), lambda s, x: s + F.coalesce(x["weight"] * p["tags"][x["skill"]] * (1 - REPEAT_DISCOUNT * F.coalesce(F.col("covered")[x["skill"]], F.lit(0.0))), F.lit(0.0))) / p["norm"]

        left = F.filter(pool_column, lambda p: ~F.array_contains("picks", p["id"]))
        best = F.array_max(F.transform(left, lambda p: F.struct(score(p).alias("score"), p["prefer"].alias("prefer"), p["order"].alias("order"), p["id"].alias("id"))))
        state = state.withColumn("__b", best)
        tags_of = F.filter(pool_column, lambda p: p["id"] == F.col("__b.id"))[0]["tags"]
        state = state.withColumn("covered", F.map_zip_with("covered", tags_of, lambda s, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))))
        state = state.withColumn("picks", F.array_append("picks", F.col("__b.id"))).withColumn("scores", F.array_append("scores", F.col("__b.score"))).drop("__b")
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["weight"])
    met = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["weight"] * F.least(F.lit(1.0), F.coalesce(F.col("covered")[x["skill"]], F.lit(0.0))))
    open_skills = F.filter("w", lambda x: ~F.map_contains_key("covered", x["skill"]))
    top = F.transform(F.slice(F.array_sort(F.transform(open_skills, lambda x: F.struct((-x["weight"]).alias("o"), x["skill"].alias("skill")))), 1, 8), lambda x: x["skill"])
    return state.select(doc, "picks", "scores", F.when(total > 0, met / total).otherwise(0.0).alias("coverage"), top.alias("uncovered"))


def top_of_map(weights: Column, k: int) -> Column:
    """The k heaviest keys of a map, ties by key."""
    ordered = F.array_sort(F.transform(F.map_entries(weights), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("k"))))
    return F.transform(F.slice(ordered, 1, k), lambda e: e["k"])


def replay_summary(selections: DataFrame) -> DataFrame:
    """Per project the share of selections that hold it, and of those that rank it first; the selections are counted in the same pass."""
    marked = selections.select(F.posexplode(F.concat(F.array(F.lit("")), "picks")).alias("place", "id"))  # the first entry is the selection's own
    counts = marked.groupBy("id").agg(F.count("*").alias("n_picked"), F.count_if(F.col("place") == 1).alias("n_first"))
    n = F.max(F.when(F.col("id") == "", F.col("n_picked"))).over(Window.partitionBy(F.lit(0)))  # a row a project
    return counts.withColumn("share", F.col("n_picked") / n).where("id <> ''")


def replay_overview(selections: DataFrame, top: int = 12) -> DataFrame:
    """(kind, key, n, share): the mean coverage of all selections, and the ``top`` skills among each selection's three heaviest uncovered ones, from one pass."""
    entry = lambda kind, key, value: F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))
    gaps = F.transform(F.slice("uncovered", 1, 3), lambda skill: entry("uncovered", skill, F.lit(None).cast("double")))
    rows = selections.select(F.explode(F.concat(F.array(entry("coverage", F.lit(""), F.col("coverage"))), gaps)).alias("e")).select("e.*")
    counts = rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))  # a row a skill
    every = Window.partitionBy(F.lit(0))
    total = F.max(F.when(F.col("kind") == "coverage", F.col("n"))).over(every)
    placed = counts.select("kind", "key", "n", F.coalesce("mean", F.col("n") / total).alias("share"), F.row_number().over(every.orderBy("kind", F.desc("n"), "key")).alias("r"))
    return placed.where(F.col("r") <= top + 1).drop("r")
