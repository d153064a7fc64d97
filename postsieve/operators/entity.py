"""Organisation names: cleaning, query forms, prefix matching and inherited verdicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions.text import compact

# The words of a legal form, which end a name but never are one; those of generic decoration behind a brand;
# and first words too common to stand for a brand.
LEGAL_WORDS = (
    "inc", "llc", "corp", "corporation", "incorporated", "ltd", "limited", "co", "plc", "llp", "pllc", "lp", "gmbh", "ag", "nv", "bv", "sa", "sas", "srl",
    "spa", "pvt", "pte", "pty", "kk", "ab", "oy", "as", "company",
)
GENERIC_TAILS = (
    "ai", "ml", "cloud", "digital", "tech", "technologies", "technology", "labs", "lab", "studios", "studio", "services", "service", "solutions",
    "systems", "group", "groups", "global", "us", "usa", "america", "americas", "north", "south", "federal", "international", "consulting", "consultancy",
    "partners", "ventures", "media", "network", "networks", "software", "engineering", "products", "product", "platform", "platforms", "enterprises",
    "enterprise", "industries", "worldwide", "team", "careers", "recruiting", "talent", "staffing", "research", "development",
)
UNSAFE_ROOTS = (
    "the", "and", "new", "one", "first", "national", "american", "united", "general", "global", "premier", "advanced", "applied", "integrated",
    "innovative", "creative", "digital", "data", "cloud", "tech", "talent", "stealth", "confidential", "undisclosed", "various", "multiple", "client",
    "jobs", "via", "hiring", "recruiting", "staffing", "consulting", "group", "solutions", "services", "systems", "partners", "labs", "studio", "team",
    "corporation", "corporate", "company", "holdings", "international", "associates", "enterprise", "enterprises", "industries", "management", "capital",
    "ventures", "media", "network", "networks", "software", "technology", "technologies", "engineering", "science", "sciences", "health", "healthcare",
    "financial", "finance", "insurance", "bank", "energy", "security", "research", "institute", "university", "center", "centre", "association",
    "foundation", "prime", "core", "next", "smart",
)
#: Legal words that may end a name, whatever stands before them; "company" may not.
TRAILING_SUFFIXES = "|".join([*LEGAL_WORDS[:-1], r"l\s*l\s*c"])
# A bracketed part of a name, and what follows a brand as its tagline.
BRACKETED = r"\s*[\(\[][^\)\]]*[\)\]]"
TAGLINE = r"(?is)\s*(?:\||,\s*(?:an?|part of)\s+|\s+-\s+|\s+–\s+|\s+—\s+).*$"
MIN_ROOT = 4
MAX_FORMS = 4


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once for the row: an expression that is used twice would be evaluated twice, and nested ones over and over."""
    return F.transform(F.array(value), body)[0]


def clean_company(c: Column) -> Column:
    """Without brackets, taglines and up to three legal suffixes; never emptied by a suffix."""
    name = F.regexp_replace(F.regexp_replace(c, BRACKETED, " "), TAGLINE, "")
    name = F.btrim(F.regexp_replace(name, r"(?U)\s+", " "), F.lit(" ,.-|"))

    def peel(x: Column, times: int) -> Column:
        if not times:
            return x
        shorter = F.btrim(F.regexp_replace(x, rf"(?i)[\s,]+(?:{TRAILING_SUFFIXES})\.?$", ""), F.lit(" ,."))
        return _bind(F.coalesce(F.nullif(shorter, F.lit("")), x), lambda y: peel(y, times - 1))

    return _bind(name, lambda x: peel(x, 3))


def company_tokens(name: Column, dots_as_space: bool = False) -> Column:
    """Lower-case words of a cleaned name; none if all are legal words."""
    s = F.regexp_replace(F.lower(name), "[&/+]", " ")
    s = F.replace(s, F.lit("."), F.lit(" " if dots_as_space else ""))
    tokens = F.filter(F.split(F.regexp_replace(s, r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")
    return _bind(tokens, lambda ts: F.when(F.forall(ts, lambda t: t.isin(*LEGAL_WORDS)), F.slice(ts, 1, 0)).otherwise(ts))


def company_key(c: Column) -> Column:
    return F.array_join(company_tokens(clean_company(c)), " ")


def filer_key(c: Column) -> Column:
    return compact(company_key(c))


def query_ladder(c: Column) -> Column:
    """At most four distinct forms of a name to look up, the most specific first."""

    def forms(name: Column, base: Column) -> Column:
        tails = F.array(*map(F.lit, GENERIC_TAILS))
        # Words at the end that are all generic: as far as the last word that is not.
        kept = F.greatest(F.coalesce(F.array_max(F.transform(base, lambda t, i: F.when(~F.array_contains(tails, t), i + 1))), F.lit(0)), F.lit(1))
        lengths = F.when(F.size(base) > 1, F.filter(F.transform(F.sequence(F.lit(1), F.size(base)), lambda i: F.size(base) - i), lambda n: n >= kept)).otherwise(F.expr("cast(array() as array<int>)"))
        unsafe = F.array(*map(F.lit, UNSAFE_ROOTS))
        safe = (F.length(F.get(base, F.lit(0))) >= MIN_ROOT) & ~F.array_contains(unsafe, F.get(base, F.lit(0)))
        shorter = F.transform(F.filter(lengths, lambda n: (n > 1) | ((n == 1) & safe)), lambda n: F.array_join(F.slice(base, 1, n), " "))
        full = F.array(F.array_join(base, " "), F.array_join(company_tokens(name, dots_as_space=True), " "))
        return F.slice(F.filter(F.array_distinct(F.concat(full, shorter)), lambda f: f != ""), 1, MAX_FORMS)

    return _bind(clean_company(c), lambda name: _bind(company_tokens(name), lambda base: forms(name, base)))


def successors(queries: DataFrame, query: str, keys: DataFrame, key: str) -> DataFrame:
    """(query, successor): each distinct query that isn't null, with the least key that isn't less, or null beyond the last.

    Queries and keys are sorted together by range, so that each task has a stretch of the order, however many keys share their first
    letters.  Within a stretch the successor is the next key; past its last key it is the first of the stretches behind, of which there is a row each.
    """
    asked = queries.select(F.col(query).alias("s"), F.lit(0).alias("k"))
    given = keys.select(F.col(key).alias("s"), F.lit(1).alias("k"))
    both = asked.union(given).where("s is not null").distinct().repartitionByRange("s", "k").withColumn("p", F.spark_partition_id())
    back = Window.partitionBy("p").orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("next", F.last(F.when(F.col("k") == 1, F.col("s")), ignorenulls=True).over(back))
    behind = Window.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    stretches = placed.groupBy("p").agg(F.min(F.when(F.col("k") == 1, F.col("s"))).alias("first")).select("p", F.last("first", ignorenulls=True).over(behind).alias("first_behind"))
    found = placed.where("k = 0").join(F.broadcast(stretches), "p")
    return found.select(F.col("s").alias("query"), F.coalesce("next", "first_behind").alias("successor"))


def prefix_match(queries: DataFrame, query: str, filers: DataFrame, key: str = "key", min_len: int = 3) -> DataFrame:
    """The rows of ``queries`` that begin some filer key, or equal one if shorter than ``min_len``; an empty query matches nothing.

    A query begins some key if it begins its successor among the keys, so that one key is compared with each distinct query, not a block of them.
    """
    asked = queries.where(F.length(query) > 0)
    found = successors(asked, query, filers, key)
    begins = F.when(F.length("query") >= min_len, F.startswith("successor", F.col("query"))).otherwise(F.col("successor") == F.col("query"))
    matched = found.where(begins).select(F.col("query").alias("__q"))
    return asked.join(matched, asked[query] == F.col("__q"), "left_semi")


def inherit_verdict(names: DataFrame, name: str, verified: DataFrame, key: str = "company_key") -> DataFrame:
    """The rows of ``names`` some whole-word, proper prefix of which is a verified key; first words must be long and specific enough."""
    tokens = F.split(F.col(name), " ")
    unsafe = F.array(*map(F.lit, UNSAFE_ROOTS))
    able = names.where((F.size(tokens) >= 2) & (F.length(tokens[0]) >= MIN_ROOT) & ~F.array_contains(unsafe, tokens[0]))
    prefixes = able.select(F.col(name), F.explode(F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda n: F.array_join(F.slice(tokens, 1, n), " "))).alias("__prefix"))
    found = prefixes.join(verified.select(F.col(key).alias("__prefix")), "__prefix", "left_semi").select(name).distinct()
    return names.join(found, name, "left_semi")


def resolve_sponsor(postings: DataFrame, cache: DataFrame, filers: DataFrame | None, as_of: datetime, ttl_days: int = 30) -> DataFrame:
    """``postings`` with ``verified``: a cached yes within ``ttl_days``, else inherited, else whether a form of the name begins a filer key.

    Null where there is no filer index to ask, or the name is empty.  Each distinct name is looked up once; the verified
    names are those of the cache when the batch starts.
    """
    keyed = postings.withColumn("__k", company_key(F.col("company")))
    # A row a name, asked in four ways: kept rather than cleaned again for each.
    names = keyed.where(F.length("__k") > 0).groupBy("__k").agg(F.min("company").alias("__raw")).persist()
    age = F.datediff(F.lit(as_of), F.col("checked_at"))
    yes = cache.where(F.col("verified") & (age < ttl_days)).select(F.col("company_key")).distinct()
    cached = names.join(yes.withColumnRenamed("company_key", "__k"), "__k", "left_semi").select("__k")
    inherited = inherit_verdict(names.select("__k"), "__k", yes)
    true = cached.union(inherited).distinct()
    if filers is not None:
        forms = names.select("__k", F.explode(F.concat(query_ladder(F.col("__raw")), F.array("__k"))).alias("__form")).withColumn("__form", compact(F.col("__form")))
        true = true.union(prefix_match(forms, "__form", filers).select("__k")).distinct()
    verdicts = names.join(true.withColumn("__t", F.lit(True)), "__k", "left").select("__k", F.coalesce("__t", F.lit(False) if filers is not None else F.lit(None)).alias("verified"))
    return keyed.join(verdicts, "__k", "left").select(*postings.columns, "verified")


def distinct_filers(filings: DataFrame) -> DataFrame:
    """Keys of all employers, and their trade names, with a certified filing of the right class."""
    certified = filings.where((F.col("visa_class") == "H-1B") & F.startswith(F.col("case_status"), F.lit("Certified")))
    names = certified.select(F.explode(F.array("employer_name", "trade_name_dba")).alias("name")).where("name is not null").distinct()
    return names.select(filer_key(F.col("name")).alias("key")).where("key <> ''").distinct()


def stale_verdicts(cache: DataFrame, drops: DataFrame) -> DataFrame:
    """Negative verdicts whose name has another key today, or that would be inherited now, with the rows that each dropped."""
    negative = cache.where("not verified").withColumn("__now", company_key(F.col("company_raw")))
    yes = cache.where("verified").select("company_key")
    inherited = inherit_verdict(negative.select(F.col("company_key").alias("__c")).distinct(), "__c", yes).withColumn("__i", F.lit(True))
    found = negative.join(inherited, F.col("company_key") == F.col("__c"), "left").where((F.col("__now") != F.col("company_key")) | F.col("__i"))
    counts = drops.groupBy(company_key(F.col("company")).alias("__d")).agg(F.count("*").alias("n_drops"))
    return found.join(counts, F.col("company_key") == F.col("__d"), "left").select("company_key", "company_raw", F.coalesce("n_drops", F.lit(0)).alias("n_drops"))
