"""Sources of evidence: trust by domain, exclusion, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import domain

# Source classes by domain. Exact or sub-domain, by suffix, or by substring, as the rules below say.
EXCLUDED = {
    "personal_blog": ("medium.com", "tistory.com", "velog.io", "blog.naver.com", "blogspot.com", "wordpress.com", "substack.com", "brunch.co.kr"),
    "forum": ("reddit.com", "quora.com", "stackoverflow.com", "stackexchange.com"),
    "user_wiki": ("namu.wiki", "fandom.com"),
    "tutorial": ("tutorialspoint.com", "w3schools.com", "geeksforgeeks.org", "freecodecamp.org", "javatpoint.com", "programiz.com"),
}
STANDARDS = ("w3.org", "ietf.org", "rfc-editor.org", "iso.org", "ecma-international.org", "ieee.org", "nist.gov")
INTERGOVERNMENTAL = ("unesco.org", "un.org", "who.int", "europa.eu", "oecd.org", "worldbank.org")
AGENCIES = ("arko.or.kr",)
MUSEUMS = ("uffizi.it", "britishmuseum.org", "metmuseum.org", "moma.org", "tate.org.uk", "getty.edu", "acmi.net.au", "vam.ac.uk")
ACADEMIC = ("arxiv.org", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "jstor.org", "doi.org", "sciencedirect.com", "springer.com", "cambridge.org", "academic.oup.com")
DOCUMENTATION = ("docs.", "developer.", "developers.", "learn.", "support.", "help.", "cloud.", "kubernetes.io")
EDUCATIONAL = ("britannica.com", "khanacademy.org", "openstax.org", "opentextbooks.org", "pressbooks.pub", "books.google.com", "openlibrary.org", "interaction-design.org", "treccani.it", "encyclopedia.com", "pbs.org")
# Documentation domains that the parts above cover already aren't listed one by one.
NEWS = ("news", "reuters.", "apnews.", "bbc.", "nytimes.", "wsj.")
TRUST = {"standards": 0.95, "government": 0.95, "official_docs": 0.9, "academic": 0.85, "educational": 0.75, "encyclopedia": 0.7, "news": 0.6, "secondary": 0.55, "tutorial": 0.2, "forum": 0.2, "blog": 0.2}
PRIORITY = {"official_docs": 1, "standards": 2, "government": 2, "academic": 3, "educational": 4, "encyclopedia": 5}


def _under(d: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for name in names:
        out = out | (d == name) | d.endswith(f".{name}")
    return out


def _has(d: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | d.contains(part)
    return out


def exclusion(url: Column) -> Column:
    """Why a source is left out from the start, or null: its domain's class, or that it is no web address."""
    d = domain(url)
    out = F.when(d == "", "invalid_url")
    for name, domains in EXCLUDED.items():
        out = out.when(_under(d, domains), name)
    return out.when(~url.rlike("(?i)^https?://"), "invalid_url")


def trust_level(url: Column) -> Column:
    """A source's class; the first rule that holds decides. The order of rules and the suffixes in them are fixed values."""
    d, out_of = domain(url), exclusion(url)
    return (
        F.when(out_of == "tutorial", "tutorial")
        .when(out_of.isin("forum", "user_wiki"), "forum")
        .when(out_of == "personal_blog", "blog")
        .when(d.contains("wikipedia.org"), "encyclopedia")
        .when(_has(d, STANDARDS), "standards")
        .when(_under(d, INTERGOVERNMENTAL), "government")
        .when(d.endswith(".gov") | d.endswith(".go.kr") | d.endswith(".gov.kr") | d.rlike(r"(^|\.)gov\.[a-z]{2,}$") | _under(d, AGENCIES), "government")
        .when(_under(d, MUSEUMS), "official_docs")
        .when(_under(d, ACADEMIC) | d.endswith(".edu") | d.endswith(".ac.kr"), "academic")
        .when(_has(d, DOCUMENTATION), "official_docs")
        .when(_has(d, EDUCATIONAL), "educational")
        .when(_has(d, NEWS), "news")
        .otherwise("secondary")
    )


def with_trust(sources: DataFrame, url: str) -> DataFrame:
    """``domain, trust_level, trust_score, priority, eligible`` of each source."""
    level = F.col("trust_level")
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), level)
    out = sources.withColumns({"domain": domain(F.col(url)), "trust_level": trust_level(F.col(url))})
    return out.withColumns({"trust_score": pick(TRUST), "priority": F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), level)}).withColumn("eligible", F.col("priority").isNotNull())


def source_strength(source_class: Column, authority: Column, confidence: Column, least: float = 0.7) -> Column:
    """strong, supporting or excluded by a source's class, its authority for the claim and the confidence in both."""
    good = (confidence >= least) & authority.isin("high", "medium")
    return F.when(good & source_class.isin("primary_authority", "standard", "scholarly", "expert_reference", "encyclopedia"), "strong").when(good & source_class.isin("official_secondary", "general_secondary"), "supporting").otherwise("excluded")


def usable_passage(status: Column, score: Column, least: float = 0.9) -> Column:
    return (status == "exact") | ((status == "fuzzy") & (score >= least))


def ranked(sources: DataFrame, keys: list[str], strength: str, priority: str, confidence: str, url: str, most: int) -> DataFrame:
    """The first ``most`` sources of each key: strong ones first, by priority, confidence and address, named E1 and on."""
    by = Window.partitionBy(*keys).orderBy((F.col(strength) != "strong").cast("int"), F.col(priority).asc_nulls_last(), F.col(confidence).desc(), url)
    out = sources.filter(F.col(strength) != "excluded").withColumn("nr", F.row_number().over(by)).filter(F.col("nr") <= most)
    return out.withColumn("label", F.concat(F.lit("E"), F.col("nr").cast("string"))).drop("nr")


def prefiltered(sources: DataFrame, url: str) -> DataFrame:
    """Distinct addresses, each accepted or with the reason of its exclusion."""
    own = sources.select(F.trim(url).alias("url")).filter("url <> ''").distinct()
    return own.withColumn("category", F.coalesce(exclusion(F.col("url")), F.lit("accepted")))
