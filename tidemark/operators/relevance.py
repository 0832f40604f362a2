"""Relevance of candidates by word lists, and similar titles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import any_match, any_of, squeezed, stripped
from tidemark.functions.urls import is_pdf

# The register's own lists and patterns; all are parameters.
SIGNALS = (
    "artificial intelligence", "generative ai", "gen ai", "machine learning", "automated decision", "algorithmic",
    "data centre", "data center", "hyperscale", "large-scale compute", "compute infrastructure",
)
SIGNAL_TOKEN = r"(?:^|[^a-z0-9])ai(?:[^a-z0-9]|$)"
TERMS = (
    "policy", "guidance", "guideline", "framework", "standard", "regulation", "governance", "ethic", "safety", "assurance",
    "assessment", "adoption", "principle", "plan", "roadmap", "statement", "expectation", "priority", "inquiry", "draft rule",
    "memorandum", "agreement", "announcement", "media release", "consultation", "audit", "procurement", "public sector", "transparency",
)
STRONG = ("policy", "framework", "guideline", "guidance", "standard", "regulation", "practice note", "practice direction", "assurance")
GENERIC_TITLES = (
    r"^privacy policy$", r"^privacy$", r"^policy\s*(?:&|and)\s*guidelines?$", r"^commitments$", r"^mission\s+\d+[a-z]?\b",
    r"^terms(?: of use)?$", r"^accessibility$", r"^contact(?: us)?$", r"^cookies?$", r"^copyright$", r"^sitemap$",
)
GENERIC_URLS = (
    r"/privacy(?:-policy)?(?:/|$)", r"/cookies?(?:/|$)", r"/accessibility(?:/|$)", r"/terms(?:-of-use)?(?:/|$)",
    r"/contact(?:/|$)", r"/about/policies?(?:/|$)", r"/policies/privacy(?:/|$)",
)
HUB_TITLES = (r"^learn about\b", r"^identifying\b", r"\band tools\b", r"\band frameworks?\b", r"\bresponsibilit(?:y|ies)\b")
SUBSECTIONS = (
    r"/node/\d+(?:/|$)", r"/responsibilities(?:/|$)", r"/identifying-ai(?:/|$)", r"/ai-guidance-and-tools(?:/|$)",
    r"/ai-governance-assurance-and-frameworks(?:/|$)",
)
TYPE_RULES = (
    ("practice note", "practice_note"), ("practice direction", "practice_note"), ("legislation", "legislation"), (" bill ", "legislation"),
    (" act ", "legislation"), ("regulation", "regulation"), ("guideline", "guideline"), ("guidance", "guideline"),
    ("framework", "framework"), ("standard", "standard"), ("policy", "policy"),
)
PLACE_RULES = (
    (".nsw.gov.au", "nsw"), ("new south wales", "nsw"), (".vic.gov.au", "vic"), ("victoria", "vic"), (".qld.gov.au", "qld"),
    ("queensland", "qld"), (".wa.gov.au", "wa"), ("western australia", "wa"), (".sa.gov.au", "sa"), ("south australia", "sa"),
    (".tas.gov.au", "tas"), ("tasmania", "tas"), (".act.gov.au", "act"), ("australian capital territory", "act"),
    (".nt.gov.au", "nt"), ("northern territory", "nt"), (".gov.au", "federal"),
)
TAG_WORDS = {
    "generative-ai": ("generative ai", "gen ai"), "automated-decision-making": ("automated decision",), "assurance": ("assurance",),
    "procurement": ("procurement",), "public-sector": ("public sector", "government"),
}
# End of fixed values.


@dataclass(frozen=True)
class Rules:
    signals: Sequence[str] = SIGNALS
    token: str | None = SIGNAL_TOKEN
    terms: Sequence[str] = TERMS
    strong: Sequence[str] = STRONG
    generic_titles: Sequence[str] = GENERIC_TITLES
    generic_urls: Sequence[str] = GENERIC_URLS


def normal(text: Column) -> Column:
    return squeezed(F.lower(text))


def has_signal(text: Column, rules: Rules = Rules()) -> Column:
    found = any_of(normal(text), rules.signals)
    return found | F.rlike(normal(text), F.lit(rules.token)) if rules.token else found


def is_generic(title: Column, url: Column, rules: Rules = Rules()) -> Column:
    return any_match(stripped(title), rules.generic_titles) | any_match(url, rules.generic_urls)


def is_strong(title: Column, url: Column, rules: Rules = Rules()) -> Column:
    """A document of its own rather than a hub or a section."""
    return ~any_match(normal(title), HUB_TITLES) & ~any_match(url, SUBSECTIONS) & any_of(normal(F.concat_ws(" ", title, url)), rules.terms)


def is_relevant(title: Column, url: Column, text: Column, rules: Rules = Rules()) -> Column:
    """A signal in title or url, and a governing term anywhere or a PDF. (A generic page needs the signal too.)"""
    context = F.concat_ws(" ", title, url, text)
    return has_signal(F.concat_ws(" ", title, url), rules) & (any_of(normal(context), rules.terms) | is_pdf(url))


def scored(title: Column, url: Column, text: Column, rules: Rules = Rules()) -> list[Column]:
    """relevant and score: 0, .55, or .65 for a strong title."""
    relevant = is_relevant(title, url, text, rules)
    score = F.when(~relevant, F.lit(0.0)).when(any_of(F.lower(title), rules.strong), F.lit(0.65)).otherwise(F.lit(0.55))
    return [relevant.alias("relevant"), score.alias("score")]


def tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(any_of(low, words), F.lit(tag)) for tag, words in TAG_WORDS.items())))


def wanted(score: Column, relevant: Column, title: Column, url: Column, context: Column, create: bool) -> Column:
    """Whether an analysed candidate is to be created (from .8, strong) or queued (from .5)."""
    signal = has_signal(F.concat_ws(" ", title, url)) | has_signal(context)
    return relevant & (score >= (0.8 if create else 0.5)) & signal & (is_strong(title, url) if create else F.lit(True))


def first_similar(asked: DataFrame, key: str, tracked: DataFrame, tracked_key: str, least: float) -> DataFrame:
    """(key, tracked_key): the first tracked row whose keywords ``k`` overlap enough.

    Sets with an overlap of ``least`` share a word of each set's rarest ones, as many as may be missing
    plus one; only these are joined, so frequent words bring no rows together.
    """
    seen = tracked.select(F.explode("k").alias("word")).unionByName(asked.select(F.explode("k").alias("word"))).groupBy("word").agg(F.count("*").alias("n"))

    def posted(rows: DataFrame, name: str) -> DataFrame:
        each = rows.select(F.col(name).alias("id"), "k", F.explode("k").alias("word")).join(seen, "word")
        held = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("words"))
        most = F.size("words") - F.ceil(F.size("words") * least).cast("int") + 1
        return held.select("id", F.explode(F.slice("words", 1, most)).alias("w")).select("id", "w.word")

    met = posted(asked, key).alias("a").join(posted(tracked, tracked_key).alias("b"), "word").select(F.col("a.id").alias(key), F.col("b.id").alias(tracked_key)).distinct()
    both = met.join(asked.select(key, F.col("k").alias("x")), key).join(tracked.select(tracked_key, F.col("k").alias("y")), tracked_key)
    near = F.size(F.array_intersect("x", "y")) >= least * F.size(F.array_union("x", "y"))
    return both.where(near).groupBy(key).agg(F.min(tracked_key).alias(tracked_key))
