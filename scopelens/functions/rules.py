"""Rule sets of routing, taxonomies and crawling, and the expressions that apply them in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that keyword extraction skips.
STOPWORDS = (
    "what", "which", "where", "when", "how", "who", "does", "did", "the",
    "is", "are", "was", "were", "been", "being", "have", "has", "had",
    "for", "and", "but", "not", "this", "that", "with", "from", "about",
    "between", "into", "through", "during", "before", "after", "above",
    "below", "than", "each", "every", "both", "few", "more", "most",
    "other", "some", "such", "only", "same", "also", "tell", "show",
    "describe", "explain", "compare", "list", "give", "find", "need",
    "requirements", "required", "requirement", "according", "specific",
    "used", "using", "must", "shall", "should", "would",
)

# Categories of crawled files by what their URL holds, the most specific first.
URL_CATEGORIES = [
    ("Standard Plans", ["standard plan", "standard-plan", "std plan", "std-plan", "m-and-s", "m&s standard", "m & s standard", "mands", "m-standard", "s-standard", "m standard", "s standard"]),
    ("Standard Specs", ["standard spec", "standard-spec", "std spec", "std-spec", "specification", "special provision"]),
    ("Construction Manual", ["construction manual", "construction-manual", "construction bulletin", "construction handbook"]),
    ("Materials Testing", ["material", "test method", "test-method", "field testing", "mets", "ctm ", "california test", "lab manual"]),
    ("Bridge Program", ["bridge", "structure design", "memo to designer"]),
    ("Design Manual", ["design manual", "design-manual", "design guide", "design-guide", "highway design", "roadway design", "hdm", "pavement design", "drainage design", "geometric design"]),
    ("Traffic & Safety", ["traffic", "mutcd", "safety", "crash", "signal", "signing", "striping", "work zone", "speed"]),
    ("STIP", ["stip", "tip", "improvement program", "programming", "transportation plan", "long range", "long-range"]),
    ("Annual Reports", ["annual report", "annual-report", "performance report", "performance-report", "fact book", "factbook", "yearbook"]),
]

# Series by what their name or a title holds.
SERIES = [
    ("Standard Plans", ["standard plan"]),
    ("Standard Specs", ["standard spec", "specification"]),
    ("Construction Manual", ["construction manual"]),
    ("Materials Testing", ["material", "testing manual"]),
    ("Bridge Program", ["bridge", "approach slab"]),
    ("Design Manual", ["design manual", "design guide", "road design"]),
    ("Traffic & Safety", ["traffic crash", "highway safety", "traffic", "vulnerable road", "safety"]),
    ("STIP", ["transportation improvement", "stip", "corridor", "long range"]),
    ("Annual Reports", ["annual report", "financial", "operating budget"]),
]

# Patterns that route a question, the first hit wins.
ROUTES = [
    (r"\b(standard\s+spec(?:s|ifications)?|section\s+\d{3}(?:\.\d+)*)\b", "specs_agent"),
    (r"\b(construction manual|inspection procedure)\b", "construction_agent"),
    (r"\b(materials testing|aggregate test|asphalt content|sampling method)\b", "materials_agent"),
    (r"\b(design manual|geometric design|superelevation|sight distance)\b", "design_agent"),
    (r"\b(crash|fatalit(?:y|ies)|impaired driv|traffic safety)\b", "safety_agent"),
    (r"\b(bridge|load rating|approach slab)\b", "bridge_agent"),
    (r"\b(stip|corridor study|long range plan|transportation improvement)\b", "planning_agent"),
    (r"\b(annual report|operating budget|dbe goal|financial report)\b", "admin_agent"),
]

# Parts of a URL's path that make a page worth crawling sooner, or last.
CRAWL_FIRST = ("design", "spec", "manual", "construct", "material", "bridge", "traffic", "plan", "publication", "document", "library", "report", "engineering", "standard", "safety", "program")
CRAWL_LAST = ("news", "career", "espanol", "/es/", "contact", "calendar", "event", "press-release", "newsroom", "login", "search", "subscribe", "twitter", "facebook", "youtube", "instagram", "linkedin")

#: What a title's stem leaves out, and its joining words.
STEM_NOISE = r"\b(19|20)\d{2}\b|\bfy\s*\d+\b|\brev(ision)?\b|\bupdated\b|\(.*?\)|effective.*|[^a-z ]"
STEM_WORDS = ("the", "for", "and", "of")

#: Ordered rules of a text's topic: the first that matches names the category.
TOPICS = [("licen[sc]e", "licence"), ("[0-9]{3}", "numbers"), ("\\|", "table"), ("th", "common")]


def contains_any(value: Column, needles) -> Column:
    """One search for all needles, so that the text's expression occurs once."""
    return value.rlike("|".join(f"\\Q{n}\\E" for n in needles))


def by_contents(hay: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The first label one of whose keys the text holds; null without any."""
    return F.coalesce(*[F.when(contains_any(hay, keys), F.lit(label)) for label, keys in rules])


def by_pattern(text: Column, rules: list[tuple[str, str]] = ROUTES, default: str | None = None) -> Column:
    """The label of the first pattern that is found, ignoring case."""
    return F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules], F.lit(default))


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*", "")


def _plain(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.lower(text), F.lit("_"), F.lit(" ")), F.lit("%20"), F.lit(" ")), F.lit("-"), F.lit(" "))


def url_category(url: Column, filename: Column, page: Column) -> Column:
    """By URL and file name; failing that by the page that linked it; else General."""
    rules = [(label, [k.lower().replace("_", " ").replace("-", " ") for k in keys]) for label, keys in URL_CATEGORIES]
    return F.coalesce(by_contents(_plain(F.concat(url_path(url), F.lit("  "), filename)), rules), by_contents(_plain(url_path(page)), rules), F.lit("General"))


def series(raw: Column, title: Column) -> Column:
    """A free-text series and title on the shared taxonomy."""
    hay = F.lower(F.concat(F.coalesce(raw, F.lit("")), F.lit("  "), F.coalesce(title, F.lit(""))))
    return F.coalesce(by_contents(hay, SERIES), F.lit("General"))


def page_priority(url: Column) -> Column:
    """0: crawl soon, 1: whenever, 2: last."""
    p = F.lower(url_path(url))
    return F.when(contains_any(p, CRAWL_LAST), 2).when(contains_any(p, CRAWL_FIRST), 0).otherwise(1)


def is_pdf(href: Column) -> Column:
    h = F.split_part(F.lower(href), F.lit("#"), F.lit(1))
    return h.endswith(".pdf") | h.contains(".pdf?")


def strategy(coverage: Column, validity: Column, seconds_left: Column) -> Column:
    """How a refinement loop goes on."""
    low_c, low_v = coverage < 0.75, validity < 0.70
    return F.when(low_c & low_v & (seconds_left > 20), "Hybrid").when(low_c & (seconds_left > 15), "Depth").when(low_v & (seconds_left > 10), "Breadth").otherwise("Stop")
