"""Vocabulary tables (A5, A6, Q8, Q12) as parameters of the site/search jobs.

Defaults are the reference's lists. The fixture corpus is invented text in
which those words barely occur, so the registered driver queries pass the
fixture vocabulary instead (FIXTURES.md §2.1). Both are plain data; the jobs
turn them into literal arrays inside one expression (no join, no broadcast
of anything that grows with the data).
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...]
    min_hits: int
    expansion: str = ""


@dataclass(frozen=True)
class DescriptionRule:
    description: str
    terms: tuple[str, ...]


# ---- fixed values that must equal the reference (site categories, A5) -----
REFERENCE_CATEGORIES = (
    Category("API/Developer", ("api", "sdk", "endpoint", "webhook", "authentication", "oauth"), 2,
             "api|sdk|endpoint|endpoints|webhook|webhooks|authentication|oauth|token|rest|graphql|developer|docs"),
    Category("Changelog/Releases", ("changelog", "release", "version", "update", "migration"), 2,
             "changelog|release|releases|version|update|updates|migration|what's new|breaking changes"),
    Category("Recipes/Food", ("recipe", "ingredient", "cooking", "meal", "nutrition"), 2,
             "recipe|recipes|ingredient|ingredients|cooking|meal|meals|nutrition|calories|diet|prep time"),
    Category("Medical/Health", ("doctor", "surgeon", "patient", "treatment", "procedure", "clinic", "medical"), 3,
             "doctor|surgeon|patient|treatment|procedure|clinic|appointment|consultation|recovery|symptoms"),
    Category("Education/Courses", ("course", "lesson", "tutorial", "curriculum", "enrollment", "learning"), 2,
             "course|courses|lesson|lessons|tutorial|curriculum|enrollment|enroll|learning|certificate|module"),
    Category("Real Estate", ("listing", "property", "bedroom", "sqft", "real estate", "mortgage"), 2,
             "listing|listings|property|properties|bedroom|sqft|mortgage|rent|buy|sell|neighborhood"),
    Category("E-commerce/Shopping", ("cart", "checkout", "shipping", "product", "add to cart", "shop"), 2,
             "product|products|cart|checkout|shipping|order|buy|shop|store|catalog|collection"),
    Category("Integrations/Plugins", ("integration", "plugin", "extension", "marketplace", "connector"), 2,
             "integration|integrations|plugin|plugins|extension|connector|marketplace|connect|third-party|app"),
    Category("Blog/Articles", ("blog", "article", "post", "author", "published", "read time"), 3,
             "blog|article|articles|post|posts|author|published|read|guide|guides|news|insights"),
    Category("Legal/Compliance", ("legal", "privacy", "terms", "compliance", "gdpr", "policy"), 2,
             "legal|privacy|terms|compliance|gdpr|policy|disclaimer|cookie|consent|regulation"),
)
MAX_CATEGORIES = 5

# ---- fixed values that must equal the reference (description rules, A6) --
REFERENCE_DESCRIPTION_RULES = (
    DescriptionRule("API documentation and developer resources", ("api", "reference", "documentation", "docs", "guide")),
    DescriptionRule("Service-based business", ("service", "treatment", "procedure", "services")),
    DescriptionRule("Medical practice or healthcare provider", ("doctor", "surgeon", "clinic", "medical", "healthcare", "patient")),
    DescriptionRule("Product or SaaS platform", ("product", "feature", "saas", "platform", "software")),
    DescriptionRule("Creative agency or service provider", ("portfolio", "work", "projects", "agency", "design")),
)
DESCRIPTION_TITLE_PAGES = 20
HOMEPAGE_MIN_DESCRIPTION = 20
HOMEPAGE_MIN_SUMMARY = 50

# ---- fixed values that must equal the reference (query expansions, Q8) ----
REFERENCE_TOPICS = (
    ("Pricing/Cost", "pricing|price|cost|fee|fees|costs|rates|pricing information|how much|payment|plans|tiers"),
    ("Contact/Location", "contact|reach|location|locations|address|phone|email|office|find us|where|directions"),
    ("Service/Product", "services|service|offerings|treatments|procedures|products|solutions|what we offer|what we do"),
    ("Features/Capabilities", "features|feature|capabilities|what it does|functionality|tools|what can|includes"),
    ("Integrations/API", "integrations|integration|connects|works with|api|connect|integrate|third party|connectivity"),
    ("Case Studies/Testimonials", "case studies|case study|testimonials|reviews|success stories|customers|clients|examples|results"),
    ("Portfolio/Work", "portfolio|work|projects|examples|showcase|gallery|what we've done|our work|before after"),
    ("Resources/Blog", "resources|blog|guides|documentation|help|knowledge base|articles|learn|tutorials|content"),
    ("Information/About", "about|information|details|overview|what is|learn more|read more|background"),
    ("Process/How-to", "how|process|steps|procedure|method|guide|instructions|workflow|getting started"),
    ("Team/People", "team|staff|people|doctors|surgeons|experts|professionals|who|our team"),
    ("FAQ/Help", "faq|questions|help|support|common questions|answers|troubleshooting"),
)

# ---- fixed values that must equal the reference (pattern families, Q12) ---
# pricing: the reference's first alternative is meant as a literal dollar sign
# (Decision 12); it is written here as an escaped regex dollar.
REFERENCE_PATTERN_FAMILIES = (
    ("markdown_link", r"\[.*\]\(.*\)"),
    ("cta", r"call.*action|cta|click here|get started|learn more|contact us|book now|schedule|request|sign up"),
    ("value_prop", r"why choose|benefits|advantages|features|what makes us|unique|different"),
    ("contact", r"phone|email|address|contact|reach|location"),
    ("pricing", r"\$|price|cost|fee|pricing|rates"),
)
# ---------------------------------------------------------------------------

# Fixture vocabulary (FIXTURES.md §2.1): words that do occur in the invented
# corpus, so that every branch of A5 / A6 / Q8 / Q12 is exercised.
FIXTURE_CATEGORIES = (
    Category("en_core", ("the", "with", "that", "from"), 3, "the|with|that|from"),
    Category("fr_core", ("pour", "dans", "avec", "elle"), 3, "pour|dans|avec|elle"),
    Category("es_core", ("para", "los", "las", "como"), 3, "para|los|las|como"),
    Category("de_core", ("nicht", "für", "und", "sich"), 3, "nicht|für|und|sich"),
    Category("junk", ("***", "$$$", "###"), 2, r"\*\*\*|\$\$\$|###"),
    Category("two_word", ("of the",), 1, "of the"),
    Category("never", ("zzzz",), 1, "zzzz"),
)
FIXTURE_DESCRIPTION_RULES = (
    DescriptionRule("Spanish-language pages", ("para", "los")),
    DescriptionRule("German-language pages", ("nicht", "und")),
    DescriptionRule("French-language pages", ("pour", "avec")),
    DescriptionRule("English-language pages", ("the", "with")),
)
FIXTURE_TOPICS = (
    ("articles", "the|of"),
    ("french", "pour|avec|dans"),
    ("german", "nicht|und"),
    ("junk", r"\*\*\*|\$\$\$"),
    ("nothing", "zzzz"),
)
FIXTURE_PATTERN_FAMILIES = (
    ("markdown_link", r"\[[^\]]*\]\([^)]*\)"),
    ("pricing", r"\$|price|cost|fee|pricing|rates"),
    ("secret", r"token = "),
    ("ip_address", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    ("junk", r"\*\*\*|###|%%%"),
)
