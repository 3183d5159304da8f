"""Fixed values that results depend on: word lists, thresholds and sentences."""

# Fixed values. Words that are never title or question tokens.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "i", "in", "is", "it", "me", "my", "of", "on", "or", "please", "some",
    "that", "the", "this", "to", "want", "with", "would", "you", "looking", "need", "prefer", "preference", "product", "item", "women", "woman",
    "men", "man", "new", "best", "set",
]
# Fixed values. Tokens that alone don't make a feature worth stating.
GENERIC_TOKENS = [
    "women", "woman", "womens", "men", "mens", "adult", "kids", "child", "clothing", "shoes", "jewelry", "fashion", "style", "classic", "new",
    "quality", "premium", "great", "best", "design", "comfortable", "comfort", "available", "imported", "machine", "wash", "closure", "pack", "piece",
]
# Fixed values. A detail whose key holds one of these is not stated.
UNSAFE_DETAIL_KEYS = (
    "asin", "model", "item model", "date first", "date last", "best sellers", "dimensions", "weight", "manufacturer part",
    "upc", "isbn", "sku", "rank", "batteries", "country of origin", "recommended age",
)
# Fixed values. Detail keys that never make a negative statement.
NEGATIVE_UNSAFE_KEYS = (
    "asin", "model", "date", "dimension", "weight", "rank", "sku", "upc", "battery", "batteries", "country", "origin", "isbn", "manufacturer part",
)
# Fixed values. Colors and materials that are looked for in a product's text.
COLORS = [
    "black", "white", "blue", "red", "pink", "green", "brown", "gray", "grey", "purple", "yellow", "orange", "navy", "beige", "silver", "gold",
]
MATERIALS = [
    "cotton", "polyester", "nylon", "leather", "wool", "spandex", "silk", "rayon", "fabric", "linen", "suede", "denim",
]
# Fixed values. Attributes in the order in which answers name them.
ATTRIBUTES = ("category", "material", "color", "size", "style", "brand", "budget", "feature", "use_case", "other")
# Fixed values. Words that name an attribute in a question.
ATTRIBUTE_ALIASES = {
    "category": ("category", "type", "kind", "what is it"),
    "material": ("material", "fabric", "made of", "made from", "composition"),
    "color": ("color", "colour", "shade", "tone", "look"),
    "size": ("size", "sizing", "fit", "dimensions", "measurement"),
    "style": ("style", "pattern", "design", "shape", "closure"),
    "brand": ("brand", "maker", "manufacturer", "store", "label"),
    "budget": ("price", "cost", "budget", "under", "spend", "affordable"),
    "feature": ("feature", "specification", "detail", "function"),
    "use_case": ("use case", "occasion", "activity", "travel", "sport"),
    "other": ("anything else", "other", "preference"),
}
# Fixed values. Words that name a field in a question.
FIELD_ALIASES = {
    "category_path": ("category", "type", "kind"),
    "store": ("brand", "maker", "store"),
    "title_token": ("name", "listing", "title"),
    "feature": ("feature", "specification", "detail"),
    "description": ("description", "details", "feature"),
    "price": ("price", "cost", "budget"),
    "rating": ("rating", "stars", "reviews"),
    "rating_count": ("review count", "number of reviews", "popularity"),
}
# Fixed values. Words that never route a question.
ROUTING_STOPWORDS = [
    "have", "has", "include", "includes", "look", "looking", "use", "using", "work", "wear", "need", "want", "find", "tell", "get", "does", "do",
    "can", "could", "would", "please", "something", "thing", "item", "product",
]
# Fixed values. Patterns that tell questions and what they ask for; all ignore case.
QUESTION = r"\?|\b(?:what|which|who|whose|where|when|how|can\s+you|could\s+you|would\s+you|do\s+you|are\s+you|tell\s+me|please\s+(?:tell|specify|share))\b"
BROAD = (
    r"\b(?:anything\s+else|something\s+else|what\s+else|other\s+preferences?|more\s+(?:details?|requirements?|preferences?)|"
    r"else\s+matters?|any\s+other|additional\s+(?:detail|requirement|preference))\b"
)
ASKED_FOR = {
    "category": (r"\b(?:kind|type|category|sort)\s+of\s+(?:item|product|thing)\b", r"\bwhat\s+(?:are\s+you\s+)?(?:shopping|looking)\s+for\b"),
    "material": (r"\b(?:made\s+(?:of|from)|fabric|composition|material)\b",),
    "color": (r"\b(?:colour|color|shade|tone|what\s+look)\b",),
    "size": (r"\b(?:size|sizing|fit|width|measurement|how\s+(?:large|small|wide))\b",),
    "style": (r"\b(?:style|pattern|design|shape|silhouette|closure)\b",),
    "brand": (
        r"\b(?:brand|maker|manufacturer|label|which\s+company|who\s+makes|made\s+by)\b",
        r"\b(?:where|who)\s+(?:should\s+it|does\s+it|would\s+it)?\s*(?:come|be)\s+from\b",
    ),
    "budget": (r"\b(?:price|cost|budget|afford|spend|price\s+range|how\s+much)\b",),
    "feature": (
        r"\b(?:feature|function|specification|capability|rating|rated|stars?|reviews?|reputation|口碑)\b",
        r"\bhow\s+well\s+(?:reviewed|rated)\b",
    ),
    "use_case": (r"\b(?:use\s+case|occasion|activity|purpose|where\s+.*\s+use|what\s+.*\s+for|when\s+.*\s+wear)\b",),
}
# Fixed values. (structured attribute, text attribute) pairs that don't contradict each other.
COMPATIBLE = (("feature", "use_case"), ("feature", "style"), ("use_case", "feature"))
# Fixed values. Names in samples and facts.
SCENARIOS = ("direct_search", "multi_constraint", "profile_hidden", "clarification_required", "negative_constraint", "budget_rating", "intent_override")
SOURCES = ("categories", "store", "price", "rating", "rating_count", "details", "features", "description", "title", "cross_catalog", "decoy")
EQUAL, HOLDS, AT_MOST, AT_LEAST, NEGATIVE = ("eq", "exact"), ("contains", "has"), ("le", "max"), ("ge", "min"), ("neq", "not_contains", "not")
OPERATORS = (*EQUAL, *HOLDS, *AT_MOST, *AT_LEAST, *NEGATIVE)
NUMERIC = ("price", "rating", "rating_count")
# Fixed values. Review counts that are stated.
COUNT_STEPS = (10, 25, 50, 100, 250, 500, 1000, 5000, 10000)
# Fixed values. Weight of a fact's source when signatures are searched; 0.65 for any other.
SOURCE_WEIGHTS = {
    "categories": 1.15, "details": 1.08, "store": 0.94, "price": 0.88, "rating": 0.75, "rating_count": 0.7,
    "features": 0.82, "description": 0.6, "title": 0.53, "cross_catalog": 0.45,
}
# Fixed values. Two sentences for each kind of fact; {} is what the fact displays.
SENTENCES = {
    "category": ("I'm looking for {}.", "I need something in the {} category."),
    "category_path": ("It should be in the {} area.", "Please focus on {}."),
    "store": ("I usually prefer {} as the brand.", "Please prioritize the {} label."),
    "price": ("I'd like to keep the price under ${}.", "My budget is no more than ${}."),
    "rating": ("I would like at least {} stars.", "Please look for something rated {} stars or higher."),
    "rating_count": ("At least {} reviews would make me more comfortable.", "I prefer a product with {}+ reviews."),
    "color": ("A {} color would be ideal.", "I'd prefer it in {}."),
    "material": ("I prefer {} material.", "It should be made from {}."),
    "title_token": ("The listing mentions {}.", "I remember seeing {} in the product name."),
    "feature": ("One important detail is: {}.", "Please make sure it has this feature: {}."),
    "description": ("The description should mention {}.", "I am looking for something described as {}."),
    "other": ("I'd prefer {}.", "Please look for {}."),
}
# Fixed values. Sentences of a change of mind and the start of a profile's summary.
OVERRIDE = {
    "message": "Actually, ignore that earlier preference for {old}. Please prioritize {new} instead.",
    "query": " I initially thought I wanted {old}, but I am still deciding.",
}
PROFILE_SUMMARY = "I usually shop with a few preferences in mind."
# Fixed values.
MAX_TURNS = TOP_K = 10
