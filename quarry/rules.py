"""Vocabularies and constants that the operators take as parameters.

All tables here are fixed values: results depend on exactly these words, orders
and numbers.
"""

from __future__ import annotations

# Topic patterns of each strand, in the order in which they are tried.
# A part belongs to a strand if its references contain "<strand>-" or its topic
# contains one of the patterns, both without regard to case.
STRAND_TOPICS = {
    "algebra": ["factor theorem", "modulus", "inequality", "surd", "simultaneous", "polynomial", "discriminant", "quadratic"],
    "differentiation": ["differentiat", "derivative", "turning point", "rate of change", "first principles"],
    "integration": ["integrat", "antideriv", "average value"],
    "sequences-series": ["sequence", "series", "geometric", "arithmetic"],
    "indices-logs": ["indices", "logs", "logarithm"],
    "complex-numbers": ["complex number", "de moivre", "argand", "polar form"],
    "functions-graphs": ["function", "composite", "injective", "inverse function"],
    "financial-maths": ["financial", "annuit", "amortisation", "compound interest"],
    "induction": ["induction"],
    "number-theory": ["number theory", "irrational proof", "root 2"],
    "paper-1-proofs": [],
    "probability": ["probabilit", "bernoulli", "expected value"],
    "statistics": ["statistic", "z-score", "z score", "confidence interval", "hypothesis test", "standard normal"],
    "trigonometry-1": ["trig 1", "sine rule", "cosine rule", "pythagoras", "sohcahtoa"],
    "trigonometry-2": [],
    "trigonometry-3": [],
    "trigonometry-4": [],
    "the-line": ["the line", "perpendicular distance", "slope"],
    "the-circle": ["the circle", "tangent to a circle"],
    "geometry-1": ["geometry", "similar triangle", "theorem 1"],
    "avm-1": ["cone", "cylinder", "sphere", "volume"],
    "paper-2-proofs": [],
}
#: Strands whose slugs name a folder, longest prefix first.
FOLDER_STRANDS = [s for s in STRAND_TOPICS if not s.endswith("proofs")]
#: Strands of the failure report, which does not part trigonometry.
REPORT_STRANDS = [s for s in FOLDER_STRANDS if not s.startswith(("trigonometry", "avm", "geometry"))] + ["trigonometry", "avm"]
LOW_FREQUENCY_TOPICS = ["induction", "number-theory", "trigonometry-3", "trigonometry-4", "complex-numbers-de-moivre", "financial-maths"]

# Phrases and patterns that route a question.
ANALYTICAL_PHRASES = [
    "how often", "how many times", "frequency", "what percentage", "percentage of", "proportion of", "average marks", "mean marks",
    "marks per part", "trend", "trends", "year-over-year", "year over year", "compared to", "versus", "vs", "vs.", "deferred vs main",
    "which strand has", "which strands have", "most cited", "most-cited", "most often", "appearance count", "appearance counts",
    "how common", "how frequently",
]
ANALYTICAL_PATTERNS = [
    r"\bhow many\b.*\b(questions|parts|appearances|times)\b",
    r"\bsince\s+20\d{2}\b",
    r"\bin the last\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+years\b",
]
CONCEPTUAL_WORDS = ["why", "explain", "how does", "how do i", "prove"]
SOLUTION_PATTERNS = [
    r"\b(19|20)\d{2}\b.*\b(p|paper)\s*[12]\b.*\bq\s*\d+",
    r"\b(p|paper)\s*[12]\b.*\bq\s*\d+.*\b(19|20)\d{2}\b",
    r"\bq\s*\d+[a-z]?(?:\([a-z]+\))*\b.*\b(from|in|on)\b.*\b(19|20)\d{2}\b",
    r"\b(19|20)\d{2}\b.*\bq\s*\d+[a-z]?\b",
    r"\b(walk me through|show me|solve|solution to|how was)\b.*\bq\s*\d+",
]
SUMMARY_PHRASES = [
    "cram", "cramming", "revision", "revise", "i need to revise", "summary of", "summarise", "summarize", "overview of",
    "what do i need to know", "what's important", "what is important", "what should i focus", "tonight", "exam tomorrow",
    "exam next week", "in a rush", "quick refresher", "tldr", "tl;dr",
]

# The rewrite gate.
CONCEPTUAL_PREFIXES = ["explain ", "describe ", "what is ", "what are ", "tell me about ", "how does ", "define "]
REWRITE_STOPWORDS = "a an the of to for in on at by with and or but is are was were be as from into about".split()
DOMAIN_WORDS = ["prove", "derive", "factorise", "factorize", "differentiate", "integrate", "solve for", "find the"]
DOMAIN_GLYPHS = ["=", "²", "³", "√"]
REWRITE_TOKENS, FALLBACK_TOKENS = 4, 6

# Words that carry no concept in questions, and in slugs.
QUESTION_STOPWORDS = (
    "what where when which while with without this that these those they them their there here have having does doing done from into onto "
    "than then some much many more most less least your yours would could should about also just only very really actually still always "
    "never even again ever every each between because before after during explain describe show tell help please thanks find give make want "
    "need trying stuck confused remember forgot understand thing stuff step steps part parts type types kind kinds form forms different same "
    "first second third next another other such like calculate compute work works working solve answer question problem exam paper year years"
).split()
SLUG_STOPWORDS = ["part", "intro", "introduction", "revision", "review"]

# Symbols that a cache key takes as the same.
SYMBOLS = {"×": "*", "·": "*", "÷": "/", "−": "-", "–": "-", "—": "-", "≤": "<=", "≥": ">=", "≠": "!=", "≈": "~=", "²": "^2", "³": "^3"}

# Retrieval and evaluation.
TOP_K, SCORE_FLOOR, RRF_K, HYBRID_CANDIDATES = 5, 0.30, 60, 50
BLEND_RERANK, BLEND_COSINE, BLEND_TEXT = 0.6, 0.3, 0.1
BM25_K1, BM25_B = 1.5, 0.75
GATE_P1, THRESHOLDS, FLOOR_PERCENTILE = 0.911, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7], 0.05
DISTINCTIVE_DF, OVERLAP, COMMON_SUBSTRING = 2, 2, 6

# Limits of the gates. Of a tier: requests a minute and a day (None: no cap).
TIER_LIMITS = {"anonymous": (1, 2), "authenticated": (5, 30), "paying": (60, None)}
SUBNET_HOUR, SUBNET_DAY, SUBNET_BREACHES, FLAG_SECONDS = 12, 30, 3, 7 * 86400
BREAKER_FAILURES, BREAKER_WINDOW, BREAKER_OPEN = 5, 60, 300
SPEND_CAPS = {"anonymous": 0.50, "free": 2.00, "global": 5.00}
CACHE_TTL_DAYS, SINK_ROWS, SINK_SECONDS, AUDIO_CHUNK_SECONDS = 30, 100, 30, 900
PLACEHOLDERS = ["TBD", "tbd", "???", "TODO", "FIXME", "XXX"]

# What makes a figure worth drawing, as patterns in a question or slug prefixes.
GRAPH_PATTERNS = [
    r"\bsketch\b", r"\bgraph\b", r"\bplot\b", r"\binequalit\w*\b", r"\bshapes?\s+of\b", r"\bmodulus\b", r"\bvenn\b", r"\bargand\b", r"\bargument\b",
    r"\bmodulus and argument\b", r"\bpolar form\b", r"\bmutually exclusive\b", r"\bconditional probabilit\w*\b", r"\bindependent events?\b", r"\bdraw\b",
    r"\bbehaviour at infinity\b", r"\bbehavior at infinity\b", r"\bturning point\b", r"\bturning points\b", r"\basymptote\b", r"\basymptotes\b", r"\bcurve\b",
    r"\bvisualise\b", r"\bvisualize\b", r"\bwhat does .* look like\b",
]
GRAPH_PREFIXES = ["functions-graphs-", "trigonometry-", "statistics-", "indices-logs-", "differentiation-"]

# The anchor override, evidence, and costs.
ANCHOR_STOPWORDS = "explain describe tell about what are the with from this that have does where when which give list".split()
ANCHOR_FLOOR, ANCHOR_LENGTH, EVIDENCE_CHUNKS, DWELL_MS = 0.01, 4, 4, 1500
SNIPPETS = {"tutorials": 2000, "solutions": 2200, "summaries": 800}
EUR_PER_USD, FALLBACK_EUR = 0.92, 0.0005
#: Of a model class: USD for a million input and output tokens, or for a call.
PRICES = {"small": (1.0, 5.0, None), "large": (3.0, 15.0, None), "warehouse": (None, None, 0.0005), "analyst": (None, None, 0.001), "none": (None, None, 0.0002)}
