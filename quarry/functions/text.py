"""Column expressions on text: classification, parsing, keys and trimming."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry import rules


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Null-safe: whether ``c`` contains one of the phrases, without regard to case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return any_of([F.contains(low, F.lit(p.lower())) for p in phrases])


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    low = F.coalesce(c, F.lit(""))
    return any_of([low.rlike(f"(?is){p}") for p in patterns])


def word_in(c: Column, word: str) -> Column:
    """Whether ``word`` stands in ``c`` between word boundaries, without regard to case."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(rf"\b{word}\b")


def first_match(rules_: Sequence[tuple[Column, str]], default: Column | None = None) -> Column:
    """The label of the first test that holds."""
    out = reduce(lambda c, r: c.when(r[0], F.lit(r[1])), rules_[1:], F.when(rules_[0][0], F.lit(rules_[0][1])))
    return out.otherwise(default) if default is not None else out


def classify(query: Column) -> Column:
    """The route of a question: ambiguous, analytical, solution_lookup, summary_request or concept."""
    analytical = contains_any(query, rules.ANALYTICAL_PHRASES) | matches_any(query, rules.ANALYTICAL_PATTERNS)
    conceptual = any_of([word_in(query, w) for w in rules.CONCEPTUAL_WORDS])
    return first_match(
        [
            (F.trim(F.coalesce(query, F.lit(""))) == "", "concept"),
            (analytical & conceptual, "ambiguous"),
            (analytical, "analytical"),
            (matches_any(query, rules.SOLUTION_PATTERNS), "solution_lookup"),
            (contains_any(query, rules.SUMMARY_PHRASES), "summary_request"),
        ],
        F.lit("concept"),
    )


def matched_phrases(query: Column, phrases: Sequence[str]) -> Column:
    """The phrases that a question contains, each once, in their order."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(contains_any(query, [p]), F.lit(p)) for p in phrases))))


def first_int(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), f"(?i){pattern}", group), F.lit("")).cast("int")


def parse_reference(query: Column) -> Column:
    """struct(year, paper, question_number, sitting) of a reference to an exam question; sitting only beside a year."""
    year = first_int(query, r"\b((?:19|20)\d{2})\b")
    sitting = F.when(year.isNotNull(), F.when(matches_any(query, [r"\bdeferred\b|\bdf\b"]), "df").otherwise("main"))
    return F.struct(
        year.alias("year"), first_int(query, r"\b(?:p|paper)\s*([12])\b").alias("paper"), first_int(query, r"\bq(?:uestion)?\s*0*(\d+)").alias("question_number"), sitting.alias("sitting")
    )


def parse_file_name(name: Column) -> Column:
    """struct(year, paper, sitting) of a solutions file, in any order of its paper and deferral marks; null for other names."""
    ok = name.rlike(r"^\d{4}(_(DF|P[12])){1,3}_solutions\.md$") & name.rlike(r"_P[12]_")
    parsed = F.struct(
        F.regexp_extract(name, r"^(\d{4})", 1).cast("int").alias("year"), F.regexp_extract(name, r"_P([12])_", 1).cast("int").alias("paper"), F.when(name.contains("_DF"), "df").otherwise("main").alias("sitting")
    )
    return F.when(ok, parsed)


def sub_part(letter: Column, roman: Column) -> Column:
    """a, b(ii), (i), or null."""
    tail = F.when(roman != "", F.concat(F.lit("("), roman, F.lit(")")))
    return F.when(letter != "", F.concat(letter, F.coalesce(tail, F.lit("")))).otherwise(tail)


def part_id(year: Column, sitting: Column, paper: Column, question: Column, letter: Column, roman: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("_"), sitting, F.lit("_P"), paper.cast("string"), F.lit("_Q"), question.cast("string"), F.coalesce(letter, F.lit("")), F.coalesce(roman, F.lit("")))


def strand_before_number(slug: Column) -> Column:
    """What stands before the first purely numeric segment, or all of the slug."""
    return F.when(slug.rlike(r"^.+?-[0-9]+(-|$)"), F.regexp_extract(slug, r"^(.+?)-[0-9]+(-|$)", 1)).otherwise(slug)


def strand_by_prefix(slug: Column, strands: Sequence[str], default: Column | None = None) -> Column:
    """The first strand, longest first, that starts the slug and ends at a hyphen."""
    low = F.lower(slug)
    return first_match([(low.startswith(s + "-"), s) for s in sorted(strands, key=lambda s: -len(s))], default)


def folder_title(folder: Column) -> Column:
    """Prefix_The_Line to The Line."""
    return F.replace(F.regexp_replace(folder, r"^[A-Z]+_", ""), F.lit("_"), F.lit(" "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-")), r"[^a-z0-9_-]", "")


def shorten(c: Column, n: int) -> Column:
    """Trimmed, and cut to n characters with an ellipsis if longer."""
    t = F.trim(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…"))).otherwise(t)


def cut_at_section(c: Column, n: int) -> Column:
    """Cut to n characters, back to the last heading, else paragraph, else line, beyond the middle."""
    head = F.substring(c, 1, n)
    last = lambda mark: F.length(head) - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 2
    found = lambda mark: (F.instr(F.reverse(head), mark[::-1]) > 0) & (last(mark) - 1 > n // 2)
    cut = lambda mark: F.rtrim(head.substr(F.lit(1), last(mark) - 1))
    return F.when(F.length(c) <= n, c).when(found("\n## "), cut("\n## ")).when(found("\n\n"), cut("\n\n")).when(found("\n"), cut("\n")).otherwise(head)


def join_capped(parts: Column, cap: int) -> Column:
    """Trimmed parts that are not empty, one a line, up to the first that would exceed the cap."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(a: Column, p: Column) -> Column:
        longer = F.when(a.out == "", p).otherwise(F.concat(a.out, F.lit("\n"), p))
        over = F.length(longer) > cap
        return F.struct(F.when(a.full | over, a.out).otherwise(longer).alias("out"), (a.full | over).alias("full"))

    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")
    return F.aggregate(kept, start, step, lambda a: a.out)


def normalise_query(c: Column) -> Column:
    """Lower case, one spelling of symbols, single spaces."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.regexp_replace(reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), rules.SYMBOLS.items(), low), r"\s+", " ")


def cache_key(query: Column, tier: Column, model: Column, slugs: Column) -> Column:
    """SHA-256 over the normalised query and what the answer depends on, in any order of slugs."""
    return F.sha2(F.concat_ws("\u0001", normalise_query(query), tier, model, F.array_join(F.array_sort(slugs), ",")), 256)


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def content_tokens(c: Column, least: int = 4, stop: Sequence[str] = ()) -> Column:
    """Distinct tokens of ``least`` or more characters that are neither numbers nor stop words."""
    low = F.replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("²"), F.lit("2")), F.lit("³"), F.lit("3"))
    # Trimming only shortens, so short words and repeated ones go before they are looked at one by one.
    long = F.array_distinct(F.filter(F.split(low, r"[\s?.,()'\"/\\]+"), lambda t: F.length(t) >= least))
    clean = F.transform(long, lambda t: F.btrim(t, F.lit("-:;!")))
    return F.array_distinct(F.filter(clean, lambda t: (F.length(t) >= least) & ~t.rlike(r"^[0-9]+$") & ~t.isin(list(stop) or [""])))


def slug_tokens(slug: Column, strands: Sequence[str], stop: Sequence[str] = rules.SLUG_STOPWORDS) -> Column:
    """Distinct concept words of a slug: without its strand, numbers, stop words and words of under four characters."""
    low = F.lower(F.coalesce(slug, F.lit("")))
    rest = F.coalesce(F.substring(low, F.length(strand_by_prefix(low, strands)) + 2, F.length(low)), low)
    return F.array_distinct(F.filter(F.split(rest, "-"), lambda t: (F.length(t) >= 4) & ~t.rlike(r"^[0-9]+$") & ~t.isin(list(stop) or [""])))


def rewrite_tokens(c: Column) -> Column:
    """How many words bear content: stop words and words of signs alone do not count."""
    clean = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}_']+", ""))
    return F.size(F.filter(clean, lambda t: (t != "") & ~t.isin(rules.REWRITE_STOPWORDS)))


def strip_prefix(c: Column) -> Column:
    """What follows a conceptual prefix, or null."""
    low = F.lower(F.trim(c))
    return reduce(lambda out, p: out.when(low.startswith(p), low.substr(F.lit(len(p) + 1), F.length(low))), rules.CONCEPTUAL_PREFIXES[1:], F.when(low.startswith(rules.CONCEPTUAL_PREFIXES[0]), low.substr(F.lit(len(rules.CONCEPTUAL_PREFIXES[0]) + 1), F.length(low))))


def in_domain_language(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"\$[^$]+\$") | any_of([F.contains(c, F.lit(g)) for g in rules.DOMAIN_GLYPHS]) | contains_any(c, rules.DOMAIN_WORDS)


def should_rewrite(query: Column, route: Column) -> Column:
    """Whether a short conceptual question should be put in domain language before retrieval."""
    short = rewrite_tokens(strip_prefix(query)) <= rules.REWRITE_TOKENS
    return F.coalesce((route == "concept") & strip_prefix(query).isNotNull() & short & ~in_domain_language(query), F.lit(False))


def should_rewrite_after_miss(query: Column, route: Column) -> Column:
    return F.coalesce((route == "concept") & (F.trim(query) != "") & (rewrite_tokens(query) <= rules.FALLBACK_TOKENS) & ~in_domain_language(query), F.lit(False))


def clean_answer(c: Column) -> Column:
    """Trimmed, without one matching pair of quotes around it."""
    t = F.trim(c)
    return F.when(t.rlike(r"^(\"[\s\S]*\"|'[\s\S]*')$") & (F.length(t) >= 2), F.trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)


def phrasing_difficulty(phrasing: Column, topic: Column) -> Column:
    return F.when(topic.isin(rules.LOW_FREQUENCY_TOPICS), "auto-hard").when(F.length(phrasing) > 60, "auto-medium").otherwise("auto-easy")


def reference_difficulty(sitting: Column, n_refs: Column, year: Column) -> Column:
    return F.when((sitting == "df") | (n_refs > 2), "auto-hard").when((year >= 2022) | (n_refs >= 2), "auto-medium").otherwise("auto-easy")


def subnet(ip: Column) -> Column:
    """/24 of an IPv4 address, /48 of an IPv6 one."""
    return F.when(ip.contains(":"), F.concat(F.substring_index(ip, ":", 3), F.lit("::/48"))).otherwise(F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def clock(seconds: Column) -> Column:
    """[MM:SS] of a position in seconds."""
    s = F.floor(seconds).cast("int")
    return F.format_string("**[%02d:%02d]**", (s / 60).cast("int"), s % 60)


def is_placeholder(c: Column) -> Column:
    bare = F.regexp_replace(F.trim(c), r"^[.:!,;]+|[.:!,;]+$", "")
    return F.trim(c).isin(rules.PLACEHOLDERS) | F.regexp_replace(bare, r"^[?]+|[?]+$", "").isin(rules.PLACEHOLDERS)
