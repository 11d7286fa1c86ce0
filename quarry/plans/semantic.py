"""A small semantic layer: views with named dimensions and measures, verified questions, and their matching.

Measures are compiled to one ``groupBy().agg()``; a query that mixes views is
refused, since their rows have different grains.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Item:
    """A dimension or measure: its expression and what people call it."""

    expr: Callable[[], Column]
    synonyms: tuple[str, ...] = ()


@dataclass(frozen=True)
class View:
    name: str
    source: Callable[[], DataFrame]
    dimensions: Mapping[str, Item]
    measures: Mapping[str, Item]


@dataclass
class Model:
    views: Mapping[str, View]
    verified: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def view_of(self, names: Sequence[str]) -> View:
        """The one view that has all names."""
        found = [v for v in self.views.values() if all(n in v.dimensions or n in v.measures for n in names)]
        if not found:
            raise ValueError(f"no single view has {', '.join(names)}")
        return found[0]

    def query(self, measures: Sequence[str], dimensions: Sequence[str] = (), where: Column | None = None, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
        view = self.view_of([*measures, *dimensions])
        df = view.source()
        df = df.where(where) if where is not None else df
        out = df.groupBy(*(view.dimensions[d].expr().alias(d) for d in dimensions)).agg(*(view.measures[m].expr().alias(m) for m in measures))
        out = out.orderBy(*order) if order else out
        return out.limit(limit) if limit else out

    def answer(self, question: str) -> DataFrame | None:
        """The verified query of this question, or else the measures and dimensions that it names, or None."""
        asked = plain(question)
        for known, run in self.verified.items():
            if plain(known) == asked:
                return run()
        for view in self.views.values():
            named = lambda items: [n for n, i in items.items() if any(re.search(rf"\b{re.escape(plain(s))}\b", asked) for s in (n.replace("_", " "), *i.synonyms))]
            if measures := named(view.measures):
                return self.query(measures, named(view.dimensions))
        return None


def plain(question: str) -> str:
    return re.sub(r"[^a-z0-9%-]+", " ", question.lower()).strip()


def parts_model(flat: Callable[[], DataFrame], by_tutorial: Callable[[], DataFrame]) -> Model:
    """The measures and dimensions of the two part views."""
    c = F.col
    count = lambda: F.count("*")
    dims = lambda *names: {n: Item(lambda n=n: c(n)) for n in names}
    parts = View(
        "parts", flat,
        {**dims("paper", "sitting", "section", "question_number", "is_recent"), "year": Item(lambda: c("year"), ("by year", "each year", "year by year")), "topic_strand": Item(lambda: c("topic_strand"), ("strand", "strands"))},
        {
            "parts_count": Item(count, ("parts", "how many parts")),
            "total_marks": Item(lambda: F.sum("marks"), ("marks in total",)),
            "avg_marks_per_part": Item(lambda: F.avg("marks"), ("average marks", "mean marks", "marks per part")),
            "avg_tutorials_per_part": Item(lambda: F.avg("tutorial_count")),
            "distinct_parts": Item(lambda: F.countDistinct("part_id")),
            "load_bearing_parts": Item(lambda: F.count_if(c("is_load_bearing")), ("load-bearing",)),
            "proof_parts": Item(lambda: F.count_if(c("has_proof_request")), ("proofs",)),
        },
    )
    cited = View(
        "citations", by_tutorial,
        {**dims("sitting", "topic_raw"), "tutorial_slug": Item(lambda: c("tutorial_slug"), ("tutorial",)), "tutorial_strand": Item(lambda: c("tutorial_strand")), "paper": Item(lambda: c("paper")), "year": Item(lambda: c("year"))},
        {
            "citation_count": Item(count, ("citations", "cited", "most cited")),
            "distinct_parts_citing": Item(lambda: F.countDistinct("part_id")),
            "total_marks_at_stake": Item(lambda: F.sum("marks"), ("marks at stake",)),
        },
    )
    model = Model({"parts": parts, "citations": cited})
    model.verified = verified_queries(flat, by_tutorial)
    return model


def verified_queries(flat: Callable[[], DataFrame], by_tutorial: Callable[[], DataFrame]) -> dict[str, Callable[[], DataFrame]]:
    """The ten questions whose answers are fixed."""
    c, n = F.col, F.count("*").alias("parts_count")
    main = (c("sitting") == "main")
    like = lambda col, *pats: [c(col).ilike(p) for p in pats]
    one, two = main & (c("paper") == 1), main & (c("paper") == 2)
    roots = lambda *pats: like("topic_raw", *pats)[0] if len(pats) == 1 else like("topic_raw", *pats)[0] | roots(*pats[1:])

    def growth() -> DataFrame:
        era = lambda a, b, name: flat().where(two & c("year").between(a, b)).groupBy("topic_strand").agg(F.count("*").alias(name))
        both = era(2020, 2025, "r").join(era(2015, 2019, "p"), "topic_strand", "full_outer").na.fill(0, ["r", "p"])
        return both.select("topic_strand", c("p").alias("prior_2015_2019"), c("r").alias("recent_2020_2025"), (c("r") - c("p")).alias("delta")).orderBy(F.desc("delta"), "topic_strand")

    by_parts = lambda: flat().where(one & (c("topic_strand") == "integration") & c("year").between(2021, 2025) & (c("topic_raw").ilike("%integration by parts%") | c("solution_text").ilike("%integration by parts%"))).agg(n)
    ratio = F.round(F.count("*") * 1.0 / F.countDistinct("year"), 1).cast("double").alias("avg_parts_per_year_appeared")
    return {
        "How often has integration by parts appeared on Paper 1 in the last five years?": by_parts,
        "How many discriminant questions appear on Paper 1 each year?": lambda: flat().where(one & roots("%discriminant%", "%nature of roots%", "%nature of the roots%")).groupBy("year").agg(n).orderBy("year"),
        "What's the year-over-year trend of differentiation parts on Paper 1?": lambda: flat().where(one & (c("topic_strand") == "differentiation")).groupBy("year").agg(n).orderBy("year"),
        "Which Paper 2 strands have grown since 2020?": growth,
        "What's the average mark allocation for a 'nature of roots' question?": lambda: flat().where(roots("%nature of%root%", "%discriminant%")).agg(F.avg("marks").alias("avg_marks_per_part"), n),
        "Which single tutorial is cited most often on Paper 1 across all years?": lambda: by_tutorial().where(one).groupBy("tutorial_slug").agg(F.count("*").alias("citation_count")).orderBy(F.desc("citation_count"), "tutorial_slug").limit(10),
        "How does the strand mix differ between main and deferred sittings on Paper 2?": lambda: flat().where(c("paper") == 2).groupBy("topic_strand").agg(F.count_if(main).alias("main_parts"), F.count_if(c("sitting") == "df").alias("deferred_parts")).orderBy(F.desc("main_parts"), "topic_strand"),
        "How does the Paper 1 vs Paper 2 part count compare year by year?": lambda: flat().where(main).groupBy("year").agg(F.count_if(c("paper") == 1).alias("paper_1_parts"), F.count_if(c("paper") == 2).alias("paper_2_parts")).orderBy("year"),
        "What's the 10-year average number of parts per strand on Paper 1?": lambda: flat().where(one & c("year").between(2015, 2025)).groupBy("topic_strand").agg(F.count("*").alias("total_parts"), F.countDistinct("year").alias("years_appeared"), ratio).orderBy(F.desc("total_parts"), "topic_strand"),
        "Which differentiation parts on Paper 1 since 2020 carry ten or more marks?": lambda: flat().where(one & (c("topic_strand") == "differentiation") & (c("year") >= 2020) & (c("marks") >= 10)).select("part_id", "year", "question_number", "sub_part", "marks", "topic_raw").orderBy(F.desc("year"), "question_number", "sub_part"),
    }
