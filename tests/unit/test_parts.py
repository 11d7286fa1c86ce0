"""The part views, the semantic layer and the parsers on small made-up rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import rules
from quarry.functions import text as T
from quarry.operators import parts
from quarry.plans import semantic
from quarry.sources import markdown, tables

SCHEMA = (
    "part_id string, year int, paper int, sitting string, question_number int, sub_part string, section string, marks int, topic string, secondary_topics array<string>, "
    "tutorials_referenced array<string>, question_text string, solution_text string, common_pitfalls string, marking_scheme_note string, source_path string, loaded_at timestamp"
)


def part(i, q=1, topic=None, refs=None, year=2022, paper=1, sitting="main", text=None, note=None, marks=5):
    return (f"p{i}", year, paper, sitting, q, None, "A", marks, topic, [], refs, text, None, None, note, "f", dt.datetime(2024, 1, 1))


@pytest.fixture(scope="module")
def exam(spark):
    rows = [part(i, 100 + i, t[0] if t else None, None if t else [f"{s}-1-x"]) for i, (s, t) in enumerate(rules.STRAND_TOPICS.items())]
    rows += [
        part(50, 1, "derivative of a quadratic"), part(51, 2, None, None), part(52, 2, "sequence"), part(53, 2, "slope of the line"), part(54, 3, "nothing", []),
        part(55, 4, "INTEGRATION", ["the-line-2-a", "algebra-1-b"], text="Prove that"), part(56, 5, "x", ["zzz"], text="then verify it", note="is Load-Bearing here", year=2019, sitting="df"),
        part(57, 6, "theorem 13"), part(58, 7, None, ["my-algebra-2"], text="approve it"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_flat_view(exam):
    got = {r.part_id: r for r in parts.parts_flat(exam).collect()}
    for i, s in enumerate(rules.STRAND_TOPICS):
        assert got[f"p{i}"].topic_strand == s
    assert got["p50"].topic_strand == "algebra"
    assert (got["p51"].topic_strand, got["p52"].topic_strand, got["p53"].topic_strand) == ("the-line", "sequences-series", "the-line")
    assert got["p54"].topic_strand == "uncategorised" and got["p54"].tutorial_count == 0 and got["p51"].tutorial_count == 0
    assert got["p55"].topic_strand == "algebra" and got["p55"].has_proof_request and got["p55"].paper_strand_key == "1:algebra"
    assert got["p56"].is_load_bearing and got["p56"].has_proof_request and not got["p56"].is_recent and got["p55"].is_recent
    assert got["p57"].topic_strand == "geometry-1" and got["p58"].topic_strand == "algebra" and not got["p58"].has_proof_request


def test_by_tutorial_view(exam):
    got = {(r.part_id, r.tutorial_slug): r.tutorial_strand for r in parts.parts_by_tutorial(exam).collect()}
    assert got["p55", "the-line-2-a"] == "the-line" and got["p58", "my-algebra-2"] == "uncategorised"
    assert not any(p in ("p51", "p54") for p, _ in got)


def test_semantic_model(exam):
    model = semantic.parts_model(lambda: parts.parts_flat(exam), lambda: parts.parts_by_tutorial(exam))
    assert len(model.verified) == 10
    for run in model.verified.values():
        run().collect()
    assert model.answer("how often has INTEGRATION by parts appeared on paper 1 in the last five years").first().parts_count == 0
    by_year = {r.year: r.parts_count for r in model.query(["parts_count"], ["year"]).collect()}
    assert by_year[2019] == 1
    assert model.answer("marks per part by year").columns == ["year", "avg_marks_per_part"]
    assert model.answer("what is the weather") is None
    with pytest.raises(ValueError, match="no single view"):
        model.query(["parts_count", "citation_count"])


@pytest.mark.parametrize(
    ("query", "route"),
    [
        ("How often does integration appear?", "analytical"), ("why has the trend changed since 2020", "ambiguous"), ("How was 2024 P2 Q5 solved?", "solution_lookup"), ("tl;dr of algebra", "summary_request"),
        ("how many roots does it have", "concept"), ("how many questions on roots", "analytical"), ("two devs disagree", "analytical"), ("", "concept"), ("  ", "concept"), ("approve the trend", "analytical"),
        ("whyalla trend", "analytical"), ("walk me through Q5b from 2023", "solution_lookup"), ("what is a derivative", "concept"),
    ],
)
def test_classify(spark, query, route):
    assert spark.createDataFrame([(query,)], "q string").select(T.classify(F.col("q"))).first()[0] == route


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    ref = one(spark, "I'm stuck on 2024 P2 Q7(a), deferred", T.parse_reference)
    assert (ref.year, ref.paper, ref.question_number, ref.sitting) == (2024, 2, 7, "df")
    assert one(spark, "paper 1 q3", T.parse_reference).sitting is None
    for name, want in {"2025_P1_solutions.md": (2025, 1, "main"), "2025_DF_P1_solutions.md": (2025, 1, "df"), "2022_P1_DF_solutions.md": (2022, 1, "df"), "notes.md": None, "2022_DF_solutions.md": None}.items():
        got = one(spark, name, T.parse_file_name)
        assert (got and tuple(got)) == want
    assert one(spark, "the-line-7-circumcircle", T.strand_before_number) == "the-line" and one(spark, "plain", T.strand_before_number) == "plain"
    assert one(spark, "trigonometry-1-x", lambda c: T.strand_by_prefix(c, rules.FOLDER_STRANDS)) == "trigonometry-1"
    assert one(spark, "geometry-1-x", lambda c: T.strand_by_prefix(c, rules.REPORT_STRANDS, F.lit("unknown"))) == "unknown"
    assert one(spark, "ABCD_The_Line", T.folder_title) == "The Line"
    assert one(spark, "  abcdef  ", lambda c: T.shorten(c, 4)) == "abc…" and one(spark, " abc ", lambda c: T.shorten(c, 4)) == "abc"
    assert one(spark, "aaaaaaaaaa\n## b\nccc", lambda c: T.cut_at_section(c, 16)) == "aaaaaaaaaa"
    assert one(spark, "explain what a surd is", T.strip_prefix) == "what a surd is" and one(spark, "hm", T.strip_prefix) is None
    assert one(spark, "explain surds", lambda c: T.should_rewrite(c, F.lit("concept"))) and not one(spark, "explain x = 2", lambda c: T.should_rewrite(c, F.lit("concept")))
    assert one(spark, ' "quoted" ', T.clean_answer) == "quoted" and one(spark, "\"half'", T.clean_answer) == "\"half'"
    assert one(spark, " 5 ×  4² ", T.normalise_query) == "5 * 4^2"
    assert one(spark, "???", T.is_placeholder) and one(spark, " TBD. ", T.is_placeholder) and not one(spark, "Tbd", T.is_placeholder)
    assert one(spark, "10.1.2.3", T.subnet) == "10.1.2.0/24" and one(spark, "2001:db8:1:2::3", T.subnet) == "2001:db8:1::/48"
    keys = [spark.range(1).select(T.cache_key(F.lit(q), F.lit("t"), F.lit("m"), F.array(*map(F.lit, s)))).first()[0] for q, s in ((" A × b", "xy"), ("a * B", "yx"), ("a * c", "xy"))]
    assert keys[0] == keys[1] != keys[2]


SOLUTIONS = """---
title: x
---
## Section A
## Question 3 (25 marks)
### Q3(a) — Solve it
**Topic:** Algebra basics.
**Tutorials:** [One](../../ABCD_Algebra/algebra-1-a.md),
[Two](../../ABCD_The_Line/the-line-2-b.md)
Some prose.
> **🎯 Watch out** for signs
> more
>
#### Step 1
Work (5 marks)
#### Marking-scheme cross-check
scheme text
### Q3(b)(i)
Body only
### Q3(b)(ii) - Last
> **🚨 Danger** zone
plain
## Question 7 (10 marks)
### Q7
Alone
*[End of paper]*
### Q8(a)
never
"""


def test_solutions(spark):
    files = spark.createDataFrame([("d/2025_DF_P1_solutions.md", "2025_DF_P1_solutions.md", SOLUTIONS), ("d/readme.md", "readme.md", SOLUTIONS)], "path string, name string, text string")
    got = {r.part_id: r for r in markdown.parse_parts(files).collect()}
    assert sorted(got) == ["2025_df_P1_Q3a", "2025_df_P1_Q3bi", "2025_df_P1_Q3bii", "2025_df_P1_Q7"]
    a, bi, bii, q7 = (got[k] for k in sorted(got))
    assert (a.topic, a.marks, a.sub_part, a.section) == ("Algebra basics", 5, "a", "A") and a.tutorials_referenced == ["algebra-1-a", "the-line-2-b"] and a.secondary_topics == ["Algebra", "The Line"]
    assert a.question_text.startswith("Solve it\n\nSome prose.") and a.marking_scheme_note == "scheme text" and a.common_pitfalls == "**🎯 Watch out** for signs\nmore"
    assert (bi.topic, bi.marks, bi.sub_part) == ("Algebra basics", 10, "b(i)") and bi.tutorials_referenced == a.tutorials_referenced
    assert bii.marks == 10 and bii.common_pitfalls == "**🚨 Danger** zone" and (q7.marks, q7.sub_part, q7.section, q7.topic) == (10, None, "A", None)


def test_summary_tables(spark):
    text = "# The Line — 90-Minute Exam Cram Summary\n## Top tutorials\n\n| rank | tutorial | n | tests |\n|---|---|---|---|\n| 1 | `the-line-7/8/9` | ~3 | slopes |\n| 2 | `the-line-1`, `x` | | |\n\n## Suggested time split\n| a | t | w |\n|---|---|---|\n| read | 10 min | why |\n| rest | later | |\n"
    files = spark.createDataFrame([("a.md", text)], "path string, text string")
    top = markdown.top_tutorials(markdown.tables(files, r"^## Top ")).orderBy("row").collect()
    assert [(r.rank, r.tutorials, r.citations, r.what_it_tests) for r in top] == [(1, ["the-line-7", "8", "9"], 3, "slopes"), (2, ["the-line-1", "x"], None, None)]
    split = markdown.time_split(markdown.tables(files, r"^## Suggested")).orderBy("row").collect()
    assert [(r.activity, r.minutes) for r in split] == [("read", 10), ("rest", None)]


def test_summary_tables_are_cut_without_a_shuffle(spark, capsys):
    head = "## Top\n| a | b |\n|---|---|\n"
    texts = {"two": f"{head}| 1 | x |\n\n| 2 | y |\n", "next": f"## Top\n## Other\n{head[7:]}| 1 | x |\n", "none": "| 1 | x |", "null": None, "end": f"{head}| 1 | x |\n| 2 | y |"}
    found = markdown.tables(spark.createDataFrame(list(texts.items()), "path string, text string"), r"^## Top")
    assert sorted((r.path, r.row, r.cells) for r in found.collect()) == [("end", 1, ["1", "x"]), ("end", 2, ["2", "y"]), ("two", 1, ["1", "x"])]
    found.explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and plan.count("split(text") == 1


def test_tutorials(spark):
    good = "---\nslug: s-1\ntitle: T\nkeywords: k\ncommon_student_phrasings:\n  - how do I\n  - how do I\n  - |z| = 1\ntechniques_taught: [a, b]\ntechniques_used: [b, c]\nsyllabus:\n  - strand: S\n    learning_outcomes: [x, y]\nsequence_number: TBD\n---\nBody\n"
    files = spark.createDataFrame([("a", good), ("b", "no front matter"), ("c", "---\ntitle: x\n---\n"), ("d", "---\n: [\n---\n")], "path string, text string")
    got = {r.path: r for r in markdown.tutorial_rows(files).collect()}
    a = got["a"]
    assert (a.slug, a.techniques, a.syllabus_strand, a.syllabus_reference, a.sequence_number, a.body.strip(), a.error) == ("s-1", ["a", "b", "c"], "S", "x; y", None, "Body", None)
    assert a.title_plus_phrasings == "T\nk\nhow do I\nhow do I\n|z| = 1"
    assert got["b"].error == got["c"].error == "no_slug" and got["d"].error.startswith("yaml")
    phrasings = markdown.phrasing_rows(markdown.tutorial_rows(files)).orderBy("eval_id").collect()
    assert [(r.eval_id, r.question_text) for r in phrasings] == [("phr-s-1-001", "how do I"), ("phr-s-1-002", "|z| = 1")]


def test_structured_sources(spark, tmp_path):
    golden = spark.createDataFrame([("b", "q,1", "s", "phrasings", True), ("a", 'q "2"', "s", "phrasings", False)], "eval_id string, question_text string, expected_slug string, source string, is_in_golden_subset boolean")
    golden = golden.withColumn("source_metadata", F.expr("named_struct('topic', eval_id, 'part_id', 'P1')"))
    tables.write_golden_csv(golden, str(tmp_path / "g"))
    back = tables.read_golden_csv(spark, str(tmp_path / "g")).orderBy("eval_id").collect()
    assert [(r.eval_id, r.question_text, r.is_in_golden_subset, r.source_metadata.topic) for r in back] == [("a", 'q "2"', False, "a"), ("b", "q,1", True, "b")]
    (tmp_path / "c.jsonl").write_text('{"eval_id": "e", "hits": [["x", 0.5], ["y", 0.25]]}\n\n')
    assert [tuple(r) for r in tables.read_checkpoint(spark, str(tmp_path / "c.jsonl")).orderBy("rank").collect()] == [("e", 1, "x", 0.5), ("e", 2, "y", 0.25)]
    (tmp_path / "r.csv").write_text('question_text,top_k_slugs\nq,"a, b,"\nq,"c"\n')
    assert [(r.slug, r.score) for r in tables.read_replay(spark, str(tmp_path / "r.csv")).collect()] == [("c", 0.95)]
    (tmp_path / "b.csv").write_text("strand,p_at_1\nx,0.5\ny,bad\n")
    assert [tuple(r) for r in tables.read_baselines(spark, str(tmp_path / "b.csv")).collect()] == [("x", 0.5)]
    (tmp_path / "l.txt").write_text("# c\n\nurl1 slug one\nurl2\n")
    assert [tuple(r) for r in tables.read_list(spark, str(tmp_path / "l.txt")).collect()] == [("url1", "slug one"), ("url2", None)]
    (tmp_path / "s.json").write_text('{"chunk": 1, "segments": [{"start": 1.5, "end": 2, "text": " hi "}]}')
    assert tables.read_segments(spark, str(tmp_path / "s.json")).first().line == "**[15:01]** hi"
    paths = {"tutorials/AB_X/a.md": "tutorials", "tutorials/AB_X/_SUMMARY-x.md": "summaries", "tutorials/AB_Maths_Exams/Solutions/2022_P1_DF_solutions.md": "exam_solutions", "tutorials/SCHEMA.md": "schema", "other/x.md": None, "tutorials/AB_Maths_Exams/x.md": None}
    for path, want in paths.items():
        assert one(spark, path, tables.classify_path) == want
