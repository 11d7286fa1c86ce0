"""Stems by the published examples of the rules, and stemmed search against plain Python."""

import math

from pyspark.sql import functions as F

from quarry.functions import stems
from quarry.operators import retrieval

# Words and stems of the rules' published sample vocabulary.
SAMPLE = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist",
    "consistent": "consist", "consistently": "consist", "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori",
    "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid", "consoling": "consol",
    "consolingly": "consol", "consols": "consol", "consonant": "conson", "consort": "consort", "conspicuous": "conspicu", "conspicuously": "conspicu", "conspiracy": "conspiraci",
    "conspirator": "conspir", "knack": "knack", "knackeries": "knackeri", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "knee": "knee", "kneel": "kneel", "kneeled": "kneel",
    "kneels": "kneel", "knell": "knell", "knightly": "knight", "knitting": "knit", "knives": "knive", "knocker": "knocker", "knots": "knot", "know": "know", "knowing": "know",
    "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "luxuriated": "luxuri", "generously": "generous", "communism": "communism",
    "say": "say", "by": "by", "cry": "cri", "skies": "sky", "exceeding": "exceed", "rational": "ration", "hopefulness": "hope", "falling": "fall", "controll": "control", "relational": "relat",
}


def test_published_stems():
    assert {w: stems.stem(w) for w in SAMPLE} == SAMPLE


def test_stemmed_search(spark):
    docs = [(1, "The knights are kneeling, the knaves kneel"), (2, "consoling and consolations"), (3, "a knight consoles"), (4, None), (5, "of the and")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    rows = frame.select("doc_id", stems.english_terms(F.col("text")).alias("t")).collect()
    terms = {r.doc_id: r.t for r in rows}
    assert terms == {1: ["knight", "kneel", "knave", "kneel"], 2: ["consol", "consol"], 3: ["knight", "consol"], 4: [], 5: []}
    asked = spark.createDataFrame([(7, "the consoled knight"), (8, "and of")], "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25_topk(asked, frame, stems.english_terms, 5).collect()}
    n, mean = 5, sum(map(len, terms.values())) / 5

    def score(d):
        total = 0.0
        for w in ("consol", "knight"):
            df, tf = sum(w in t for t in terms.values()), terms[d].count(w)
            total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * len(terms[d]) / mean))
        return round(total, 6)

    assert got == {(7, d): score(d) for d in (1, 2, 3)}
