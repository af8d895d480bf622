import random

from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.llm import license_scan as L

SCHEMA = "doc_id long, text string"


def plain(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    """Every block against every rule, every place against every phrase."""
    words = L.words_of(text or "")
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        if hits:
            base.add(label)
            score = 1.0
    for label, clause in templates:
        all_words = L.words_of(clause)
        for k in range(0, len(all_words), L.STRIDE):
            t = set(all_words[k : k + L.STRIDE])
            for i in range(0, len(words), L.STRIDE):
                share = len(t & set(words[i : i + L.BLOCK_WORDS])) / len(t)
                if share >= threshold - 1e-12:
                    labels.add(label)
                    score = max(score, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def results(df):
    return sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in df.collect()), key=str)


def texts(n, seed):
    rng = random.Random(seed)
    filler = "alpha beta the of and is Überschrift 0 4 license software public notice".split()
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(0, 9)):
            words = rng.choice(L.TEMPLATES)[1].split() if rng.random() < 0.5 else rng.choice(list(L.PHRASES)).title().split()
            words = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.25])]
            out += words + rng.choices(filler, k=rng.randrange(0, 40))
        yield rng.choice([" ", "\n", ", "]).join(out)


def test_equals_every_block_against_every_rule(spark):
    rows = [(k, t) for k, t in enumerate(texts(120, 5))]
    got = results(L.scan_licenses(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted(((k, *plain(t)) for k, t in rows), key=str)
    assert sum(bool(r[6]) for r in got) > 60 and any(r[7] not in (0, 1) for r in got)


def test_blocks_have_their_spans(spark):
    clause = L.TEMPLATES[0][1]
    rows = spark.createDataFrame([(1, "x " * 50 + clause + " y" * 100)], SCHEMA)
    found = [r for r in L.license_blocks(rows).collect() if r.label == "mit" and not r.phrase]
    assert found and all(r.start % L.STRIDE == 0 and r.start < 50 + len(clause.split()) and r.end > 50 for r in found)
    assert max(r.containment for r in found) >= L.THRESHOLD


def test_other_templates_and_thresholds(spark):
    own = (("long", " ".join(f"w{k}" for k in range(70))), ("short", "one two three four five"))
    rows = [(1, " ".join(f"W{k}" for k in range(40))), (2, "one two three four"), (3, "one two three"), (4, None)]
    got = {r.doc_id: r.labels for r in L.scan_licenses(spark.createDataFrame(rows, SCHEMA), own, {}, 0.8).collect()}
    assert got == {1: "long", 2: "short", 3: "", 4: ""}
    got = {r.doc_id: r.labels for r in L.scan_licenses(spark.createDataFrame(rows, SCHEMA), own, {"three four": "short"}, 0.6).collect()}
    assert got[3] == "short" and got[2] == "short"


def test_nulls_empty_long_repeated_and_clashing(spark):
    long = "MIT License " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "mit license", "c"), (None, "mit license", "d"), (None, "MIT-License.", "d"), (3, long, "e"), (4, "KMIT Li̧cense mIt liCense", "f"), (5, "mİt license", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumnsRenamed({"words": "b_tokens"}).selectExpr("*", "1 as start", "2 as found", "3 as n_words", "'x' as labels")
    assert results(L.scan_licenses(df)) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    empty = spark.createDataFrame([], SCHEMA)
    assert L.scan_licenses(empty).collect() == [] and L.license_blocks(empty).collect() == []


def test_only_built_in_functions(spark, sf):
    plan = L.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from("mit license general public apache x the".split()), max_size=80))
def test_phrases_by_places(spark, words):
    text = " ".join(words)
    assert results(L.scan_licenses(spark.createDataFrame([(1, text)], SCHEMA))) == [(1, *plain(text))]
