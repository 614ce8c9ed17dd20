"""The pipeline's stages on a small table with odd rows and names, against plain versions of each."""

import re

import pytest

import corpus_pipeline
from matchloom.llm import linededup, toxicity
from matchloom.llm.quality import Page, all_rules

COLUMNS = "doc_id long, text string, `a.b` int, source string, rid string, lang string, row string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    texts = [t + ("\nread more of this here" if t and i % 2 else "") for i, t in enumerate(texts)]
    texts += [None, "", " \n ", texts[3], texts[3] + " tail", f"{texts[5]}\n{item}", "word " * 6000]
    return spark.createDataFrame([(i, t, i, None if i == 7 else "h" if i % 2 else "g", "x", "en", "r") for i, t in enumerate(texts)] + [(None, texts[9], 1, "g", "x", None, "r"), (3, texts[3], 3, "h", "x", "en", "r")], COLUMNS).repartition(3)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_quality_rules_keep_what_no_rule_rejects(spark, sf, docs):
    rules = all_rules(toxicity.fit(toxicity.labelled(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels")))))
    wanted = sorted(repr(tuple(r)) for r in docs.collect() if not any(f(Page(r.text.encode() if r.text is not None else None)) for f in rules.values()))
    got = corpus_pipeline.quality_rules(spark, docs, sf)
    assert got.schema == docs.schema and rows(got) == wanted and 0 < len(wanted) < docs.count()


@pytest.mark.parametrize("most", [linededup.MOST_LINES, 0])
def test_line_dedup_by_plain_counting(spark, docs, most):
    """By the broadcast and by the join."""
    all_rows, pages, lines = docs.collect(), {}, {}
    cut = lambda t: [(x, x.strip(" \t\n\v\f\r")) for x in t.split("\n")]
    for r in all_rows:
        if r.source is not None and r.text is not None:
            pages.setdefault(r.source, set()).add(r.text)
            for _, k in cut(r.text):
                if k:
                    lines.setdefault((r.source, k), set()).add(r.text)
    drop = {key for key, found in lines.items() if len(found) >= 2 and len(found) > 0.1 * len(pages[key[0]])}
    wanted = [(r.doc_id, None if r.text is None else "\n".join(x for x, k in cut(r.text) if (r.source, k) not in drop), *r[2:]) for r in all_rows]
    got = linededup.dedup_lines(docs, most=most)
    assert got.columns == docs.columns and rows(got) == sorted(map(repr, wanted)) and drop


def test_near_duplicates_keep_one_of_each(spark, sf, docs):
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs.where("doc_id is not null"), sf).collect()]
    texts = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in texts.items()}
    assert len(got) == len(set(got))
    for i in texts:
        # a document that went has one that stays and is like it
        assert i in got or any(shingles[i] == shingles[j] or len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]) for j in got)
    assert len({3, 63, 64} & set(got)) == 1


def test_decontamination_drops_what_holds_a_passage(spark, sf, docs):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = fold(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [fold(t)] for n in sizes for i in range(len(w) - n + 1))
    got = corpus_pipeline.decontamination(spark, docs, sf)
    assert got.columns == docs.columns and rows(got) == sorted(repr(tuple(r)) for r in docs.collect() if not hit(r.text))
    assert 65 not in {r.doc_id for r in got.collect()}


def test_stages_take_empty_tables_and_odd_names(spark, sf, docs):
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == docs.columns, name
            df = spark.createDataFrame(out.collect(), docs.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, df, sf).collect()
        assert sorted({r.doc_id for r in packed}, key=repr) == sorted({r.doc_id for r in df.collect()}, key=repr)
