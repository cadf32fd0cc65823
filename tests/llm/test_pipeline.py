import itertools
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from cadaspark.llm import plans
from test_pairs import brute

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in plans.op5_quality(spark, SF).where("predicted = 1").collect()}
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality classifier"](spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == good
    second = stages["language ID"](spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} <= good
    third = stages["n-gram Jaccard join"](spark, second, SF).collect()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert sorted(r.doc_id for r in third) == sorted({c for _, _, c in brute(rows, percent=80, width=5)})
    done = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in done} == {r.doc_id for r in third}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in third:
        pieces = sorted((p for p in done if p.doc_id == r.doc_id), key=lambda p: p.start)
        ids = np.frombuffer(b"".join(bytes(p.ids_le) for p in pieces), dtype="<u4").tolist()
        assert ids == tokenizer.encode(r.text, add_special_tokens=False).ids + [0]


def test_stages_take_odd_rows(odd):
    spark = odd.sparkSession
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).select("doc_id").distinct().count() == 10


def test_checks_are_sql_of_registered_queries():
    checks = __spark_entry__.oracle_sql()
    assert set(checks) <= set(__spark_entry__.queries()) and all(isinstance(v, str) for v in checks.values())


def five_words(text):
    words = text.lower().split()
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_duplicates_stage_links_five_words_at_80(spark):
    """Copies with one word in 50 replaced: 0.82 by five words, 0.89 by three; and others on either side of the bar."""
    rng = random.Random(11)
    texts = []
    for n, changes in [(100, 2)] * 8 + [(50, 1)] * 8 + [(100, 1), (100, 3), (100, 4), (200, 4), (200, 6), (30, 1), (12, 1), (4, 1)]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        copy = list(words)
        for i in range(changes):
            copy[(2 * i + 1) * n // (2 * changes)] = "other"
        texts += [" ".join(words), " ".join(copy)]
    rows = list(enumerate(texts))
    sets = {i: five_words(t) for i, t in rows}
    label = {i: i for i in sets}
    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    assert all(label[2 * i + 1] == 2 * i for i in range(16)) and len(set(label.values())) > 26
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = plans.stage_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.values()))


def test_short_clean_texts_stay_and_other_languages_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.text for r in plans.stage_language(spark, docs, sf).select("text").collect()}
    english = [r.text for r in docs.where("lang = 'en'").collect()]
    short = [" ".join(t.split()[:4]) for t in english if t and len(t.split()) > 60 and t[:40].replace(" ", "").isalpha()][:40]
    other = ["Добрый день, как ваши дела сегодня? Всё хорошо, спасибо.", "これはとても短い文章です。", "12 34 / 56"]
    rows = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate([*short, *other])]
    more = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    stayed = {r.text for r in plans.stage_language(spark, more, sf).where("doc_id >= 1000000").collect()}
    assert len(short) > 10 and stayed == set(short) and len(kept) > 0.9 * docs.select("text").distinct().count()
