"""Near duplicates, repeats, language and the pipeline against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import CLASHING, components, covered, documents, frame, repeats
from rootseek.llm import components as cc
from rootseek.llm import jaccard, language, shingles, suffixes
from rootseek.llm import repeats as rep


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.mark.parametrize("small", [24, 2])
def test_similar_documents_equal_brute_force(spark, rows, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    got = jaccard.join(frame(spark, rows), percent=85, width=4).collect()
    assert sorted(map(tuple, got)) == components(rows, 85, 4)


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_each_group_is_verified_by_one_set(spark, rows, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    some = rows[:60] + rows[220:260]
    apart = [(k << 23, t) for k, (_, t) in enumerate(some + some[:30] + some[-40:])] + [(0, t) for _, t in some[:20]]  # copies, with other ids and with equal ones
    most, verify = [], jaccard.verified

    def watched(pairs, sets, percent):
        most.append(sets.groupBy("gid").count().agg(F.max("count")).first()[0])
        return verify(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "verified", watched)
    got = jaccard.join(frame(spark, apart), percent=85, width=4).collect()
    assert sorted(map(tuple, got)) == components(apart, 85, 4)
    assert most and set(most) == {1}


def test_near_copies_below_the_threshold_are_told_apart_by_marks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    apart = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(3, 147), 2):
            words[at] = f"x{k}-{at}"
        apart.append((k, " ".join(words)))
    checked, made, verify = [], [], jaccard.verified

    def watched(pairs, sets, percent):
        checked.append(pairs.count())
        made.append(sets.join(pairs, (sets.gid == pairs.a) | (sets.gid == pairs.b), "left_anti").count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(jaccard, "verified", watched)
    got = jaccard.join(frame(spark, apart), percent=85, width=4).collect()
    assert sorted(map(tuple, got)) == components(apart, 85, 4)
    assert sum(checked) < 60 * 59 / 2 / 4  # all pairs meet in the shingles of the base
    assert not any(made)  # no whole set is made of a document without a pair


def test_leaders_are_near_to_most_texts_every_other_round(spark):
    entries = spark.createDataFrame([(t, g, 100, (g * 7 + t) % 40 + (g != 13) * 40) for t in range(3) for g in range(30)], "token long, gid long, n int, pos int")
    assert {r.gid for r in jaccard._leaders(entries, 0).collect()} == {13} == {r.gid for r in jaccard._leaders(entries, 2).collect()}
    assert jaccard._leaders(entries, 1).count() == 3


def test_marks_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 7, 100, 3000):
        for gone in (0, 1, n // 20, n // 8):
            whole = rng.integers(0, 1 << 64, n + gone, np.uint64)
            a, b = np.unique(whole[gone:]), np.unique(whole[: n])
            apart = sum(int(x).bit_count() for x in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b)) and apart % 2 == len(np.setxor1d(a, b)) % 2


def test_filter_spreads_ids_of_any_stride(spark):
    ids = spark.range(200).select((F.col("id") * (1 << 23) - (1 << 30)).alias("id"))
    bits = jaccard.bit_filter(ids.where("id % 3 = 0"), "id")
    passed = {r.id for r in jaccard.passing(ids.union(spark.createDataFrame([(None,)], "id long")), "id", bits).collect()}
    wanted = {r.id for r in ids.where("id % 3 = 0").collect()}
    assert wanted <= passed and len(passed) < len(wanted) + 5


def test_one_document_of_each_group_stays(spark, rows):
    df = frame(spark, rows)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    comp = {}
    sizes = {}
    for i, n, c in components([(k, t) for k, (_, t) in enumerate(rows)], 80, 5):
        comp[i], sizes[i] = c, n
    stays = len({c for i, c in comp.items() if sizes[i]}) + sum(1 for i in sizes if not sizes[i])
    texts = [r.text for r in kept.collect()]
    assert len(texts) == stays
    lone = {i for i in comp if sum(c == comp[i] for c in comp.values()) == 1}
    assert {rows[i][1] for i in lone if sizes[i]} <= set(texts)


def test_components_of_long_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(200, 100), (100, 150)]
    rng.shuffle(edges)
    got = dict(map(tuple, cc.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == i // 20 * 20 for i in range(60)) and {got[x] for x in (100, 150, 200)} == {100}


def test_no_documents(spark):
    none = spark.createDataFrame([], CLASHING)
    assert jaccard.join(none).count() == 0 and rep.digests(none).count() == 0
    assert jaccard.one_of_each(none).columns == none.columns and rep.without_repeats(none).count() == 0
    model = language.learn(none.withColumn("lang", F.lit("en")))
    assert model[0] == [] and language.predict(none, model).count() == 0


@pytest.mark.parametrize("many,steps", [(1000, (8, 1)), (2, (8, 1)), (2, (1,))])
def test_repeats_equal_brute_force(spark, rows, monkeypatch, many, steps):
    monkeypatch.setattr(rep, "MANY", many)
    monkeypatch.setattr(rep, "STEPS", steps)
    got = rep.digests(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == repeats(rows)


def test_frequent_grams_stay_out_of_blocks_when_the_filter_is_full(spark, rows, monkeypatch):
    monkeypatch.setattr(rep, "MANY", 2)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 32)
    most, sort = [], rep._sorted_runs

    def watched(strings, width):
        most.append(strings.groupBy("gram").agg(F.countDistinct("seg").alias("k")).agg(F.max("k")).first()[0] or 0)
        return sort(strings, width)

    monkeypatch.setattr(rep, "_sorted_runs", watched)
    got = rep.digests(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == repeats(rows)
    assert len(most) == 3 and max(most) <= 2


def test_texts_without_repeats(spark, rows):
    got = rep.without_repeats(frame(spark, rows))
    assert got.columns == [f.split()[0].strip("`") for f in CLASHING.split(", ")]
    want = [(i, None if t is None else bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")) for (i, t), b, gone in zip(rows, *covered(rows))]
    assert sorted(map(str, map(tuple, got.select("doc_id", "text").collect()))) == sorted(map(str, want))


def test_anchors_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(9000))
    whole = [x for x in rep._groups([text], 200)]
    monkeypatch.setattr(rep, "BYTES", 1000)
    cut = [x for x in rep._groups([text, b"short"], 200)]
    starts = lambda parts: sorted(int(f) + k for p in parts for f, w in zip(p[2], p[3]) for k in range(int(w)))
    places = lambda parts: {int(f) + k: int(f) + int(a) for p in parts for f, w, a in zip(p[2], p[3], p[4]) for k in range(int(w))}
    assert starts(whole) == starts(cut) == list(range(9000 - 199)) and places(whole) == places(cut)


def test_suffix_arrays_equal_sorting():
    rng = random.Random(1)
    for _ in range(150):
        letters, n = rng.choice([1, 2, 3, 20]), rng.choice([0, 1, 2, 5, 50, 300])
        text = np.array([rng.randrange(97, 97 + letters) for _ in range(n)] + [suffixes.SEPARATOR], np.uint8)
        data = text.tobytes()
        assert suffixes.suffix_array(text, 1000).tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    for _ in range(150):
        width, letters = rng.choice([3, 8, 13]), rng.choice([1, 2, 3])
        strings = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.choice([1, width, width + 3, 40]))) for _ in range(rng.choice([1, 2, 9]))]
        every = [s[i : i + width] for s in strings for i in range(len(s) - width + 1)]
        want = [[every.count(s[i : i + width]) > 1 for i in range(len(s) - width + 1)] for s in strings]
        assert [x.tolist() for x in suffixes.repeated_windows(strings, width)] == want


def test_shingles_of_long_texts_go_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(20_000))
    (whole,) = shingles.sets([text], 4)
    monkeypatch.setattr(shingles, "BYTES", 5000)
    (cut,) = shingles.sets([text], 4)
    assert (whole == cut).all() and len(whole) == 977


def language_rows():
    rng = random.Random(4)
    parts = {"aa": ["ing", "the", "sh", "er", "wh"], "bb": ["ción", "ñas", "ell", "rr"], "cc": ["über", "sch", "tz", "keit"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randrange(5, 60))), lang) for i in range(300) for lang in [rng.choice(list(parts))]], word


def test_language_of_held_out_documents(spark):
    made, word = language_rows()
    mixed = " ".join([word("aa") for _ in range(70)] + [word("bb") for _ in range(30)])
    awkward = [(1000, None, None), (1001, "", "aa"), (1002, " 12 $ ", None), (1003, mixed, None), (1003, mixed, None), (None, word("cc"), None), (1004, "Über" * 300_000, "cc")]
    df = spark.createDataFrame([(*r, 1, "x") for r in made + awkward], "doc_id long, text string, lang string, id int, lang_pred string").repartition(4)
    model = language.learn(df.where(~language.held_out()))
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    truth = {i: lang for i, _, lang in made}
    out = [r.doc_id for r in df.where(language.held_out()).select("doc_id").collect() if r.doc_id in truth]
    assert len(out) > 30 and np.mean([got[i].lang_pred == truth[i] for i in out]) >= 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "aa" and 0.6 < got[1003].score < 0.8
    assert got[None].lang_pred == got[1004].lang_pred == "cc"
    assert language.predict(df, model).count() == len(made) + len(awkward)
    kept = language.accepted(df, model, 1 / 3)
    assert kept.columns == df.columns and kept.count() == len(made) + len(awkward) - 3
    assert language.accepted(df, ([], model[1]), 1 / 3).count() == kept.count()
    assert {r.lang_pred for r in language.predict(df, ([], model[1])).collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    made, word = language_rows()
    passage = " ".join(word("aa") for _ in range(60))
    extra = [(2000, None, None), (2001, "77 ..", None), (2002, made[0][1], "aa"), (2003, made[1][1] + " " + passage, "aa"), (2004, made[2][1] + " " + passage, "bb")]
    rows_in = [(i, t, lang, "s", len(t or "")) for i, t, lang in made + extra]
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path / "sf")).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        assert k == 3 or docs.columns == columns
    assert sorted(r.doc_id for r in kept["language"].collect()) == sorted(r[0] for r in rows_in if r[0] not in (2000, 2001))
    after = [(r.doc_id, r.text) for r in kept["language"].collect()]
    want = {i for i, n, c in components(after, 80, 5) if i == c}
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == want and 2002 not in want
    before = sorted((r.doc_id, r.text) for r in kept["near_duplicates"].collect())
    cut = {i: bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") for (i, _), b, gone in zip(before, *covered(before))}
    assert {r.doc_id: r.text for r in kept["repeats"].collect()} == cut
    assert all(r.n_chars == len(r.text) for r in kept["repeats"].collect()) and passage not in cut[2003]
    assert {r.doc_id for r in kept["packing"].collect()} == want
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == kept["packing"].count()
