"""Problems on texts: brute force, the tokenizer library, packing invariants, learnt scores."""

import base64
import collections
import os
import random
import re
from types import SimpleNamespace

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import abuse, encode, ngrams, packing, queries
from parcelspark.llm.cut import cut

TEXTS = [None, "", "   ", "Hello world", "<|endoftext|> it's", "é漢字 ١٢ x y\r\n\t  z", "a" * 3000, "﻿BOM", "def f(x):\n\treturn x**2  # don't", "👍🏽 naïve ﬁ", "=" * 777, "tok tok tok", "tok tok tok"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, small, name):
    assert oracle.compare(spark, con, queries.QUERIES[name], queries.SQL[name], small) == ""


def brute_terms(rows, longest):
    occ, rec = collections.Counter(), collections.Counter()
    for text in rows:
        terms = [t for t in re.findall(r"[^\W_]+", text.lower())] if text else []
        grams = [" ".join(terms[i : i + k]) for i in range(len(terms)) for k in range(1, longest + 1) if i + k <= len(terms)]
        occ.update(grams)
        rec.update(set(grams))
    return {g: (occ[g], rec[g]) for g in occ}


@pytest.mark.parametrize("longest", [1, 3])
def test_terms(spark, longest):
    random.seed(7)
    rows = [" ".join(random.choice(["a", "B", "c-c", "d"]) for _ in range(random.randrange(9))) for _ in range(200)] + [None, "", "--", "a a a"] * 30
    df = spark.createDataFrame([(t, 1 if t else None) for t in rows], "value string, term int").withColumn("n", F.lit("clash"))
    got = {r["term"]: (r["occurrences"], r["records"]) for r in ngrams.term_frequencies(df, texts=["value"], longest=longest).where("field = 'value'").collect()}
    assert got == brute_terms(rows, longest)
    codes = ngrams.term_frequencies(df, codes=["term"]).collect()
    assert [(r["term"], r["records"], r["mark"]) for r in codes] == [("1", sum(map(bool, rows)), "common")]
    assert ngrams.term_frequencies(df.limit(0), texts=["value"]).count() == 0


def test_codes_with_blanks(spark):
    """A code is one term, whatever it holds."""
    df = spark.createDataFrame([("Theft over",)] * 5 + [("Theft",)] * 2 + [("Theft from car",)] * 3 + [("",), (None,)], "code string")
    got = {r["term"]: (r["length"], r["occurrences"], r["records"]) for r in ngrams.term_frequencies(df, codes=["code"]).collect()}
    assert got == {"Theft over": (1, 5, 5), "Theft": (1, 2, 2), "Theft from car": (1, 3, 3), "": (1, 1, 1)}


def test_hot_term_and_long_text(spark, monkeypatch):
    """A term of a third of all records, and a text far longer than what a task gathers."""
    monkeypatch.setattr(ngrams, "GATHER", 50)
    rows = ["hot a"] * 400 + [f"w{i} hot b{i % 7}" for i in range(600)] + [" ".join(f"t{i % 90}" for i in range(5000))]
    df = spark.createDataFrame([(t,) for t in rows], "value string").repartition(5)
    got = {r["term"]: (r["occurrences"], r["records"]) for r in ngrams.term_frequencies(df, texts=["value"]).collect()}
    assert got == brute_terms(rows, 3)


def library():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.isdir(encode.TOKENIZER_DIR), reason="no vocabularies")
def test_token_ids(spark, small):
    enc = library()
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: list(r["ids"]) for r in encode.token_ids(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in encode.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert encode.token_ids(df.limit(0)).count() == 0
    assert {r["doc_id"]: bytes(r["text"]) for r in encode.decoded(encode.token_ids(df)).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r[0]: r[1] for r in docs.collect()}
    assert all(list(r["ids"]) == (enc.encode_ordinary(texts[r["doc_id"]]) if texts[r["doc_id"]] else []) for r in encode.token_ids(docs).collect())


@pytest.mark.skipif(not os.path.isdir(encode.TOKENIZER_DIR), reason="no vocabularies")
def test_speculation():
    v, enc = encode.vocabulary(encode._ranks("byte_bpe_50k", encode.TOKENIZER_DIR)), library()
    r = random.Random(8)
    words = ["".join(r.choice(["a", "b", "the", "ing", "er", "x", "re", "st", "éà", "漢", "1", "=="]) for _ in range(r.randint(1, 12))).encode() for _ in range(3000)]
    exact = [enc._core_bpe.encode_single_piece(w) for w in words]
    assert v.encode(words) == exact and [v.merge(w) for w in words] == exact
    assert 0.2 < np.mean([v.propose(w) == e for w, e in zip(words, exact)]) < 1


def test_plan():
    r = random.Random(9)
    for case in range(600):
        capacity = r.randint(1, 40)
        counts = {s: r.choice([0, 0, 1, 2, 7]) for s in range(capacity + 1)}
        load, placed = collections.Counter(), collections.Counter()
        for size, first, last, container, per in packing.plan(capacity, counts):
            assert first == placed[size]
            placed[size] = last
            for i in range(first, last):
                load[container + (i - first) // per] += size
        assert {s: n for s, n in placed.items() if n} == {s: n for s, n in counts.items() if n}
        assert all(v <= capacity for v in load.values()) and set(load) == set(range(len(load)))


@pytest.mark.parametrize("limit", [packing.BROADCAST_ROWS, 0])
def test_pack(spark, limit, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", limit)
    random.seed(10)
    sizes = {i: random.choice([0, 5, 5, 5, 33, 60, 99, 100, 101, 450]) for i in range(2000)}
    df = spark.createDataFrame([*sizes.items(), (9000, None), (9001, -3)], "piece bigint, n_tokens bigint").withColumn("container", F.lit(1))
    specs = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0)], "spec_id int, capacity int")
    rows = packing.pack(df, specs, key="piece").toDF("spec_id", "key", "piece", "first_token", "n_tokens", "container").toPandas()
    for spec, capacity in ((1, 100), (2, 64)):
        own = rows[rows.spec_id == spec]
        assert own.groupby("container").n_tokens.sum().max() <= capacity
        assert own.groupby("key").n_tokens.sum().to_dict() == {**sizes, 9000: 0, 9001: 0}
        assert set(own.container) == set(range(own.container.max() + 1))
        pieces = own.groupby("key").size()
        assert all(pieces[k] == max(1, -(-s // capacity)) for k, s in sizes.items())
    assert set(rows.spec_id) == {1, 2}
    df = df.withColumnRenamed("piece", "doc_id")
    sound = df.select("doc_id", F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n_tokens"), F.lit("t").alias("tokenizer"))
    named = specs.withColumn("tokenizer", F.lit("t"))
    packed = packing.pack(df, specs)
    assert sorted(map(tuple, packing.faults(packed, sound, named).collect())) == [(1, 2002, 0, 0, 0), (2, 2002, 0, 0, 0)]
    broken = packed.where("doc_id <> 7").withColumn("container", F.when(F.col("container") == 1, 0).otherwise(F.col("container")))
    assert all(r["overfull"] == 1 for r in packing.faults(broken, sound.where("doc_id <> 7"), named).collect())
    assert packing.pack(df, specs.unionByName(spark.createDataFrame([(i, 50) for i in range(5, 1500)], specs.schema))).where("spec_id = 1499").count() >= 2002
    assert packing.fill(packing.pack(df, specs), specs).count() == 2
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


def test_abuse(spark):
    r = random.Random(11)
    plain = "the loader reads a frame and kills the worker process when the packet is stale".split()
    bad = ["you stupid idiot", "what a dumb moron", "idiot m o r o n get lost"]
    docs, labels = [], []
    for i in range(700):
        words = [r.choice(plain) for _ in range(r.randint(5, 200))]
        case = i % 8 == 0
        if case:
            words.insert(r.randrange(len(words)), r.choice(bad) if i % 16 else "you st​upid idiоt")
        docs.append((i, " ".join(words), "even" if i % 2 == 0 else None))
        if i < 500:
            labels += [(i, rater, int(case)) for rater in "ab"]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "…", "x")]
    labels += [(None, "a", 1), (3, "c", None), (3, "c", 7)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, offends int")
    got = {x["doc_id"]: x["offends"] for x in abuse.abuse_scores(d, lab, keep=("source",)).collect()}
    fresh = range(500, 700)
    assert np.mean([got[i] == (i % 8 == 0) for i in fresh]) > 0.97
    assert not got[1000] and not got[1001] and not got[1002] and len(got) == 703
    none = abuse.abuse_scores(d, lab.limit(0))
    assert none.where("offends").count() == 0 and none.count() == 703
    assert abuse.abuse_scores(d.limit(0), lab).count() == 0
    rates = abuse.abuse_rates(abuse.abuse_scores(d, lab, keep=("source",))).collect()
    assert {x["source"] for x in rates} == {"even", None, "x"} and sum(x["documents"] for x in rates) == 703


def test_abuse_of_all_texts(spark, monkeypatch):
    """p8: what only long texts and few confirmed ones show is learnt; and what fit keeps of the documents is scored as they are."""
    for name, most in (("CONFIRMED_ROWS", 20), ("MEMBER_ROWS", 100), ("OPEN_ROWS", 100)):
        monkeypatch.setattr(abuse, name, most)
    r = random.Random(13)
    plain = "the loader reads a frame and kills the worker process when the packet is stale".split()
    docs = []
    for i in range(1000):
        words = [r.choice(plain) for _ in range(20_000 if i % 64 == 0 else 30)]
        if i % 8 == 0 or i >= 996:
            words.insert(r.randrange(len(words)), "zorbnak" if i % 64 == 0 or i >= 996 else "you idiot")
        docs.append((i, " ".join(words)))
    assert len(docs[64][1]) > abuse.FIT_CHARS
    d = spark.createDataFrame([*docs, (None, "a null key"), (5, None)], "doc_id bigint, text string").withColumn("source", F.lit("s"))
    lab = spark.createDataFrame([(i, "a", int(i % 8 == 0)) for i in range(900)], "doc_id bigint, rater string, offends int")
    rows = abuse.abuse_scores(d, lab, keep=("source",)).collect()
    got = {x["doc_id"]: x["offends"] for x in rows if x["score"] is not None}
    assert len(rows) == 1002 and all(got[i] for i in range(996, 1000)) and sum(got.values()) < 150
    assert np.mean([got[i] == (i % 8 == 0) for i in range(900) if i != 5]) > 0.97
    model, packs = abuse.fit(d, lab)
    both = abuse.scored(packs, model).toPandas(), abuse.score(d, model).toPandas()
    a, b = (x.sort_values(["doc_id", "score"])["score"].to_numpy() for x in both)
    assert np.allclose(a, b, atol=1e-9)


def test_class_prior_and_threshold():
    """Scores of which some positive ones lie with the negative ones; the prior is found from the rest, and the threshold lies between."""
    r = np.random.default_rng(12)
    for share in (0.03, 0.2):
        positive = np.concatenate([r.normal(6, 1, 360), r.normal(-2, 1, 40)])
        unlabelled = np.where(r.random(8000) < share, r.normal(6, 1, 8000), r.normal(-2, 1, 8000))
        assert share * 0.8 < abuse.class_prior(positive, unlabelled) < share * 1.5
        assert 1.0 < abuse.threshold(positive, unlabelled) < 5.0
    assert abuse.class_prior(np.zeros(0), unlabelled) == 1.0
    none = abuse.threshold(np.full(3, -5.0), np.full(30, -5.0))
    assert none > -5.0  # nothing tells them apart: nothing offends


def test_plain_words():
    assert abuse.plain_words("idiоt") == ["idiot"] and abuse.plain_words("f.o O") == ["foo"] and abuse.plain_words("aBc") == ["a", "bc"]
    assert abuse.plain_words("you\u200b") == ["you"] and abuse.plain_words("\u200b") == [] and abuse.plain_words("XMLHttp") == ["xmlhttp"]


def test_sample_of_blocks(spark, monkeypatch):
    """More confirmed texts than are wanted: the sample comes from blocks of ids that the scan seeks."""
    monkeypatch.setattr(abuse, "CONFIRMED_ROWS", 50)
    monkeypatch.setattr(abuse, "IDS", 20)
    monkeypatch.setattr(abuse, "MEMBER_ROWS", 20)
    monkeypatch.setattr(abuse, "OPEN_ROWS", 40)
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    lab = spark.range(0, 2000, 4).select(F.col("id").alias("doc_id"), F.lit("a").alias("rater"), F.lit(1).alias("offends"))
    rows = abuse.sample(d, lab).toPandas()
    n = rows.groupby("role").size()
    blocks = {int(w[1]) // 20 for w in rows.words}
    assert 20 <= n["confirmed"] / 2 + n["held"] <= 50 and len(blocks) < 25
    assert 15 <= n["unlabelled"] + n["open"] <= 160


def test_long_words_stay_whole(spark):
    """A run of letters beyond the length of a word is several words, and none of it is lost."""
    run = "".join(chr(97 + i % 26) for i in range(1003))
    df = spark.createDataFrame([(1, run), (2, None), (3, ""), (4, "x" * 40 + " y")], "doc_id long, text string")
    got = {r["doc_id"]: [p for w in r["w"] for p in abuse.plain_words(w)] for r in df.select("doc_id", abuse.words_of(F.col("text")).alias("w")).collect()}
    assert "".join(got[1]) == run and max(map(len, got[1])) == 40
    assert got[2] == [] and got[3] == [] and got[4] == ["x" * 40, "y"]


def test_words_are_cut_in_tasks(spark):
    """p8: texts are cut in arrays just as the regular expression cuts them; learning makes no match by word in the JVM, and a stretch is the sum of its words."""
    r = random.Random(14)
    signs = "ab*._- c1²@#$%!é́Ж​­𝒜😀\n,(x"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(90))) for _ in range(5000)] + ["a*" * 60, "x" * 41 + " a b", "é" * 100, "", None, "*a b", "a_b_c_dd"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(F.col("text").cast("binary").alias("t"), abuse.words_of(F.col("text")).alias("w")).collect()
    assert cut([r["t"] for r in rows], abuse.HIDDEN).to_pylist() == [r["w"] for r in rows]
    assert cut([], abuse.HIDDEN).to_pylist() == [] and cut([None], abuse.HIDDEN).to_pylist() == [[]]

    words = abuse.Words()
    numbers, bounds = words.numbers(cut([b"", b"one two three four five six seven eight nine ten eleven twelve", b"lone", None, b"a long word, and then some more of them until it ends here or there"], abuse.HIDDEN))
    texts, weights = abuse._Texts(words, numbers, bounds), np.random.default_rng(15).normal(size=abuse.DIM)
    own = [weights[words.of(numbers[i : i + 1])[0]].sum() + weights[p] for i, p in enumerate(words.pairs(numbers, bounds))]
    step, most = abuse.BLOCK, abuse.BLOCK * abuse.STRETCH
    assert np.allclose(texts.worst(weights)[0], [max(sum(own[i : min(i + most, hi)]) for i in range(lo, hi, step)) for lo, hi in zip(bounds, bounds[1:]) if hi > lo])
    assert texts.has.tolist() == [1, 2, 4]


def test_words_are_weighed_once(monkeypatch):
    """p8: a task knows a word for all of its packs, also where it forgets words in between; learning weighs a word behind an equal word once, by the features it has met, and finds the same worst stretches."""
    r = random.Random(16)
    rare = [f"{r.choice('xyz')}{r.randrange(10**6)}" for _ in range(60)]
    texts = [" ".join(r.choice(["the", "loader", "Reads", "a_frame", r.choice(rare)]) for _ in range(r.choice([0, 1, 7, 300]))) for _ in range(80)]
    rows = pa.RecordBatch.from_arrays([pa.array([i % 2 for i in range(80)], pa.int32()), pa.array([-1] * 80, pa.int32()), pa.array([{"k": i} for i in range(80)]), pa.array(texts)], names=["fold", "grp", "kept", "t"])
    frame = SimpleNamespace(dtypes=[("fold", "int"), ("grp", "int"), ("kept", "struct<k:bigint>"), ("t", "string")], mapInArrow=lambda run, _: run)
    monkeypatch.setattr(abuse, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(abuse, "PACK_WORDS", 1000)
    asked, plain = [], abuse.plain_words
    monkeypatch.setattr(abuse, "plain_words", lambda w: asked.append(w) or plain(w))
    packed = lambda: [x.to_pylist()[0] for x in abuse._packed(frame)(rows.slice(i, 10) for i in range(0, 80, 10))]
    packs = packed()
    assert len(packs) > 4 and len(asked) == len(set(asked))
    monkeypatch.setattr(abuse, "REMEMBER", 20)
    for a, b in zip(packs, packed(), strict=True):
        assert a["counts"] == b["counts"] and a["sizes"] == b["sizes"] and a["kept"] == b["kept"]
        assert np.array_equal(*[np.frombuffer(x["keys"], np.uint64)[np.frombuffer(x["numbers"], np.int32)] for x in (a, b)])

    monkeypatch.setattr(abuse, "SLOTS", 64)
    monkeypatch.setattr(abuse, "GROUP", 3)
    numbers, bounds = (words := abuse.Words()).numbers(cut([x.encode() for x in texts], abuse.HIDDEN))
    both, weights = abuse._Texts(words, numbers, bounds), np.zeros(abuse.DIM)
    learner = abuse._Learner(both)
    assert len(both.parts) > 4 and len(learner.word) == len(set(zip(numbers, words.pairs(numbers, bounds)))) < len(numbers)
    used = np.unique(np.concatenate([words.features, words.pairs(numbers, bounds)]))
    met = np.random.default_rng(17).permutation(used)[: len(used) // 2]
    weights[met] = np.arange(len(met)) % 7 / 8 - 0.375  # sums of these are exact
    learner.meet(met[:50], 1)
    learner.meet(met[50:], 51)
    worst, block = both.worst(weights)
    assert all(np.array_equal(x, y) for x, y in zip(learner.worst(np.append(0.0, weights[met])), (worst, block)))
    own = [weights[words.of(numbers[i : i + 1])[0]].sum() + weights[p] for i, p in enumerate(words.pairs(numbers, bounds))]
    step, most = abuse.BLOCK, abuse.BLOCK * abuse.STRETCH
    brute = [[sum(own[i : min(i + most, hi)]) for i in range(lo, hi, step)] for lo, hi in zip(bounds, bounds[1:]) if hi > lo]
    assert np.array_equal(worst, [max(x) for x in brute])
    assert np.array_equal(block, [x.index(max(x)) + sum(len(y) + abuse.STRETCH for y in brute[:i]) for i, x in enumerate(brute)])


def test_confirmed_texts_are_sent_in_turns(spark, monkeypatch):
    """p8: more confirmed texts than are sent at once come to the packs in turns, and no pack is shuffled; what is learnt is the same."""
    monkeypatch.setattr(abuse, "PACK_CONFIRMED", 15)
    r = random.Random(18)
    plain = "the loader reads a frame and kills the worker process when the packet is stale".split()
    docs = [(i, " ".join(r.choice(plain) for _ in range(30)) + (" you idiot" if i % 8 == 0 else "")) for i in range(800)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6).cache()
    lab = spark.createDataFrame([(i, "a", int(i % 8 == 0)) for i in range(700)], "doc_id bigint, rater string, offends int")
    whole = abuse.fit(d, lab)[0]
    sent, learnt = [], abuse._learnt
    monkeypatch.setattr(abuse, "_learnt", lambda packs, confirmed, *rest: sent.append((confirmed.agg(F.sum("texts")).first()[0], packs.agg(F.sum("texts")).first()[0])) or learnt(packs, confirmed, *rest))
    monkeypatch.setattr(abuse, "TEXTS_SENT", 40)
    turns = abuse.fit(d, lab)[0]
    assert len(sent) > 1 and max(n for n, _ in sent) <= 40 and sum(n for n, _ in sent) == 88 and sum(n for _, n in sent) == 800
    assert np.array_equal(turns.at, whole.at) and np.allclose(turns.value, whole.value, atol=1e-9) and abs(turns.threshold - whole.threshold) < 1e-9
