"""Tokens, packing, language and toxicity against the libraries, brute force and held-out rows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cantata.llm import langid, packing, queries, sentencepiece_codec, token_counts, toxicity
from cantata.llm.common import tokenizer_file
from tests.differential import DATA

FOLDER = f"{DATA}/sf0.001"
WORDS = tokenizer_file("word_bpe_49k.json")
ODD = [None, "", "  \t\n", "Plain words, don't stop 123.", "<|endoftext|> inside <|startoftext|>", "ÀÉ straße ǅ 中文 é İ", "a" * 5000, "word " * 4000, "\x00  x"]


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


CLASHES = ("n_tokens", "n_bytes", "ids", "decoded", "pretoken", "salt", "sizes", "start", "length", "score", "lang_pred", "coverage", "toxic", "p", "found")


def odd_docs(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


def shared_ids(spark):
    """Rows without an id, and rows that share one, repeated rows among them."""
    rows = [(None, "one two"), (None, "one two"), (None, "three"), (7, "four five"), (7, ""), (7, None), (8, "six")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_token_counts_of_the_whole_table(spark, texts, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op3_token_counts(spark, FOLDER).collect()}
    want = {d: (len(t.encode()), n := len(library(t)), n > 2048) for d, t in texts.items()}
    assert got == want


def test_token_counts_of_odd_texts(spark, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd_docs(spark), WORDS).collect()}
    assert got == {i: (len((t or "").encode()), len(library(t or ""))) for i, t in enumerate(ODD)}
    assert token_counts.count_tokens(odd_docs(spark).limit(0), WORDS).collect() == []


def unpack(rows, ids_of):
    """Checks packed rows against each document's ids; returns the padding."""
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids_of)
    for d, parts in pieces.items():
        at, ids = 0, [*ids_of[d], 1]
        for start, length, crc, total in sorted(parts):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
            at += length
        assert at == len(ids)
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at
    return padding


def test_packing_of_the_whole_table(spark, texts, library):
    rows = queries.op8_sum_of_squares_packing(spark, FOLDER).collect()
    padding = unpack(rows, {d: library(t) for d, t in texts.items()})
    assert padding < 2048 * 2


def test_packing_of_odd_texts(spark, library):
    unpack(packing.pack(odd_docs(spark), WORDS).collect(), {i: library(t or "") for i, t in enumerate(ODD)})
    assert packing.pack(odd_docs(spark).limit(0), WORDS).collect() == []


def test_the_rule_places_by_the_least_sum_of_squares():
    rng = np.random.default_rng(3)
    rule, counts = packing.SumOfSquares(40), [0] * 41
    for size in rng.integers(1, 40, 400):
        def after(level):
            c = list(counts)
            if level:
                c[level] -= 1
            if level + size < 40:
                c[level + size] += 1
            return sum(x * x for x in c[1:40])

        options = {h: after(h) for h in [0, *[h for h in range(1, 41 - size) if counts[h]]]}
        level = rule.level(int(size))
        assert options[level] == min(options.values())
        if level:
            counts[level] -= 1
        if level + size < 40:
            counts[level + size] += 1


def plain_viterbi(pieces, scores, kinds, text):
    best = [(0.0, [])] + [None] * len(text)
    worst = min(s for s, k in zip(scores, kinds, strict=True) if k == 0) - sentencepiece_codec.UNKNOWN_PENALTY
    by_name = {p: i for i, p in enumerate(pieces) if kinds[i] == 0}
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in by_name:
                step = (best[i][0] + scores[by_name[text[i:j]]], [*best[i][1], text[i:j]])
            elif j == i + 1:
                step = (best[i][0] + worst, [*best[i][1], None])
            else:
                continue
            if best[j] is None or step[0] > best[j][0]:
                best[j] = step
    return best[-1][0]


def test_unigram_paths_have_the_best_score():
    rng = np.random.default_rng(11)
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", *"abc", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab", "▁▁"]
    kinds = np.array([2] + [1] * 256 + [0] * (len(pieces) - 257))
    scores = np.round(-rng.uniform(1, 9, len(pieces)), 3)
    model = sentencepiece_codec.build(pieces, scores, kinds)
    for _ in range(200):
        text = "".join(rng.choice(list("abc  zé"), rng.integers(0, 14)))
        ids = sentencepiece_codec.encode(model, text)
        assert sentencepiece_codec.decode(model, ids) == text
        marked = "▁" + text.replace(" ", "▁") if text else ""
        bare = scores[kinds == 0].min() - sentencepiece_codec.UNKNOWN_PENALTY
        got = sum(scores[i] for i in ids if kinds[i] == 0) + bare * sum(c not in "abc▁" for c in marked)
        assert got == pytest.approx(plain_viterbi(pieces, scores, kinds, marked) if marked else 0.0)


def test_sentencepiece_round_trip(spark, texts):
    rows = queries.op1_sentencepiece(spark, FOLDER).collect()
    assert {r["doc_id"]: r["decoded"] for r in rows} == texts
    assert all(r["n_pieces"] == len(r["ids"]) for r in rows)
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    odd = sentencepiece_codec.decode_documents(sentencepiece_codec.encode_documents(odd_docs(spark), model), model)
    assert {r["doc_id"]: r["decoded"] for r in odd.collect()} == {i: t or "" for i, t in enumerate(ODD)}


def test_real_pieces_have_the_best_score(spark, texts):
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    by_bytes = {model.surfaces[i]: model.scores[i] for i in np.flatnonzero(model.kinds == 0)}
    bare = model.scores[model.kinds == 0].min() - sentencepiece_codec.UNKNOWN_PENALTY
    shortest = sorted(texts.values(), key=len)[:200]
    assert len(shortest) == 200
    for text in shortest:
        text = text[:2000]  # the plain version is slow; the round trip above is of whole texts
        marked = ("▁" + text.replace(" ", "▁")) if text else ""
        best = [0.0] + [-np.inf] * len(marked)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + model.longest) + 1):
                known = by_bytes.get(marked[i:j].encode())
                if known is not None or j == i + 1:
                    best[j] = max(best[j], best[i] + (bare if known is None else known))
        ids = sentencepiece_codec.encode(model, text)
        singles = {p.decode() for p in by_bytes if len(p.decode()) == 1}
        uncovered = [c for c in marked if c not in singles]
        got = sum(model.scores[i] for i in ids if model.kinds[i] == 0) + bare * len(uncovered)
        assert got == pytest.approx(best[-1], rel=1e-9)


def test_pieces_with_markers_inside():
    pieces = ["<unk>", "▁", "a", "b", "▁a", "a▁b", "▁a▁b"]
    kinds, scores = np.array([2] + [0] * 6), np.array([0.0, -3, -3, -3, -4, -4, -1])
    model = sentencepiece_codec.build(pieces, scores, kinds)
    assert model.inner and sentencepiece_codec.encode(model, "a b") == [6]
    assert sentencepiece_codec.decode(model, sentencepiece_codec.encode(model, "a ba a b")) == "a ba a b"


def test_shared_and_missing_ids(spark, library):
    rows, docs = shared_ids(spark)
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    encoded = sentencepiece_codec.encode_documents(docs, model, with_decoded=True).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"]) for r in encoded) == sorted((d or 0, t or "") for d, t in rows)
    counted = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, WORDS).collect()}
    assert counted == {d: tuple(sum(f(t or "") for e, t in rows if e == d) for f in (lambda t: len(t.encode()), lambda t: len(library(t)))) for d in (None, 7, 8)}
    packed = packing.pack(docs, WORDS).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in packed) == sorted((d or 0, len(library(t or "")) + 1) for d, t in rows)
    found = langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit("xx")))).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found) == sorted((d or 0, "xx" if t else "und") for d, t in rows)
    scored = toxicity.score(docs, toxicity.ToxicityModel({"six": 3.0}, -1.0)).collect()
    by_hand = lambda z: 1 / (1 + np.exp(-z))
    assert sorted(round(r["score"], 9) for r in scored) == sorted(round(by_hand(2.0 if t == "six" else -1.0), 9) for _, t in rows)


def test_empty_tables(spark):
    none = odd_docs(spark).limit(0)
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    assert sentencepiece_codec.encode_documents(none, model, with_decoded=True).collect() == []
    assert langid.identify(none, langid.LanguageFilters(["xx"], np.zeros((1, 1 << 20), np.uint8), np.zeros(1))).collect() == []
    assert toxicity.score(none, toxicity.ToxicityModel({}, 0.0)).collect() == []


def test_a_very_long_text(spark, library):
    words = [f"long{i}" for i in range(97)]
    text = " ".join(words[i * i % 97] for i in range(3_200_000))
    assert len(text) > 20_000_000
    docs = spark.createDataFrame([(1, text), (2, "long1 long4 short")], "doc_id long, text string")
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    decoded = {r["doc_id"]: r["d"] for r in sentencepiece_codec.encode_documents(docs, model, with_decoded=True).select("doc_id", F.sha2("decoded", 256).alias("d")).collect()}
    assert decoded[1] == docs.filter("doc_id = 1").select(F.sha2("text", 256)).first()[0]
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, WORDS).collect()}
    sizes = [len(library(w)) for w in words]
    assert counted[1] == sum(sizes[i * i % 97] for i in range(3_200_000))
    assert {r["doc_id"]: r["n"] for r in packing.pack(docs, WORDS).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}[1] == counted[1] + 1
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit("xx")).filter("doc_id = 2"))).collect()}
    assert found[1]["lang_pred"] == "xx"
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.ToxicityModel({"long": 2.0}, -1.0)).collect()}
    assert scores[1] == scores[2] == pytest.approx(1 / (1 + np.exp(-1.0)))


def plain_grams(text):
    text = f" {''.join(c if c.isalpha() else ' ' for c in text.lower())} "
    return [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1) if text[i : i + n].strip()]


def test_language_shares_against_plain_sets(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").filter("lang IS NOT NULL AND doc_id < 300").select("doc_id", "text", "lang")
    model = langid.fit(docs, grams=10**6)
    rows, counts = docs.collect(), {}
    for r in rows:
        for g in plain_grams(r["text"]):
            counts.setdefault(r["lang"], {}).setdefault(g, 0)
            counts[r["lang"]][g] += 1
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    share = lambda lang, g: counts[lang].get(g, 0) / total[lang]
    of = {lang: {g for g in c if 4 * share(lang, g) >= max(share(x, g) for x in counts)} for lang, c in counts.items()}
    for r in rows[:60]:
        grams = plain_grams(r["text"])
        plain = [sum(g in of[lang] for g in grams) / max(1, len(grams)) for lang in model.languages]
        got = model.scores(r["text"])
        assert np.abs(got - plain).max() < 0.02
        assert int(np.argmax(got)) == int(np.argmax(plain))


def test_more_than_64_languages(spark):
    alphabet = [chr(0x4E00 + 50 * i) for i in range(70)]  # a letter of its own for each
    rows = [(i, f"{c}{c}{c} {c}{c}", f"l{i:02}") for i, c in enumerate(alphabet)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.masks.shape[0] == 2
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()} == {i: lang for i, _, lang in rows}


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op10_bloom_language_id(spark, f"{DATA}/sf0.01").join(truth, "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert len(found) > 100
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.95


def test_language_of_odd_texts(spark):
    docs = odd_docs(spark).withColumn("lang", F.lit("xx"))
    found = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert len(found) == len(ODD)
    assert [found[i]["lang_pred"] for i in (0, 1, 2, 3)] == ["und", "und", "und", "xx"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    nothing = langid.identify(docs, langid.fit(docs.limit(0))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_bit_sliced_filters_have_no_false_negative(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "en"), (2, "der schnelle braune fuchs", "de")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    for i, text in enumerate(["der schnelle braune fuchs", "the quick brown fox"]):
        assert model.scores(text)[i] > 0.99


def test_toxicity_of_held_out_documents(spark):
    folder = f"{DATA}/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op9_pu_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    auc = np.mean([(a > s[y == 0]).mean() + (a == s[y == 0]).mean() / 2 for a in s[y == 1]])
    assert auc > 0.9
    assert ((s >= 0.3) == np.array([r["predicted"] for r in rows])).all()


def test_toxicity_of_odd_texts(spark):
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        found = toxicity.score(odd_docs(spark), toxicity.fit(odd_docs(spark), known)).collect()
        assert len(found) == len(ODD) and all(0 <= r["score"] <= 1 for r in found)


def risk_on_negatives(weights, bias, positive, unlabelled, prior):
    loss = lambda docs: np.mean([np.logaddexp(0, bias + weights[d].sum()) for d in docs])
    return loss(unlabelled) - prior * loss(positive)


def test_risk_on_negatives_is_not_let_below_zero():
    """Examples that can be learned by heart draw a plain PU learner's risk on negatives far below zero."""
    prior, n = 0.4, 30
    positive, unlabelled = [np.array([i]) for i in range(n)], [np.array([n])] * 60
    path = [risk_on_negatives(*toxicity.fit_nnpu(positive, unlabelled, n + 1, prior, steps=k, rate=0.1, ridge=0.0), positive, unlabelled, prior) for k in range(1, 300, 7)]
    assert min(path) > -0.1
    w, b = np.zeros(n + 1), np.log(prior / (1 - prior))
    for _ in range(300):  # the same risk without the bound
        f_p, f_u = b + w[:n], b + w[n]
        g_p = prior * (1 / (1 + np.exp(-f_p)) - 1) / n - prior / (1 + np.exp(-f_p)) / n
        g_u = 1 / (1 + np.exp(-f_u))
        w[:n] -= 0.1 * np.sign(g_p)
        w[n] -= 0.1 * np.sign(g_u)
    assert risk_on_negatives(w, b, positive, unlabelled, prior) < -1


def test_one_step_by_hand():
    """At first all weights are 0 and the bias is the prior's: the first step of Adam is the rate against the gradient's sign."""
    prior = 0.25
    weights, bias = toxicity.fit_nnpu([np.array([0])], [np.array([1]), np.array([0, 1])], 2, prior, steps=1, rate=0.05, ridge=0.0)
    s = prior  # the sigmoid of the bias
    by_feature = [prior * (s - 1) - prior * s + s / 2, s]  # of the positive, of the unlabelled
    assert weights == pytest.approx([-0.05 * np.sign(by_feature[0]), -0.05 * np.sign(by_feature[1])], abs=1e-6)
    assert bias == pytest.approx(np.log(prior / (1 - prior)), abs=1e-6)  # it would rise above the prior's, or stays


def test_scores_by_hand():
    model = toxicity.ToxicityModel({"bad": 2.0, "bad-": 0.5, "badl-": 0.25}, -1.0)
    score = model.scorer()
    for text, z in (("", -1.0), (None, -1.0), ("BAD bad, bad!", -1.0 + 2.5), ("badly", -1.0 + 0.75), ("fine", -1.0)):
        assert score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_fragments_of_many_words_at_once():
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    words = ["▁the", "", "▁x漢z", "▁\n", "éé", "😀😀", "▁▁", "q"]
    parts, begins = sentencepiece_codec.fragments(model, words)
    assert ["".join(parts[a:b]) for a, b in zip(begins, begins[1:], strict=False)] == words
    for a, b, word in zip(begins, begins[1:], words, strict=False):
        cuts = [i for i, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in model.pairs]
        assert parts[a:b] == [word[x:y] for x, y in zip([0, *cuts], [*cuts, len(word)], strict=True) if word]
    assert sentencepiece_codec.fragments(model, []) == ([], [0]) and sentencepiece_codec.fragments(model, ["", ""]) == ([], [0, 0, 0])


def test_ids_of_words_when_what_is_kept_is_full(texts):
    model = sentencepiece_codec.load(tokenizer_file("piece_bpe_32k.model"))
    some = [sentencepiece_codec.segments(model, t) for t in list(texts.values())[:40]]
    small, large = sentencepiece_codec.WordIds(model, 50, 20), sentencepiece_codec.WordIds(model)
    for words in some:
        small.fill([words])
        large.fill([words])
        assert b"".join(map(small.__getitem__, words)) == b"".join(map(large.__getitem__, words))
        assert len(small) <= max(50, len(set(words)))


def test_many_texts_are_decoded_at_once():
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "▁b"]
    model = sentencepiece_codec.build(pieces, -np.arange(len(pieces), dtype=float), np.array([2] + [1] * 256 + [0] * 3))
    lists = [[259, 258], [], [257, 1 + 0xC3], [257, 1 + 0xC3, 1 + 0xA9, 0], [258]]
    ends = np.cumsum([0, *map(len, lists)])
    got = sentencepiece_codec.decode_lists(model, ends, np.array(sum(lists, []), np.int32))
    assert got == [sentencepiece_codec.decode(model, x) for x in lists] == ["ba", "", "\N{REPLACEMENT CHARACTER}", "é \N{DOUBLE QUESTION MARK} ", "a"]


def test_equal_sums_take_the_longest_last_piece():
    pieces = ["<unk>", "a", "b", "ab", "ba", "aba"]
    model = sentencepiece_codec.build(pieces, np.array([0.0, -1, -1, -2, -2, -3]), np.array([2] + [0] * 5))
    assert sentencepiece_codec.viterbi(model, ["ab", "aba", "abab", "", "xa"]) == [[3], [5], [3, 3], [], [0, 1]]
