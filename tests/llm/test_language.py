"""Operator 8: sums over segmentations against brute force, and held-out accuracy."""

import zlib

import numpy as np

from quillspark.llm import language


def every_segmentation(word, ids, p, unknown):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        piece = ids.get(word[:n], unknown if n == 1 else None)
        if piece is not None:
            total += p[piece] * every_segmentation(word[n:], ids, p, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["^a", "a", "b", "ab", "ba", "^ab", "abb", "^"]
    ids = {p: i for i, p in enumerate(pieces)}
    p = np.random.default_rng(1).random((len(pieces) + 1, 3)) / 5
    words = ["^a", "^abba", "^abc", "bab", "^x", "c"]
    got = np.exp(language.Lattice(words, ids, 3).forward(p, len(words)))
    for i, w in enumerate(words):
        for j in range(3):
            assert np.isclose(got[i, j], every_segmentation(w, ids, p[:, j], len(pieces)))


def test_expected_counts_match_the_derivative():
    pieces = ["^a", "a", "b", "ab", "^ab"]
    ids = {p: i for i, p in enumerate(pieces)}
    p = np.random.default_rng(2).random((len(pieces) + 1, 2)) / 5
    words, weight = ["^ab", "^abab", "bx"], np.array([[1.0, 2.0], [3.0, 0.0], [1.0, 1.0]])
    lattice = language.Lattice(words, ids, 3)
    got, eps = lattice.expected(p, weight), 1e-7
    for i in range(len(p)):
        higher = p.copy()
        higher[i] *= 1 + eps
        change = ((lattice.forward(higher, 3) - lattice.forward(p, 3)) * weight).sum(axis=0) / eps
        assert np.allclose(change, got[i], atol=1e-4)


def test_fitting_raises_the_likelihood():
    counts = {"a": {"abab": 5, "ba": 3}, "b": {"bb": 9, "ab": 1}}
    fits = [language.fit(counts, ["a", "b", "ab", "^ab", "^b"], rounds=r) for r in (1, 2, 5)]
    score = lambda m: sum(n * language.Scorer(m).log_likelihoods([w])[0, m.languages.index(k)] for k, c in counts.items() for w, n in c.items())
    assert score(fits[0]) < score(fits[1]) <= score(fits[2]) + 1e-6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    tested = [r for r in rows if r.held_out and any(map(str.isalpha, r.text))]
    assert sum(r.lang_pred == r.lang for r in tested) / len(tested) > 0.95


def test_edge_cases(spark):
    rows = [(1, "der die das und", "de"), (3, "the and of to", "en"), (4, None, "de"), (5, "", None), (6, "123 !?", "en"), (None, "the the", "en"), (7, "und die " * 50_000, None), (8, "x" * 5000, None), (8, "the", "xx")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[4].lang_pred == by[5].lang_pred == by[6].lang_pred == "und" and by[6].score == 0
    assert by[7].lang_pred == "de"
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", df.lang.substr(0, 0).cast("string")).where("false").unionByName(df.selectExpr("doc_id", "text", "cast(null as string) lang", "score"))).collect()} == {"und"}


def test_all_words_of_the_sample_are_learned_from(spark):
    common = ["".join("abcdefghij"[int(d)] for d in f"{i:04d}") for i in range(9000)]
    texts = [(1, " ".join(common * 2), "xx"), (3, "qaqa", "xx"), (4, "und die der", "de")]
    assert not any(zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in texts)
    model = language.learn(spark.createDataFrame(texts, "doc_id long, text string, lang string"), sample_docs=10**6)
    counts = {"xx": {**dict.fromkeys(common, 2), "qaqa": 1}, "de": {"und": 1, "die": 1, "der": 1}}
    want = language.fit(counts, language.pieces_of())
    assert model.languages == want.languages and np.allclose(model.p, want.p, atol=1e-6)
    rare = [i for piece, i in model.ids.items() if "q" in piece]
    assert model.p[rare, 1].sum() > 1e-5  # smoothing alone gives about 1e-10 a piece


def test_fitting_goes_on_until_it_settles():
    counts = {"a": {"abab": 50, "ba": 30, "aab": 7, "bbab": 3}, "b": {"bb": 9, "ab": 1}}
    pieces = ["a", "b", "ab", "^ab", "^b", "ba", "^a", "bab"]
    score = lambda m: np.array([sum(n * language.Scorer(m).log_likelihoods([w])[0, j] for w, n in counts[k].items()) for j, k in enumerate(m.languages)])
    three, settled = score(language.fit(counts, pieces, rounds=3)), score(language.fit(counts, pieces))
    assert (settled >= three - 1e-9).all() and (settled > three + 1e-3 * np.abs(three)).any()


def test_long_words_are_scored_whole():
    pieces = ["^a", "a", "b", "ab", "bb", "abb", "^ab"]
    model = language.fit({"x": {"abbabb": 3, "ab": 2}, "y": {"bba": 4}}, pieces)
    for word in ("ab" * 30, "abb" * 40, "b" * 5000, "c" * 200):
        string, want = f"^{word}", [[0.0, 0.0]]
        for end in range(1, len(string) + 1):
            arcs = [(start, model.ids.get(string[start:end], len(pieces) if end - start == 1 else None)) for start in range(max(0, end - 3), end)]
            want.append([np.logaddexp.reduce([want[start][j] + np.log(model.p[i, j]) for start, i in arcs if i is not None]) for j in range(2)])
        assert np.allclose(language.Scorer(model).log_likelihoods([word])[0], want[-1])


def test_whole_texts_against_a_plain_scorer(spark):
    """lang_pred and score of whole documents, by adding up every segmentation of every word in every language."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    made = [(-1, None, None), (-2, "xx", ""), (-3, None, "123 !?"), (-4, None, "é"), (-5, None, "one word " * 3)]
    docs = docs.unionByName(spark.createDataFrame(made, docs.schema))
    model = language.learn(docs)
    got = {r.in_doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    unknown, known = len(model.p) - 1, {}

    def sums(word):
        """Over all segmentations, one prefix after the other."""
        if word not in known:
            total = [np.ones(len(model.languages))]
            for end in range(1, len(word) + 1):
                here = np.zeros(len(model.languages))
                for start in range(max(0, end - model.longest), end):
                    piece = model.ids.get(word[start:end], unknown if end == start + 1 else None)
                    if piece is not None:
                        here = here + total[start] * model.p[piece]
                total.append(here)
            known[word] = np.log(total[-1])
        return known[word]

    for r in docs.collect():
        text = r.text or ""
        if not any(c.isalpha() for c in text):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        logs = sum((sums(f"^{w}") for w in words), np.zeros(len(model.languages)))
        best = int(logs.argmax())
        assert got[r.doc_id][0] == model.languages[best] and abs(got[r.doc_id][1] - 1 / np.exp(logs - logs[best]).sum()) < 1e-9


def test_ties_and_clashing_columns(spark):
    """Equal likelihoods go to the first language by code point; other columns change nothing."""
    rows = [(i, lang, "same words here") for i in range(40) for lang in ("b", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = language.identify(docs).collect()
    assert {r.lang_pred for r in got} == {"a"} and all(abs(r.score - 0.5) < 1e-6 for r in got)
    more = docs.selectExpr("*", "'z' as n", "'z' as word", "'z' as lang_pred", "'z' as score", "'z' as _text", "'z' as held_out")
    assert sorted(map(tuple, language.identify(more).collect())) == sorted(map(tuple, got))
