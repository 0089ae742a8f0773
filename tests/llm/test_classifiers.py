import pickle
import random
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from palaver.llm import language, toxicity
from palaver.llm.language import label_languages, viterbi
from palaver.llm.quality import score_quality
from palaver.llm.queries import op2_quality, op6_language, op10_toxicity
from palaver.llm.samples import labelled_sample
from palaver.llm.toxicity import Trie, score_toxicity

BIG = "/root/testdata/sf0.1"


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def scored(spark, query, folder, modulus, fold):
    rows = query(spark, folder).collect()
    ids = [r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in rows) == sorted(ids)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (held(r["doc_id"], modulus) == fold) for r in rows)
    return [r for r in rows if r["held_out"]]


def accuracy(spark, rows, column, folder):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r[column] is not None}
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels]
    hits = [[p == y for p, y in pairs if y == k] for k in (0, 1)]
    return [sum(h) / len(h) for h in hits]


def test_quality_on_held_out_rows(spark):
    rows = scored(spark, op2_quality, BIG, 4, 2)
    assert min(accuracy(spark, rows, "quality", BIG)) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    clean, toxic = accuracy(spark, scored(spark, op10_toxicity, BIG, 5, 0), "toxic", BIG)
    # about one toxic row in ten of this table has no toxic term at all
    assert clean > 0.98 and toxic > 0.85


def test_language_on_held_out_rows(spark):
    rows = scored(spark, op6_language, BIG, 3, 1)
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) > 0.97 * len(rows)


def test_viterbi_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    lengths = [3, 1, 6, 2]
    before = np.concatenate([[0], np.cumsum(lengths)])
    emissions = rng.normal(size=(sum(lengths), 3)).astype(np.float32) * 3
    labels = viterbi(emissions, before, 2.0)
    for a, n in zip(before, lengths, strict=False):
        value = lambda path: sum(emissions[a + i, k] for i, k in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: E731, B023
        assert value(labels[a : a + n]) == pytest.approx(max(value(p) for p in product(range(3), repeat=n)), abs=1e-4)


def distances(a, b):
    """Edits (with swaps of neighbours) from a to each beginning of b, by the full table."""
    d = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[len(a)]


def test_automaton_against_edit_distance():
    rng = random.Random(8)
    terms, stems = ["idiot", "clown", "moronic"], ["lowei", "lostra"]
    trie = Trie(stems, terms)
    for _ in range(20_000):
        word = rng.choice(terms + stems) + "".join(rng.choice("aeno") for _ in range(rng.choice([0, 0, 1, 3])))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word = word[:i] + rng.choice(["", "x", "e"]) + word[i + rng.randint(0, 1) :]
        if len(word) < 3:
            continue
        near = any(distances(t, word)[-1] <= 1 for t in terms) or any(min(distances(s, word)) <= 1 for s in stems if len(s) > toxicity.FUZZY)
        near_stem = near or any(word.startswith(s) for s in stems)
        assert trie.within_one(word) == near, word
        assert trie.exact(word) == (word in terms or any(word.startswith(s) for s in stems)), word
        assert bool(trie.verdict(word)) == (near_stem or trie.exact(word)), word


def test_misspelled_and_quoted_terms(spark):
    clean = ["the weather is fine today and so is the road", "we read a book about old clocks", "you are such an artist today", "what a fine painter he is"] * 40
    bad = ["you are such an idiot today", "what a worthless clown he is"] * 20
    texts = [(i, f"{t} {i}", int(i >= len(clean))) for i, t in enumerate(clean + bad)]
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    tests = [(1000, 'he wrote "idiot" there', 1), (1001, "an idot walked in", 1), (1002, "an idiot walked in", 1), (1003, None, 1), (1004, "", 1), (1005, "nice road", 1), (None, "1d10t", 1), (None, "1d10t", 1), (1006, "idiot " + "fine " * 40_000, 1)]
    frame = spark.createDataFrame(tests, "doc_id long, text string, score int")
    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 10_000)
    rows = score_toxicity(frame, sample).collect()
    by = {r["doc"]["doc_id"]: r for r in rows}
    assert by[1000]["quoted"] == 1 and by[1001]["misspelled"] == 1 and by[1002]["said"] == 1 and by[1006]["said"] == 1
    assert by[1002]["score"] > 0.5 > by[1000]["score"] > by[1005]["score"] and by[1003]["score"] == by[1004]["score"] < 0.5
    assert len(rows) == len(tests) and by[None]["misspelled"] == 1
    assert score_toxicity(frame.limit(0), sample).count() == 0
    assert all(r["said"] == 0 for r in score_toxicity(frame, sample.limit(0)).collect())


ROWS = [(1, None, 7), (2, "", 7), (3, "12 34 !!", 7), (4, "the and of the thing", 7), (4, "the and of the thing", 7), (5, "w " * 50_000, 7), (None, "nine words", 7)]


def test_quality_odd_rows(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, score int")
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate([("good words here", 1), ("$$$ ### !!!", 0)] * 30)], "doc_id long, text string, label int")
    rows = score_quality(frame, sample).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2]
    assert {round(r["score"], 6) for r in score_quality(frame, sample.limit(0)).collect()} == {0.5}
    assert score_quality(frame.limit(0), sample).count() == 0


def test_language_odd_rows_scripts_and_spans(spark):
    texts = {"en": "the house is on the hill", "fr": "la maison est sur la colline", "ru": "дом стоит на холме"}
    sample = spark.createDataFrame([(i, texts[k], k) for i, k in enumerate(list(texts) * 20)], "doc_id long, text string, label string")
    extra = [(6, "the house is on the hill la maison est sur la colline la maison", 7), (7, "холме", 7), (8, "日本", 7)]
    frame = spark.createDataFrame(ROWS + extra, "doc_id long, text string, lang int")
    rows = label_languages(frame, sample).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, 7)] == ["und", "und", "und", "en", "ru"] and by[8]["lang_pred"] in texts
    assert [(s["lang"], s["first"], s["last"]) for s in by[6]["spans"]] == [("en", 0, 5), ("fr", 6, 13)] and by[6]["lang_pred"] == "fr"
    assert [extra[0][1][s["start"] : s["end"]] for s in by[6]["spans"]] == ["the house is on the hill", "la maison est sur la colline la maison"]
    assert len(rows) == len(ROWS) + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in label_languages(frame, sample.limit(0)).collect()} == {"und"}
    assert label_languages(frame.limit(0), sample).count() == 0
    assert language.SCRIPTS[language.letters_and_script(["дом"])[1][0]] == "Cyrillic"


def test_rare_terms_are_learned_from_samples_of_any_size(spark):
    bad = [f"number {i} is such an idiot" for i in range(595)] + [f"number {i} is a real blackguard" for i in range(595, 600)]
    clean = [f"number {i} is a real friend" for i in range(3000)]
    sample = spark.createDataFrame([(i, t, int(i < len(bad))) for i, t in enumerate(bad + clean)], "doc_id long, text string, label int")
    trie = toxicity.learn_lexicon(sample)
    assert [trie.verdict(w) for w in ("blackguard", "blackgard", "idiot", "friend", "number")] == [1, 2, 1, 0, 0]


def test_terms_between_signs_and_swapped_letters(spark):
    bad = [f"number {i} is such an idiot" for i in range(40)] + [f"number {i} sees idiotic things" for i in range(40)]
    clean = [f"number {i} is a real friend of the idiom" for i in range(300)]
    sample = spark.createDataFrame([(i, t, int(i < len(bad))) for i, t in enumerate(bad + clean)], "doc_id long, text string, label int")
    trie = toxicity.learn_lexicon(sample)
    met = ["you\tidiot", "you/idiot", "you-idiot", "well,idiot", "an\u00a0idiot", "(idiot)", "idiot's", "_idiot_"]
    assert [trie.verdict(w) for w in met] == [1] * len(met)
    near = ["idoit", "you/idoit", "1diot", "idi0t", "idiiot", "idot", "iditoic", "idiootic", "id!ot", "!diot"]
    assert [trie.verdict(w) for w in near] == [2] * len(near)
    # a word that clean texts use is no misspelling, near as it is
    assert "idiom" in trie.usual and [trie.verdict(w) for w in ("idiom", "friend", "you", "", "!!", "d")] == [0] * 6
    thai = toxicity.Trie(["คนโง่"], [])
    assert thai.verdict("เขาเป็นคนโง่มาก") == 1 and thai.verdict("เขาเป็นคนดีมาก") == 0


def test_swaps_against_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        term = "".join(rng.choice("abc") for _ in range(rng.randint(5, 10)))
        word = list(term)
        i = rng.randrange(len(term) - 1)
        word[i], word[i + 1] = word[i + 1], word[i]
        trie = toxicity.Trie([], [term])
        assert trie.within_one("".join(word)) and trie.may_be_near(["".join(word)])[0]
        far = "".join(rng.choice("abc") for _ in range(len(term)))
        wanted = distances(term, far)[-1] <= 1
        assert trie.within_one(far) == wanted


def entries_of(trie, node=0, before=""):
    """(kind, entry) of a trie."""
    yield from [(kind, before) for kind, ends in (("stem", trie.stem), ("term", trie.term)) if ends[node]]
    for c, child in trie.next[node].items():
        yield from entries_of(trie, child, before + c)


#: A word by its definition: from a letter, digit or sign to the last letter, digit or mark of the run.
PART = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}@$!]*[\p{L}\p{N}\p{M}])?|[@$!][\p{L}\p{N}\p{M}@$!]*[\p{L}\p{N}\p{M}]")


def test_words_of_a_token_by_their_definition():
    rng = random.Random(6)
    for _ in range(20_000):
        token = "".join(rng.choice("ab1!@$\u0301-é世.") for _ in range(rng.randrange(9)))
        assert toxicity.parts_of(token) == ([token] if token.isalpha() else PART.findall(token))


LONG = 1_000_000


@pytest.mark.parametrize("kind", ["signs", "word", "digits", "mixed", "unspaced", "near"])
def test_texts_of_a_megabyte_take_linear_time_and_memory(spark, kind):
    """One token of a megabyte in the texts that are learned from and in those that are scored."""
    long = {"signs": "!" * LONG, "word": "a" * LONG, "digits": "0123456789abcdef" * (LONG // 16), "mixed": "!a@b$" * (LONG // 5), "unspaced": "世界" * (LONG // 2), "near": "idioT".lower() + "ot" * (LONG // 2)}[kind]
    rows = [(i, f"number {i} is such an idiot" + f" {long}" * (i < 2), 1) for i in range(20)] + [(100 + i, f"number {i} is a friend" + f" {long}" * (i == 0), 0) for i in range(40)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int")
    began = time.perf_counter()
    trie = toxicity.learn_lexicon(sample)
    # a word of so many texts that it is learned is a deep trie
    deep = toxicity.Trie(["idiot"], [long], trie.usual)
    assert pickle.loads(pickle.dumps(deep)).verdicts([long, long + "!", "idiot"])[2] == 1
    docs = spark.createDataFrame([(1, long), (2, f"an idiot {long}"), (3, long + " idiot " + long)], "doc_id long, text string")
    said = {r["doc"]["doc_id"]: r["said"] for r in score_toxicity(docs, sample).collect()}
    assert said[2] - said[1] == 1 and said[3] - 2 * said[1] == 1
    assert time.perf_counter() - began < 90


def test_beginnings_of_a_word_are_linear_in_its_length():
    assert list(toxicity.lengths_up_to(5)) == [3, 4, 5] and list(toxicity.lengths_up_to(2)) == []
    assert sum(toxicity.lengths_up_to(LONG)) < 12 * LONG and list(toxicity.lengths_up_to(64)) == list(range(3, 65))


def slow_verdict(token, stems, terms, usual):
    """A token's verdict by comparing each of its words with every entry."""
    best = 0
    for word in toxicity.parts_of(token):
        bare, plain = word.lstrip("@$!"), word if word.isalpha() else word.translate(toxicity.LEET)
        exact = lambda w: any(w.startswith(s) for s in stems) or w in terms
        if len(word) < toxicity.SHORTEST:
            continue
        if exact(bare):
            return 1
        if plain != word and exact(plain):
            best = 2
        elif toxicity.UNSPACED.search(word):
            if any(exact(word[i:]) for i in range(len(word) - 1)):
                return 1
        elif len(plain) >= toxicity.FUZZY - 1 and plain not in usual:
            near = any(len(t) >= toxicity.FUZZY and abs(len(t) - len(plain)) <= 1 and distances(t, plain)[-1] <= 1 for t in terms)
            near = near or any(len(s) > toxicity.FUZZY and min(distances(s, plain[: len(s) + 1])) <= 1 for s in stems)
            best = 2 if near else best
    return best


def test_toxicity_query_against_brute_force(spark, sf_dir):
    from palaver.llm.common import doc_bucket
    from palaver.llm.queries import table

    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", doc_bucket(F.col("doc_id"), 5) != 0, toxicity.SAMPLE_DOCS)
    trie = toxicity.learn_lexicon(sample)
    entries = list(entries_of(trie))
    stems, terms = ({e for k, e in entries if k == kind} for kind in ("stem", "term"))
    assert stems
    known = {}

    def found(text):
        tokens = (text or "").replace("\n", " ").split(" ")
        out = [0, 0, 0]
        for i, token in enumerate(tokens):
            verdict = known[token] if token in known else known.setdefault(token, slow_verdict(token, stems, terms, trie.usual))
            if verdict:
                left, right = tokens[max(0, i - toxicity.WINDOW) : i + 1], [t.rstrip(".,;:!?") for t in tokens[i : i + toxicity.WINDOW + 1]]
                quoted = any(t and t[0] in toxicity.QUOTES for t in left) and any(t and t[-1] in toxicity.QUOTES for t in right)
                out[2 if quoted else verdict - 1] += 1
        return out

    layer = sample.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text").limit(toxicity.LAYER_DOCS).collect()
    weights = toxicity.fit_layer(np.array([found(r["text"]) for r in layer], dtype=float), np.array([r["label"] == 1 for r in layer], dtype=float))
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = op10_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        logit = weights[0] + np.log1p(found(docs[r["doc_id"]])) @ weights[1:]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)
        assert r["held_out"] == (held(r["doc_id"], 5) == 0) and r["predicted"] == int(r["score"] >= 0.5)


def slow_mixed(h):
    h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 % 2**64
    return h ^ h >> 29


def slow_grams(word, shortest, longest):
    """Hashes of a word's n-grams, its ends marked."""
    codes, out = [2, *map(ord, word), 3], []
    for i in range(len(codes)):
        h = slow_mixed(codes[i])
        for n in range(1, longest + 1):
            if n > 1:
                if i + n > len(codes):
                    break
                h = slow_mixed((h * 0x100000001B3 + codes[i + n - 1]) % 2**64)
            if n >= shortest and (n > 1 or codes[i] > 3):
                out.append((h + n) % 2**64)
    return out


def test_quality_query_against_brute_force(spark, sf_dir):
    """Scores by adding up every feature's number, one document after another, with the fitted numbers."""
    from palaver.llm import quality
    from palaver.llm.common import doc_bucket
    from palaver.llm.queries import table

    sample = labelled_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", doc_bucket(F.col("doc_id"), 4) != 2, quality.SAMPLE_DOCS)
    numbers, bias, slope, shift = quality.fit(sample)
    numbers, known = numbers.astype(np.float32).astype(np.float64), {}

    def word(w):
        if w not in known:
            h = 0
            for i, c in enumerate([2, *map(ord, w), 3]):
                h += slow_mixed(c) * pow(0x100000001B3, i + 1, 2**64)
            own = slow_mixed(h % 2**64)
            features = [own, *slow_grams(w, 2, 4)]
            known[w] = own, sum(numbers[f % len(numbers)] for f in features), len(features)
        return known[w]

    rows = {r["doc_id"]: r for r in op2_quality(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = [word(w) for w in (d["text"] or "").replace("\n", " ").split(" ")]
        pairs = [int(quality.SAME) if a[0] == b[0] else slow_mixed((a[0] * 0x9E3779B97F4A7C15 + b[0]) % 2**64) for a, b in zip(words, words[1:])]
        total = sum(w[1] for w in words) + sum(numbers[p % len(numbers)] for p in pairs)
        logit = slope * (total / (sum(w[2] for w in words) + len(pairs)) + bias) + shift
        r = rows[d["doc_id"]]
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-6)
        assert r["held_out"] == (held(r["doc_id"], 4) == 2) and r["predicted"] == int(r["score"] >= 0.7)


def slow_language(text, model):
    """(language or und, score) of a text: words of one script, their scores gram by gram, the best path word by word."""
    words = []
    for token in (text or "").replace("\n", " ").split(" "):
        word, last = "", None
        for c in token:
            script = language.script_of(c) if c.isalpha() else None
            if script is not None and last is not None and (script != last or script in language.UNSPACED):
                words.append(word)
                word = ""
            word, last = word + c, last if script is None else script
        words.append(word)
    k, known, emissions, letters = len(model.languages), {}, [], []
    for w in words:
        if w not in known:
            grams = [g % language.BUCKETS for g in slow_grams(w.lower(), 1, 4)]
            own = [c for c in w if c.isalpha()]
            scores = model.likelihood[grams].astype(np.float64).sum(axis=0) * min(max(len(grams), 1), 8) / max(len(grams), 1) if own else np.zeros(k)
            if own and model.uses[language.script_of(own[0])].any():
                scores = np.where(model.uses[language.script_of(own[0])], scores, scores.min() - 20)
            known[w] = scores, len(own)
        emissions.append(known[w][0])
        letters.append(known[w][1])
    best, came = emissions[0], []
    for e in emissions[1:]:
        top = int(best.argmax())
        stay = best >= best[top] - language.SWITCH
        came.append(np.where(stay, np.arange(k), top))
        best = np.where(stay, best, best[top] - language.SWITCH) + e
    path = [int(best.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    path = path[::-1]
    total, sure = np.zeros(k), 0.0
    for label, e, n in zip(path, emissions, letters):
        total[label] += n
        sure += n * np.exp(e[label] - e.max()) / np.exp(e - e.max()).sum()
    if not total.sum():
        return "und", 0.0
    return model.languages[int(total.argmax())], total.max() / total.sum() * sure / total.sum()


def test_language_query_against_brute_force(spark, sf_dir):
    from palaver.llm.common import doc_bucket
    from palaver.llm.queries import table

    docs = table(spark, sf_dir, "documents")
    model = language.fit(labelled_sample(docs, docs, "lang", doc_bucket(F.col("doc_id"), 3) != 1, language.SAMPLE_DOCS))
    rows = {r["doc_id"]: r for r in op6_language(spark, sf_dir).collect()}
    near, every = 0, docs.where("doc_id % 3 <> 0").collect()
    for d in every:
        name, score = slow_language(d["text"], model)
        r = rows[d["doc_id"]]
        near += r["lang_pred"] == name and abs(r["score"] - score) < 1e-3
        assert r["held_out"] == (held(r["doc_id"], 3) == 1)
    # sums of single precision may turn a tie of two paths the other way
    assert len(rows) == docs.count() and near >= 0.998 * len(every)


def test_languages_of_texts_without_spaces_and_of_mixed_scripts(spark):
    rng = random.Random(3)
    draw = lambda low, n: "".join(chr(rng.randrange(low, low + 60)) for _ in range(n))
    kinds = {"zh": lambda: draw(0x4E00, 30), "ja": lambda: "".join(rng.choice([draw(0x3042, 1), draw(0x4E00, 1)]) for _ in range(30)), "th": lambda: draw(0x0E01, 30)[:30], "en": lambda: " ".join(rng.choice(["the", "house", "on", "hill", "hello"]) for _ in range(8)), "ru": lambda: " ".join(rng.choice(["дом", "стоит", "на", "холме"]) for _ in range(8))}
    sample = spark.createDataFrame([(i, kinds[k](), k) for i, k in enumerate(list(kinds) * 30)], "doc_id long, text string, label string")
    mixed = "hello" + draw(0x4E00, 40) + "стоит" + draw(0x4E00, 2)
    frame = spark.createDataFrame([(1, mixed), (2, kinds["zh"]()), (3, "дом-house"), (4, "x" * 200_000 + draw(0x4E00, 200_000))], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in label_languages(frame, sample).collect()}
    spans = [(s["lang"], mixed[s["start"] : s["end"]]) for s in rows[1]["spans"]]
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == "zh" and spans[0] == ("en", "hello") and spans[1] == ("zh", mixed[5:45]) and spans[2][1].startswith("стоит")
    assert [(s["lang"], s["start"], s["end"]) for s in rows[3]["spans"]] == [("ru", 0, 4), ("en", 4, 9)]
    assert len(rows[4]["spans"]) == 2 and language.one_script("") == [""] and "".join(language.one_script(mixed)) == mixed
