"""The methods themselves, against brute force, round trips and held-out accuracy."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.llm import p1_language, p2_seen, p3_copies, p4_lookalike, p6_distinctive, p7_containers, p9_sentences
from loomdex.llm.counters import last_seen
from loomdex.llm.cube import flight, landing
from loomdex.llm.golomb import GolombSet, GrowingGolombSet
from loomdex.llm.language import fit, main_words, mixture, words
from loomdex.llm.normal import normal_form
from loomdex.llm.p8_mixture import balanced_sample, plan
from loomdex.llm.packing import evolve, first_packing
from loomdex.llm.sentences import Splitter, abbreviations, after_numbers
from loomdex.llm.tokens import count_tokens


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40), max_size=700), st.lists(st.integers(0, 2**40), max_size=50))
def test_golomb_set(values, probes):
    s = GolombSet(np.array(sorted(values), np.int64))
    assert s.values().tolist() == sorted(values)
    asked = np.array([*probes, *list(values)[:20]], np.int64)
    assert s.contains(asked).tolist() == [int(x) in values for x in asked]
    again = GolombSet.from_bytes(s.to_bytes())
    assert again.values().tolist() == sorted(values) and again.contains(asked).tolist() == s.contains(asked).tolist()


def test_growing_set():
    rng = np.random.default_rng(1)
    grown, all_ = GrowingGolombSet(), set()
    for _ in range(40):
        new = np.unique(rng.integers(0, 1 << 30, 500))
        new = new[~grown.contains(new)]
        grown.add(new)
        all_ |= set(new.tolist())
    assert len(grown) == len(all_) and len(grown.runs) <= 12 and grown.contains(np.array(sorted(all_))).all()
    assert grown.bytes_used() * 8 / len(grown) < 20


def test_seen_before_with_a_hot_key_and_many_collisions(spark):
    rng = random.Random(2)
    keys = ["hot" if rng.random() < 0.34 else f"k{rng.randint(0, 900)}" for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "row_id long, kv_key string")
    known = spark.createDataFrame([(f"k{i}",) for i in range(0, 900, 7)], "kv_key string")
    want, there = [], {f"k{i}" for i in range(0, 900, 7)}
    for i, k in enumerate(keys):
        if k in there:
            want.append(i)
        there.add(k)
    for inverse in (1024, 1):  # with a target range as small as the rows there are many false positives, all taken out
        assert sorted(r[0] for r in p2_seen.seen_before(rows, known, fp_inverse=inverse).collect()) == want
    figures = p2_seen.report(rows, known, fp_inverse=1).first()
    assert 0 < figures["false_positives"] < len(keys) - len(want) and figures["surely_new"] + figures["false_positives"] == len(keys) - len(want)
    assert 0.5 < figures["audited_rate"] / figures["theoretical_rate"] < 2 and figures["audited_rate"] <= figures["theoretical_bound"]


def test_the_sets_decide(spark, monkeypatch):
    """A set that forgets, or that takes everything for seen, changes the rows: the check that follows only looks where two keys met."""
    rows = spark.createDataFrame([(i, f"k{i % 500}") for i in range(1000)], "row_id long, kv_key string")
    known = spark.createDataFrame([], "kv_key string")
    probe = p2_seen._probe
    assert p2_seen.seen_before(rows, known).count() == 500

    def with_set(answer):
        def made(*args):
            def run(batches):
                kept = p2_seen.GrowingGolombSet.contains
                p2_seen.GrowingGolombSet.contains = lambda self, probes: np.full(len(probes), answer)
                try:
                    yield from probe(*args)(batches)
                finally:
                    p2_seen.GrowingGolombSet.contains = kept

            return run

        return made

    for answer, count in ((True, 1000), (False, 500)):  # one block of arrival: what forgets still sees repetitions within it
        monkeypatch.setattr(p2_seen, "_probe", with_set(answer))
        assert p2_seen.seen_before(rows, known).count() == count


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=8), max_size=12))
def test_last_seen(records):
    codes = np.array([t for r in records for t in r], np.int64)
    record = np.array([i for i, r in enumerate(records) for _ in r], np.int64)
    occurrences, in_records = last_seen(codes, record, 6)
    assert occurrences.tolist() == [sum(r.count(t) for r in records) for t in range(6)]
    assert in_records.tolist() == [sum(t in r for r in records) for t in range(6)]


def test_every_pair_is_scored_before_any_is_chosen(spark, data, monkeypatch):
    score = p6_distinctive.log_likelihood_ratio
    monkeypatch.setattr(p6_distinctive, "log_likelihood_ratio", lambda tf, *counts: F.when(tf == 1, F.raise_error("scored").cast("double")).otherwise(score(tf, *counts)))
    with pytest.raises(Exception, match="scored"):
        p6_distinctive.p6_found(spark, data).collect()  # terms that occur once are never a case


def test_no_score_without_a_table(spark, data, monkeypatch):
    rows = spark.createDataFrame([(2, 10, 8), (2, 10, 1), (2, 1, 8), (2, 10, 95), (2, 10, None), (0, 10, 8)], "tf long, length long, cf long")
    scores = [r[0] for r in rows.select(p6_distinctive.log_likelihood_ratio(F.col("tf"), F.col("length"), F.col("cf"), 100)).collect()]
    assert scores[0] > 0 and scores[1:] == [None] * 5
    found, join = p6_distinctive.p6_found(spark, data).collect(), p6_distinctive.skew_join
    lost = found[0]["term"]
    monkeypatch.setattr(p6_distinctive, "skew_join", lambda *a: join(*a).withColumn("cf", F.when(F.col("term") != lost, F.col("cf"))))
    assert sorted(p6_distinctive.p6_found(spark, data).collect()) == sorted(r for r in found if r["term"] != lost)


def test_copies(spark):
    rows = [(1, "A Book", "Grey goose."), (2, "a  book", "GREY​goose"), (3, "Grey goose", "A book!"), (4, "A Book", "grey gosling"), (5, "T", "a: 1; b: 2; c: 3"), (6, "t", "c: 3 | A = 1 | b: 2"), (7, "t", "a: 2; b: 1; c: 3"), (8, "STRASSE", ""), (9, "Straße", None), (10, "café", ""), (11, "café", ""), (12, "x; y", ""), (13, "x: 1; y: 2", "")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    got = {tuple(r) for r in p3_copies.copies(p3_copies.document_records(docs)).where("doc_id > copy_of").collect()}
    assert got == {(2, 1), (3, 1), (6, 5), (9, 8)}


def test_copies_with_a_field_list_as_title(spark):
    rows = [(1, "Kind: moth; Place: mill; Year: 1951", "A note"), (2, "A NOTE", "year = 1951 | kind = moth | place = mill"), (3, "Kind: moth\nYear: 1951;​;Place: mill", "a note"), (4, "Kind: moth; Place: mill", "A note"), (5, "a note", "Kind: moth; Place: mill"), (6, "Kind moth; place mill; year 1951", "A note"), (7, "a: 1; b: 2; c: 3", "d: 4; e: 5; f: 6"), (8, "f: 6; b: 2; d: 4", "c: 3; a: 1; e: 5"), (9, "Kind: moth; Place: mill; Year: 1951", "Aㅤ note"), (10, "ㅤ", "ㅤ")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, content string")
    got = {tuple(r) for r in p3_copies.copies(p3_copies.document_records(docs)).where("doc_id > copy_of").collect()}
    assert got == {(2, 1), (3, 1), (9, 1), (5, 4), (8, 7)}
    assert {r["doc_id"]: r["copies"] for r in p3_copies.collapsed(p3_copies.document_records(docs)).collect()} == {1: 4, 4: 2, 6: 1, 7: 2}


def test_copies_of_nested_records(spark):
    """Against brute force: nested arrays, maps and structs are equal as trees without order."""
    rng = random.Random(8)
    kind = "struct<a: string, b: array<struct<x: string, y: array<string>>>, c: map<string, string>>"

    def word():
        return rng.choice(["Moth", "moth", "MILL.", "mill", "", None, " - "])

    def record():
        return (word(), [(word(), [word() for _ in range(rng.randint(0, 2))]) for _ in range(rng.randint(0, 2))], {k: word() for k in rng.sample("kl", rng.randint(0, 2))})

    def norm(x):
        return "".join(ch for ch in (x or "").lower() if ch.isalnum())

    def tree(r):
        a, b, c = r
        inner = [tuple((n, v) for n, v in (("x", norm(x)), ("y", tuple(sorted(norm(w) for w in y if norm(w))))) if v) for x, y in b]
        return norm(a), tuple(sorted(t for t in inner if t)), tuple(sorted((k, norm(v)) for k, v in c.items() if norm(v)))

    rows = [(i, record()) for i in range(300)]
    df = spark.createDataFrame(rows, f"doc_id long, record {kind}")
    first: dict = {}
    for i, r in rows:
        first.setdefault(tree(r), []).append(i)
    want = {(i, g[0]) for g in first.values() if len(g) > 1 for i in g}
    assert {tuple(r) for r in p3_copies.copies(df, df.schema["record"].dataType).collect()} == want


@pytest.mark.parametrize(
    "a,b",
    [("ｆｕｌｌ", "full"), ("café", "café"), ("ﬁne", "fine"), ("a​b", "ab"), ("a b", "a b"), ("соре and", "cope and"), ("Тhе Bооk", "The Book"), ("Cepый гycь", "Серый гусь"), ("iй їжак", "ій їжак"), ("ﾊﾟﾝ", "パン"), ("Τhe οld", "The old"), ("soft­hyphen", "softhyphen")],
)
def test_same_look(a, b):
    assert normal_form(a) == normal_form(b) == normal_form(normal_form(a))


@pytest.mark.parametrize("a,b", [("Case", "case"), ("cafe", "café"), ("a b", "a  b"), ("a\tb", "a b"), ("a.", "a"), ("“a”", '"a"'), ("мир", "mip"), ("a-b", "a–b")])
def test_other_look(a, b):
    assert normal_form(a) != normal_form(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normal_form_is_stable_and_composes(text):
    form = normal_form(text)
    assert normal_form(form) == form
    assert unicodedata.is_normalized("NFC", form.replace("ำ", "")) or not unicodedata.is_normalized("NFC", form)
    assert normal_form(unicodedata.normalize("NFD", text)) == normal_form(unicodedata.normalize("NFC", text))


def test_lookalike_pairs(spark):
    rows = [(1, "The Book", "x"), (2, "Тhе Book", "x"), (3, "The Book", "x"), (4, "The book", "x"), (5, "Тhe Book", "x")]
    got = {tuple(r) for r in p4_lookalike.lookalike_pairs(spark.createDataFrame(rows, "doc_id long, title string, content string")).collect()}
    assert got == {(1, 2), (2, 3), (1, 5), (3, 5), (2, 5)}


def test_lookalike_pairs_of_a_hot_look(spark):
    """Two spellings, one of them 3,000 times, and a look with many spellings: against brute force, in small blocks too."""
    rows = [(i, "The Book" if i % 1000 else "Тhe Book", "x") for i in range(1, 3001)] + [(9000 + i, "cope" if not i else "".join(c if i >> k & 1 else d for k, (c, d) in enumerate(zip("соре", "cope"))), "y") for i in range(16)]
    docs = spark.createDataFrame([*rows, (None, "Тhe Book", "x")], "doc_id long, title string, content string")
    want = {(min(a, b), max(a, b)) for a in (1000, 2000, 3000) for b in range(1, 3001) if b % 1000} | {(9000 + i, 9000 + j) for i in range(16) for j in range(i + 1, 16)}
    for block, fan in ((256, 1024), (16, 4)):
        got = [tuple(r) for r in p4_lookalike.lookalike_pairs(docs, block, fan).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("text,want", [("ɑpple", "apple"), ("ɡoose", "goose"), ("𝐁𝐨𝐨𝐤", "Book"), ("Ꭺ", "A"), ("ꓮ", "A"), ("Ⲟ", "O")])
def test_letters_of_rare_scripts(text, want):
    assert normal_form(text) == want


def test_language_held_out(spark, data):
    rows = [(r["lang"], r["sample_text"]) for r in spark.read.parquet(f"{data}/lang_samples.parquet").orderBy("sample_id").collect()]
    langs = sorted({x for x, _ in rows})
    model = fit(rows[::2], langs)
    test = rows[1::2]
    right = sum(langs[int(s.argmax())] == lang for s, (lang, _) in zip(model.scores([words(t) for _, t in test]), test, strict=True))
    assert right / len(test) > 0.98
    by = {x: [t for y, t in test if y == x] for x in langs}
    mixed = model.scores([words(t) for t in [*by["en"][:4], *by["ru"][:2]]])
    chosen, shares = mixture(mixed)
    assert {langs[i] for i in chosen} == {"en", "ru"} and abs(dict(zip([langs[i] for i in chosen], shares, strict=True))["en"] - 2 / 3) < 0.05
    assert len(mixture(model.scores([words(t) for t in by["de"]]))[0]) == 1


def test_settled_documents_and_joined_evidence(spark, data):
    """Documents settled without splitting have the languages that their segments have; joined evidence gives what the broadcast gives."""
    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    docs, samples, codes = read("doc_store").where("doc_id % 3 = 0"), read("lang_samples"), read("lang_codes")
    full = {(r["doc_id"], r["lang"]) for r in p1_language.segments(docs, samples, codes).collect() if r["lang"] and r["confidence"] > 0}
    for most in (10**6, 0):
        brief = p1_language.segments(docs, samples, codes, brief=True, most_shared=most).collect()
        assert {(r["doc_id"], r["lang"]) for r in brief} == full and any(r["part"] is None for r in brief)


def test_mixture_looks_beyond_four_candidates():
    scores = np.zeros((200, 6))
    scores[:, 1:5] = np.where(np.arange(200) < 100, 0.2, -5.0)[:, None]  # high bounds that no share reaches
    scores[:, 5] = np.where(np.arange(200) == 150, 19.0, -30.0)
    assert mixture(scores)[0] == [0, 5]


@pytest.mark.parametrize("units", [3, 100, 1000])
def test_short_sentence_in_another_script(units):
    model = fit([("en", "the grey goose counts the lantern and the lamp"), ("ru", "серый гусь считает фонарь"), ("ja", "灰色の鳥がいる")], ["en", "ja", "ru"])
    english = [words("the goose counts the lamp")] * units
    for text, lang in (("Хмурый филин.", 2), ("Ждём!", 2), ("雨傘", 1)):
        found, whole = main_words(text)
        assert whole and set(mixture(model.scores([*english, found], [True] * units + [whole]))[0]) == {0, lang}
    for text in ("EË", "See Хмурый now", "The goose"):  # shapes of any script, a name in a sentence, the same language
        found, whole = main_words(text)
        assert mixture(model.scores([*english, found], [True] * units + [whole]))[0] == [0]


def split(text, *corpus):
    return [text[a:b] for a, b in Splitter(*corpus).split(text)]


#: What a corpus tells of the words in the cases below.
ABBREVIATIONS = dict.fromkeys("mr fig i.e г ул z κ".split(), "n")


@pytest.mark.parametrize(
    "text,want",
    [
        ("Mr. Gudeju (see fig. 3) waits... and then leaves. Who is it?! “Stop. Go!” she says.", ["Mr. Gudeju (see fig. 3) waits... and then leaves.", "Who is it?!", "“Stop. Go!” she says."]),
        ("It costs 3.5 coins, i.e. more.Next one. J. P. Lee sees lamps, ropes, etc. The end.", ["It costs 3.5 coins, i.e. more.", "Next one.", "J. P. Lee sees lamps, ropes, etc.", "The end."]),
        ("В 1951 г. Венуги чинит это на ул. Ладуто. «Стой. Не двигайся!» — шепчет он.", ["В 1951 г. Венуги чинит это на ул. Ладуто.", "«Стой. Не двигайся!» — шепчет он."]),
        ("她说：“等。走吧！”然后走了。谁在？多好！", ["她说：“等。走吧！”然后走了。", "谁在？", "多好！"]),
        ("ใครวาดร่มขาด คนสวนวาดโคมไฟแตก เชือก แผนที่ ฯลฯ นี่คือเรื่องของ Mepo กับคน", ["ใครวาดร่มขาด", "คนสวนวาดโคมไฟแตก เชือก แผนที่ ฯลฯ", "นี่คือเรื่องของ Mepo กับคน"]),
        ("A heading\n\n1. One item\n2. Two. Items\n\nA line wrapped\nhere. Ok.", ["A heading", "1. One item", "2. Two. Items", "A line wrapped\nhere.", "Ok."]),
        ("Am 25. Mai um 5.30 Uhr kam z. B. der Otter. Das war alles.", ["Am 25. Mai um 5.30 Uhr kam z. B. der Otter.", "Das war alles."]),
        ("Γιατί μαζεύει το ψωμί; Ο κ. Δοτζε ξέρει.", ["Γιατί μαζεύει το ψωμί;", "Ο κ. Δοτζε ξέρει."]),
        ("« Attends. Ne bouge pas ! » murmure Lajagi. Quelle journée ! Oui.", ["« Attends. Ne bouge pas ! » murmure Lajagi.", "Quelle journée !", "Oui."]),
        ("यह कहानी है। “रुको। मत हिलो!” कहकर वह गया।", ["यह कहानी है।", "“रुको। मत हिलो!” कहकर वह गया।"]),
        ("note without end\nanother line", ["note without end", "another line"]),
    ],
)
def test_sentences(text, want):
    assert split(text, ABBREVIATIONS, frozenset(), {"mai"}) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="Ab.!?«»\"( )\n1,-–ก ฯ。я;", max_size=60))
def test_sentences_cover_everything(text):
    at = 0
    for a, b in Splitter().split(text):
        assert at <= a < b and not text[at:a].strip() and text[a:b].strip() == text[a:b]
        at = b
    assert not text[at:].strip()


def test_corpus_abbreviations():
    found = abbreviations([("prof", 0, 100, 0), ("sea", 0, 50, 10), ("fig", 20, 1, 0), ("rare", 0, 2, 0)], 0.15)
    assert found == {"prof": "n", "sea": "f", "fig": "n"}


@pytest.mark.parametrize("size", [1, 10, 1000, 100_000])
def test_abbreviations_at_every_size(size):
    words_ = [("capt", 0, 999 * size, size), ("sea", 0, 860 * size, 140 * size), ("wise", 0, 900 * size, 100 * size), ("fig", 300 * size, 10 * size, 2 * size)]
    assert abbreviations(words_, 0.15) == {"capt": "n", "sea": "f", "wise": "f", "fig": "n"}
    assert abbreviations([("st", 0, 970 * size, 30 * size)], 0.15) == {}


def test_collisions(spark):
    """Keys that share a reduced value: each one's first row is new, but not that of a known key."""
    rows = [(7, 1, 10), (7, 1, 90), (7, 2, 11), (8, 3, 12), (8, 3, 70), (9, 4, None), (9, 5, 13), (9, 4, 80), (11, 6, 14), (11, 7, 15)]
    arrivals = spark.createDataFrame(rows, "value long, check long, row long").coalesce(1)
    for size in (1, 2, 3, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(r[0] for r in p2_seen.collided(arrivals).collect()) == [10, 11, 13, 14, 15]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert p2_seen.collided(arrivals.where("false")).count() == 0
    assert sorted(r[0] for r in p2_seen.collided(arrivals).collect()) == [10, 11, 13, 14, 15]


def test_document_before_corpus():
    text = "The xyz. of old, the xyz. of now. Here xyz. Gudeju waits."
    assert split(text) == split(text, {"xyz": "f"}) == ["The xyz. of old, the xyz. of now.", "Here xyz. Gudeju waits."]
    assert split("Here xyz. Gudeju waits.") == ["Here xyz.", "Gudeju waits."]  # no evidence in this document
    assert split("Here xyz. Gudeju waits.", {"xyz": "n"}) == ["Here xyz. Gudeju waits."]
    both = "Here xyz. Otter waits, as an otter does. Otter, I say, as to any otter."
    assert split(both, {"xyz": "n"})[0] == "Here xyz."  # the document has the next word in small letters
    assert len(split("The ABC-quartz. of old. Here ABC-quartz. Gudeju waits.")) == 2  # abbreviations of any length
    long = "x" * 200 + "q"
    assert split(f"The {long}. of old, the {long}. of now. Here {long}. Gudeju waits.")[-1] == f"Here {long}. Gudeju waits."


def test_capital_within_a_sentence_marks_a_title():
    assert len(split("The baker met Mr. Baker by the sea.", {"mr": "n"})) == 1
    assert split("She said no. Baker, a baker, left.", {"no": "n"}) == ["She said no.", "Baker, a baker, left."]


def test_months_after_numbers():
    rows = [("mai", 40, 40), ("der", 4000, 30), ("gudeju", 1, 1), ("oktober", 9, 8)]
    assert sorted(after_numbers(rows, 0.02)) == ["mai", "oktober"] and list(after_numbers([], 0.0)) == []
    assert split("Am 25. Mai kam er. Am 5. Der Otter ging.", {}, frozenset(), {"mai"}) == ["Am 25. Mai kam er.", "Am 5.", "Der Otter ging."]


@pytest.mark.parametrize("mark", ["د. Fimeka يجمع النهر هنا", "यहाँ डॉ. Sosaju गरम रोटी", "J. P. Lee sees it"])
def test_initials_of_any_script(mark):
    assert len(split(mark)) == 1


def test_joined_evidence_gives_the_same(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "No id. Here.")], "doc_id long, text string"))
    rows = [sorted(p9_sentences.sentences(docs, most_shared=n).collect(), key=repr) for n in (10**6, 0)]
    assert rows[0] == rows[1] and len(rows[0]) > 500


def test_sentences_that_end_with_abbreviations():
    corpus = {"no": "n", "г": "n", "fig": "n", "cf": "n"}
    assert split("She said no. Then they left, and then they slept.", corpus) == ["She said no.", "Then they left, and then they slept."]
    assert split("Это было в 1951 г. Он родился там.", corpus, frozenset({"он"})) == ["Это было в 1951 г.", "Он родился там."]
    assert len(split("The baker came by no. Gudeju, cf. Fig. 3 or fig. 4.", corpus)) == 1
    assert len(split("A rose by no. Rose and Rose, Rose there.", corpus, frozenset({"rose"}))) == 1  # mostly a name in this document


def test_rare_abbreviation_of_a_large_corpus(spark):
    rows = [(1, "The goose. " * 100_000), (2, "One xyz. of it, an xyz. of us, the xyz. of now."), (3, "Here xyz. Gudeju waits.")]
    got = p9_sentences.sentences(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == {1: 100_000, 2: 1, 3: 1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=60), st.integers(0, 5))
def test_packing(sizes, seed):
    start = first_packing(sizes, 100)
    bins = evolve([start], sizes, 100, seed)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(start)


def _exact_bins():
    rng = random.Random(0)
    sizes = []
    for _ in range(40):  # bins that can be filled exactly
        a, b = rng.randint(20, 45), rng.randint(15, 35)
        sizes += [a, b, 100 - a - b]
    return sizes


def test_evolution_beats_best_fit():
    sizes = _exact_bins()
    assert len(evolve([first_packing(sizes, 100)], sizes, 100, 1, generations=24)) < len(first_packing(sizes, 100))


def test_islands_beat_best_fit(spark):
    sizes = _exact_bins()
    items = spark.createDataFrame([("c", 100, i, 0, n) for i, n in enumerate(sizes)], "container string, capacity long, doc_id long, part int, tokens long")
    rows, figures = p7_containers.pack_items(items)
    assert rows.select("bin").distinct().count() < len(first_packing(sizes, 100)) and figures["c"]["bins_saved"] > 0 and figures["c"]["cells_evolved"] == 1


def test_a_container_goes_on_whatever_others_do(spark):
    rng = random.Random(5)
    easy = [("easy", 100, i, 0, rng.randint(5, 45)) for i in range(1500)]
    hard = [("hard", 100, i, 0, 60) for i in range(3000)]
    kind = "container string, capacity long, doc_id long, part int, tokens long"
    both, figures = p7_containers.pack_items(spark.createDataFrame(easy + hard, kind), cell=32, kept_fill=0.97)
    alone = p7_containers.pack_items(spark.createDataFrame(easy, kind), cell=32, kept_fill=0.97)[0].collect()
    both = both.collect()
    assert len(both) == len({(r["container"], r["doc_id"]) for r in both}) == 4500
    assert sorted(tuple(r) for r in both if r["container"] == "easy") == sorted(tuple(r) for r in alone)
    assert len({r["bin"] for r in both if r["container"] == "hard"}) == 3000 and figures["hard"]["rounds"] == 2
    assert len({r["bin"] for r in alone}) <= 1.02 * sum(r["tokens"] for r in alone) / 100


def test_cube_flight_keeps_totals():
    rng = random.Random(4)
    sizes, chances = [float(rng.randint(1, 500)) for _ in range(300)], [0.3] * 300
    flown = flight(sizes, chances, rng)
    assert sum(0 < x < 1 for x in flown) <= 2 and all(0 <= x <= 1 for x in flown)
    assert abs(sum(flown) - 90) < 1e-6 and abs(sum(s * x for s, x in zip(sizes, flown, strict=True)) - 0.3 * sum(sizes)) < 1e-6
    landed = landing(sizes, chances, flown)
    assert set(landed) <= {0.0, 1.0} and abs(sum(s * x for s, x in zip(sizes, landed, strict=True)) - 0.3 * sum(sizes)) < 5 and abs(sum(landed) - 90) <= 1
    mean = np.mean([flight([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [0.5] * 6, random.Random(k)) for k in range(400)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.1  # no chance changes in expectation


def test_plan():
    needed = plan({"a": 100, "b": 10, "c": 0}, [("a", 0.5, 1), ("b", 0.5, 3), ("c", 0.2, 9)])
    assert needed == {"a": pytest.approx(0.3), "b": pytest.approx(3.0)}
    assert plan({}, [("a", 1.0, 1)]) == {}


def test_balanced_sample_in_rounds(spark):
    rng = random.Random(9)
    rows = [("s", i, rng.randint(1, 300), 0.25) for i in range(2000)]
    got = balanced_sample(spark.createDataFrame(rows, "source string, doc_id long, tokens long, chance double"), cell=128).collect()
    assert len({r["doc_id"] for r in got}) == len(got) and abs(len(got) - 500) <= 3
    assert abs(sum(r["tokens"] for r in got) - sum(r[2] for r in rows) / 4) < 300


def test_token_counts():
    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        vocabulary = f.read()
    assert count_tokens("The grey goose", vocabulary) == 3 and count_tokens("", vocabulary) == count_tokens(None, vocabulary) == 0
