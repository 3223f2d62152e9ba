import random
import re
import time

import pytest

from regdelta.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id string, h string, key string"
ITEMS = "item_id long, text string, doc_id string"
QUESTION = "Every morning the baker called Anna sells 12 loaves of bread for 3 dollars each. How much money does Anna earn when 5 loaves remain on the shelf?"
FILLER = "quite other words stand here before it and they say nothing of note at all"


def flagged(spark, docs, items):
    frame = spark.createDataFrame([(*r, "x", "y", "z")[:5] for r in docs], DOCS)
    rows = D.contaminated(frame, spark.createDataFrame(items, ITEMS)).collect()
    kept = D.without_contaminated(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    return {(r.doc_id, r.item_id): r for r in rows}, sorted((r.doc_id for r in kept.collect()), key=str)


def test_verbatim_and_reparameterised(spark):
    other = QUESTION.replace("Anna", "Boris").replace("12", "40").replace("3 dollars", "7 euros").replace("5 loaves", "9 loaves")
    torn = QUESTION.replace("does Anna", "does Carla")
    docs = [
        (1, f"{FILLER}.\n{QUESTION}\n{FILLER}"),
        (2, f"{FILLER}.\n{other}\n{FILLER}"),
        (3, FILLER),
        (4, None),
        (5, ""),
        (None, QUESTION),
        (6, QUESTION),
        (6, QUESTION),
        (6, FILLER),
        (7, f"{'long words go on ' * 60_000}. {QUESTION}"),
        (8, "Anna 12 3 5 Anna Boris 7 8 9 " * 20),
        (9, torn),
        (10, " ".join(QUESTION.split()[:9])),
    ]
    items = [(1, QUESTION, "a"), (2, "short one here", "b"), (3, None, "c"), (4, "", "d"), (1, QUESTION, "a")]
    got, kept = flagged(spark, docs, items)
    assert {k for k in got} == {(1, 1), (2, 1), (None, 1), (6, 1), (7, 1), (9, 1)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[1, 1].coverage == 1.0
    # windows without the name that was changed are the item's own
    assert got[9, 1].verbatim
    assert kept == sorted([3, 4, 5, 6, 8, 10], key=str)


def test_short_items(spark):
    """Items of a few words match lines of these words alone; those of five words and more are windows."""
    docs = [
        (1, "a long and ordinary text that says yes once"),
        (2, "Yes!"),
        (3, "some line\n yes \nanother line"),
        (4, "well it is not so short one here it is"),
        (5, "two words"),
        (6, "two words more"),
        (7, "NO"),
    ]
    got, kept = flagged(spark, docs, [(1, "yes", ""), (2, "it is not so short one", ""), (3, "Two words", ""), (4, "?!", ""), (5, "N.O.", "")])
    assert set(got) == {(2, 1), (3, 1), (4, 2), (5, 3)}
    assert kept == [1, 6, 7]


def test_inconsistent_slots_do_not_count(spark):
    """Of mentions that the text gives to several names only those of the most frequent one are the question's; a window with two of them never is."""
    item = "Monday the neighbour Anna gave the red ball to Anna and later that day our Anna took the small ball from Anna again"
    names = iter(["Berta", "Carla", "Dora", "Emma"])
    torn = "".join(next(names) if part == "Anna" else part for part in re.split("(Anna)", item))
    got, _ = flagged(spark, [(1, f"so {item}".replace("Anna", "Berta")), (2, f"so {torn}")], [(1, f"so {item}", "")])
    assert set(got) == {(1, 1)}


def test_changes_of_single_slots(spark):
    one = "Every morning the baker called Anna sells 12 loaves of bread and her cousin sells 12 cakes at the market. How much does Anna earn when nothing is left on the shelf at noon?"
    docs = [
        (1, one.replace("does Anna", "does Carla")),
        (2, one.replace("12 loaves", "30 loaves").replace("12 cakes", "9 cakes")),
        (3, one.replace("Anna", "Mary Ann")),
        (4, f"{FILLER}. {one} {FILLER}".replace("12 loaves", "30 loaves").replace("Anna", "Mary Ann Lee")),
        (5, one.upper()),
    ]
    got, _ = flagged(spark, docs, [(1, one, "")])
    assert {d for d, _ in got} >= {1, 2, 3, 4}
    assert got[1, 1].verbatim and got[2, 1].coverage == 1.0 and got[3, 1].coverage == 1.0


def test_random_reparameterisations(spark):
    """New names and numbers, the same throughout: nine in ten are found; texts of the same words in another order are not."""
    rng = random.Random(5)
    words = "stone river bread every morning after lunch some children carry small boxes along quiet street before dinner while others wait near gate with heavy bags because rain falls".split()
    people = "Anna Boris Carla Dmitri Emma Farid Greta Hugo Ines Jonas".split()

    def question(rng):
        out = []
        for i in range(rng.randint(20, 50)):
            out.append("{p%d}" % rng.randrange(2) if rng.random() < 0.08 else "{n%d}" % rng.randrange(3) if rng.random() < 0.06 else rng.choice(words))
            if rng.random() < 0.06:
                out[-1] += "."
        return " ".join(out)

    def fill(t, rng):
        names = rng.sample(people, 2)
        return t.format(p0=names[0], p1=f"{names[1]} {rng.choice(people)}" if rng.random() < 0.3 else names[1], **{f"n{k}": rng.randint(2, 900) for k in range(3)})

    made = [question(rng) for _ in range(60)]
    items = [(i, fill(t, rng), "") for i, t in enumerate(made)]
    docs = [(i, f"{FILLER}. {fill(t, rng)}. {FILLER}") for i, t in enumerate(made)]
    docs += [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, (_, t, _) in enumerate(items)]
    got, _ = flagged(spark, docs, items)
    assert len([i for i in range(60) if (i, i) in got]) >= 54
    assert not [k for k in got if k[0] >= 1000]


def test_windows_that_many_items_share(spark):
    """A passage that all items share brings up none of them by itself."""
    shared = "which of the following statements about the text above is right and why do you think so"
    items = [(i, f"{shared} {' '.join(f'{w}{chr(97 + i)}' for w in 'alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho pi tau phi chi psi'.split())}", "") for i in range(20)]
    docs = [(1, shared), (2, items[3][1]), (3, f"{items[4][1][:-20]} {items[5][1]}")]
    got, _ = flagged(spark, docs, items)
    assert set(got) == {(2, 3), (3, 4), (3, 5)}


@pytest.mark.parametrize("block,broadcast", [(7, 1 << 17), (1 << 21, 0)])
def test_blocks_and_shuffled_join_give_the_same(spark, monkeypatch, block, broadcast):
    marks = {i: chr(97 + i) * 3 for i in range(12)}
    items = [(i, f"item number word{m} alpha{m} beta{m} gamma{m} delta{m} and the rest of word{m} follows here soon", "") for i, m in marks.items()]
    docs = [(100 + i, f"before it. {t} after") for i, t, _ in items] + [(1, FILLER)]
    want = {(100 + i, i) for i in range(12)}
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(D, "BROADCAST_ROWS", broadcast)
    assert set(flagged(spark, docs, items)[0]) == want


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, QUESTION, "")], ITEMS)
    empty, docs = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, QUESTION, "", "", "")], DOCS)
    assert D.contaminated(docs, none).count() == 0 and D.contaminated(empty, some).count() == 0
    assert D.without_contaminated(docs, none).count() == 1


def test_windows_match_a_plain_search(spark):
    """On the given table: documents that hold an item's words in order are those found."""
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: " " + " ".join(x.lower() for x in D.TOKEN.findall(t) if x not in ".!?\n") + " "
    texts = {r.item_id: words(r.text) for r in items.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for t in [words(d.text)] for i, x in texts.items() if x in t}
    assert {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()} == want


def test_names_that_open_sentences(spark):
    item = "Anna has 3 apples. Anna buys 5 more."
    long = "Anna went to the old market with 3 friends. Anna bought them 5 apples and some bread. Anna paid 7 coins and kept the rest at home."
    short = "How many apples does Anna have now"
    to_boris = lambda t: t.replace("Anna", "Boris").replace("3", "4").replace("5", "6").replace("7", "9")
    docs = [
        (1, to_boris(item)),
        (2, f"{FILLER}. {to_boris(long)} {FILLER}"),
        (3, f"Q: {short.replace('Anna', 'Boris')}"),
        (4, to_boris(item).replace("Boris buys", "Carla buys")),
        (5, f"{FILLER}. {long}"),
    ]
    got, kept = flagged(spark, docs, [(1, item, ""), (2, long, ""), (3, short, "")])
    assert set(got) == {(1, 1), (2, 2), (3, 3), (5, 2)}
    assert got[5, 2].verbatim and not got[2, 2].verbatim and got[2, 2].coverage == 1.0
    assert kept == [4]


def test_numbers_that_are_written_out(spark):
    """New numbers, in digits or in words of four languages: nine in ten are found."""
    rng = random.Random(3)
    words = "stone river bread every morning after lunch some children carry small boxes along quiet street before dinner while others wait near gate with heavy bags because rain falls".split()
    numbers = ["12", "3,400", "Twelve", "forty-two", "one hundred", "three hundred thousand", "seventeen", "3 million", "dreiundvierzig", "zwölf", "quatre-vingt-dix", "trente", "veinticuatro", "sesenta mil"]

    def question(rng):
        return " ".join("{n%d}" % rng.randrange(3) if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randint(25, 50))) + " {n0} stones"

    fill = lambda t: t.format(**{f"n{k}": n for k, n in enumerate(rng.sample(numbers, 3))})
    made = [question(rng) for _ in range(50)]
    items = [(i, fill(t), "") for i, t in enumerate(made)]
    docs = [(i, f"{FILLER}. {fill(t)}. {FILLER}") for i, t in enumerate(made)]
    docs += [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t, _ in items]
    got, _ = flagged(spark, docs, items)
    assert len([i for i in range(50) if (i, i) in got]) >= 45
    assert not [k for k in got if k[0] >= 1000]
    canon = D.Canon()
    for number in numbers:
        t = canon(f"there are {number} stones here").named
        assert t.held.tolist() == [False, False, True, False, False], number
    assert len(canon("there are " + "million " * 40 + "stones").plain) == 2 + 3 + 1


def test_templates_of_rare_words_cost_less_than_the_pattern():
    """Words that hardly repeat, as in a large corpus: all of the template takes less CPU time than matching TOKEN would by itself."""
    rng = random.Random(11)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(300_000))
    canon = D.Canon()
    canon(text[:1000])

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    assert min(seconds(lambda: canon(text)) for _ in range(3)) < min(seconds(lambda: D.TOKEN.findall(text)) for _ in range(3))


@pytest.mark.parametrize("piece", [4, 1 << 19])
def test_tokens_are_those_of_the_pattern(monkeypatch, piece):
    """Begin and end as TOKEN has them, hashes equal where the lower case is, in pieces of any size."""
    monkeypatch.setattr(D, "PIECE", piece)
    rng, codes, words = random.Random(2), {}, {}
    some = [*"aabcDEéßΣσςİiIıǅ0159½²一二人''’\u0301\u0307.,..!?\n  \t%$€£°-_\0😀٣Ⅷªº", "Anna ", "zwölf ", "twenty ", "km ", "Million ", "ΟΔΟΣ "]
    for _ in range(2000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        begin, end, code, kind = D.characters().split(text)
        tokens = [text[a:b] for a, b in zip(begin, end)]
        assert tokens == D.TOKEN.findall(text), text
        for token, x, k in zip(tokens, code.tolist(), kind.tolist()):
            low = token.lower()
            assert codes.setdefault(low, x) == x and words.setdefault(x, low) == low
            want = D.BREAK if token == "\n" else D.END if token in ".!?" else D.NUMBER if token[0].isnumeric() else D.NUMERAL if low in D.NUMERALS else D.UNIT if low in D.UNITS else None
            assert k == (want if want is not None else D.CAPITAL if token[0].isupper() else D.WORD), token


def test_texts_of_a_batch_stay_apart(spark):
    """Texts are read many at once: nothing goes on from one to the next, and each has its own places and readings."""
    half = len(QUESTION) // 2
    docs = [(1, QUESTION[:half]), (2, QUESTION[half:]), (3, ""), (4, f"{FILLER} {QUESTION}"), (5, None), (6, "Yes"), (7, "no\nyes"), (8, FILLER), (9, "yes it is"), (10, QUESTION.replace("Anna", "Boris"))]
    for parts in (1, 3):
        frame = spark.createDataFrame([(*r, "x", "y", "z") for r in docs], DOCS).coalesce(parts)
        found = D.contaminated(frame, spark.createDataFrame([(1, QUESTION, ""), (2, "yes", "")], ITEMS)).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(4, 1), (10, 1), (6, 2), (7, 2)}
        assert all(r.coverage == 1.0 for r in found)
    texts = ["it weighs 12", "kg and more. Anna", "", "Berta has twenty", "one km", "\n", "yes", "Zwölf"]
    canon = D.Canon()
    together, bounds = canon(*texts), canon(*texts).bounds.tolist()
    for k, alone in enumerate(map(canon, texts)):
        for t, own in ((together.plain, alone.plain), (together.named, alone.named)):
            rows = [(i, h, x) for i, h, x in zip(t.at.tolist(), t.held.tolist(), t.template.tolist()) if bounds[k] <= i < bounds[k + 1]]
            assert [(i - bounds[k], h, x) for i, h, x in rows] == list(zip(own.at.tolist(), own.held.tolist(), own.template.tolist()))
        assert bool(together.two[k]) == (alone.named is not alone.plain)
