import random
import zlib

from pyspark.sql import functions as F

from cairnfield.llm import toxicity

WORDS = {"idiot": 4.0, "scum": 4.0}


def score(text, stems={}):
    return sum(s for _, _, s in toxicity.Scorer(WORDS, stems).clauses(text))


def test_grammar_orders_clauses():
    direct, plain = score("You are an idiot."), score("That idiot went home.")
    aimed, negated, told = score("Such an idiot, you know."), score("You are not an idiot."), score("He said you are an idiot.")
    assert direct > aimed > plain > told > negated > 0
    assert score("You are here. An idiot went home.") == plain
    assert score("Not here or there or anywhere, idiot") == plain and score("Nothing here. No: a kidiot") == 0


def test_threats_are_patterns_not_words():
    for t in ("I will kill you", "I will hurt you badly.", "Ich werde dich töten", "Je vais te frapper", "Te mataré", "Voy a matarte", "Kill yourself", "someone should shoot your dog"):
        assert score(t) > 0, t
    for t in ("I will kill time", "They kill you with kindness in this attack", "The attack hurt nobody", "You will see. Kill the process", "Der Schlag wird verletzen", "il faut frapper avant d'entrer"):
        assert score(t) == 0, t
    assert score("I will not hurt you") < score("He said I will hurt you") < score("I will hurt you")


def test_the_speaker_threatens_and_the_victim_is_no_subject():
    for t in ("Cancer will kill you.", "You will hurt your back.", "I want you to hurt the feelings of none", "Smoking is going to kill you", "I want you to beat the eggs.", "I will beat you at chess.", "Ihr werdet euch verletzen", "Tu veux frapper le ballon"):
        assert score(t) == 0, t
    for t in ("I am going to kill you", "We will hurt your dog", "I'll kill you", "Gonna hurt you", "Te voy a matar", "Jemand sollte dich töten", "Quiero golpearte", "Je veux te tuer", "I want to hurt you"):
        assert score(t) > 0, t


def test_quotes_before_the_verb_of_saying():
    plain, told = score("You are an idiot."), score("He said you are an idiot.")
    for t in ("You are an idiot, he said.", '"You are an idiot" said the man', "«You are an idiot», the man said", "You are an idiot, wrote she, you scum"):
        assert score(t) <= told * 2 and score(t.split(", you")[0]) == told < plain, t
    assert score("You are an idiot and nobody said so") == plain


def test_stems_match_at_word_starts_and_words_whole():
    assert score("vexolo and vexoin", {"vexo": 4.0}) == 2 * score("vexo", {"vexo": 4.0}) > 0 == score("megavexo", {"vexo": 4.0}) and score("idiotic") == 0


def best_by_enumeration(tokens):
    """All outputs of each transducer in turn, then the best sum: no composition, no dynamic programming."""

    def outputs(part, symbols):
        paths = [((), part.start)]
        for x in symbols:
            paths = [(out + (y,), n) for out, s in paths for y, _, n in part.step(s, x)]
        return {out for out, s in paths if part.final(s)}

    found = {tuple(x for x, _ in tokens)}
    for make in toxicity.CASCADE[:-1]:
        found = {o for f in found for o in outputs(make(), f)}
    return max((sum(toxicity.FACTORS.get(x, 0.0) * w for x, (_, w) in zip(f, tokens)) for f in found), default=0.0)


def test_best_path_against_enumeration():
    r, positive = random.Random(3), 0
    for _ in range(1500):
        tokens = [(x, r.choice([1.0, 2.5]) if x in "avfw" else 0.0) for x in r.choices("avfwmktnrocspy", k=r.randint(1, 7))]
        want = best_by_enumeration(tokens)
        assert abs(toxicity.clause_score(toxicity.grammar(), tokens) - want) < 1e-9
        positive += want > 0
    assert positive > 500


def test_composition_adds_weights():
    a = toxicity.Transducer(0, lambda s, x: [("y", 1.0, 0)] if x == "x" else [])
    b = toxicity.Transducer(0, lambda s, x: [("z", 2.0, 0)] if x == "y" else [])
    c = toxicity.compose(a, b)
    assert c.step(c.start, "x") == [("z", 3.0, (0, 0))] and c.step(c.start, "w") == []


ENDINGS = ["ling", "las", "or", "um", "ette", "ong", "ibus", "ado"]


def documents(n=500):
    rows, labels = [], []
    for i in range(n):
        r = random.Random(i)
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(60)]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(60), r.choice(["zorg" + r.choice(ENDINGS), "pathetic"]))
        if i % 7 == 0:
            words.insert(r.randrange(60), r.choice(["path", "wort"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_stems_need_endings_and_copies_count_once():
    rows, labels = documents()
    toxic, clean = ([t for (_, t), (_, _, y) in zip(rows, labels) if y == k] for k in (1, 0))
    copied = ["junkword over and over in one text " + " ".join(f"c{k}" for k in range(40))] * 30
    words, stems = toxicity.learn_lexicon(toxic + copied, clean)
    assert set(words) == {"pathetic"} and set(stems) == {"zorg"}


def test_words_of_a_shared_passage_count_once():
    passage = " ".join(f"invent{chr(97 + k)}ed" for k in range(20))
    r = random.Random(9)
    own = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60))
    toxic = [f"{own()} {passage} {own()} pathetic {own()}" for _ in range(60)]
    words, stems = toxicity.learn_lexicon(toxic, [own() for _ in range(200)])
    assert set(words) == {"pathetic"} and not stems


def test_ratio_is_nought_without_difference():
    assert abs(toxicity.ratio(5, 50, 10, 100)) < 1e-9 < toxicity.ratio(20, 50, 0, 100)


def test_held_out_documents(spark):
    rows, labels = documents()
    odd = [(9000, None), (9001, ""), (9002, "zorgling " * 30_000), (None, "pathetic zorgling"), (4, rows[4][1])]
    odd += [(9100 + i, t) for i, t in enumerate(["You are on the right path.", "Dein Wort ist gut.", "Your idiom and your morose pathology."])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(4, 1, 1), (None, 1, 1), (9003, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.classify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(by[i].predicted, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95
    assert not any(by[i].predicted for i in (9000, 9001, 9100, 9101, 9102)) and by[9002].predicted == by[None].predicted == 1
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.predicted)
    clauses = toxicity.matched_clauses(df.filter("doc_id = 9002"), model).collect()
    assert len(clauses) == 1 and clauses[0].start == 0


def test_on_the_table(spark):
    """Held-out documents of the table, and sentences with ordinary words that begin like abuse."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    common = {"path", "wort", "lose", "tras", "moro", "idio", "worth", "path", "mort", "with", "that", "para", "nicht", "avec"}
    assert not common & set(model.stems)
    scorer = toxicity.Scorer(model.words, model.stems)
    clean = ["You are on the right path.", "Dein Wort ist gut.", "Your idiom and your morose pathology.", "You lose, I win."]
    assert all(toxicity.score_text(model, scorer, t) < 0.5 for t in clean)
    found = toxicity.classify(docs, model).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = [r.predicted for r in found if r.toxic == 1]
    flagged = [r.predicted for r in found if r.toxic == 0]
    assert all(toxicity.score_text(model, scorer, t) > 0.5 for t in ("I will hurt you badly.", "You are an idiot."))
    assert sum(caught) / len(caught) > 0.9 and sum(flagged) / len(flagged) < 0.01


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.classify(df, toxicity.fit(df, none)).collect()] == [0.0, 0.0]
    assert toxicity.classify(df.limit(0), toxicity.fit(df, none)).count() == 0
