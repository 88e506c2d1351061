import datetime as dt
import random

import numpy as np
import pytest

from lexmill.llm import abuse, mixing, packing, pairs, queries, scans, tokens

T0 = dt.datetime(2024, 1, 1)


# ---- pairs --------------------------------------------------------------------------------------

Q = "How often must a bank review the capital plan?"


@pytest.mark.parametrize("answer, nothing", [(None, True), ("", True), (" \n​", True), ("N/A", True), ("[]", True), ("Answer:", True), ("<empty>", True), ("None of them", False), ("No", False), ("12", False)])
def test_empty(answer, nothing):
    assert pairs.says_nothing(answer) is nothing


@pytest.mark.parametrize("answer, copy", [
    (Q, True), (Q.upper(), True), ("You asked: " + Q, True), ("**" + Q[:-1] + "**", True), ("Q:  How often must a bank  review the capital plan", True),
    ("You want to know: " + Q, True), ("Thank you for your query: " + Q, True), (Q.replace("capital", "captial"), True), (Q + " Yes.", False), (Q + " The board.", False),
    (Q + " Every 12 weeks.", False), ("A bank must review the capital plan every 12 weeks.", False), ("Yes", False),
])
def test_copy(answer, copy):
    assert pairs.is_copy(Q, answer) is copy


@pytest.mark.parametrize("answer, no", [
    ("I'm sorry, but I can't help with that request.", True), ("Lo siento, no puedo responder a esa pregunta.", True), ("Maaf, saya tidak dapat menjawab soalan ini.", True),
    ("Diese Frage kann ich leider nicht beantworten.", True), ("I looked at Form N1 and at the plan. Neither helps, and I therefore decline to answer.", True),
    ("The cited clause does not address the plan, but on the review it is plain: it must be done every week.", False),
    ("It must be done every week. Schedule 2 does not contain a further deadline.", False), ("The bank must not answer.", False),
])
def test_refusal(answer, no):
    assert pairs.declines(answer) is no


@pytest.mark.parametrize("answer, wrong", [
    ("Der Treuhänder muss die Sicherheiten bis zum 3. des Monats prüfen.", True), ("La sucursal puede separar el informe según el párrafo 9.", True),
    ("It must be done each week. The term used in the original is \"Das Institut muss den Bericht prüfen.\"", False), ("Marlorant Capital", False), ("", False),
])
def test_language(answer, wrong):
    assert pairs.wrong_language(Q, answer) is wrong


def test_defects_on_a_table(spark):
    whole = ["The bank must review the plan every 12 weeks.", "The plan must be kept by the bank within 3 weeks of the review.", "The review of the plan shall be done by the bank."] * 4
    rows = [(f"t{i}", Q, a, False) for i, a in enumerate(whole)]
    rows += [("cut", Q, "It must be done every week. The bank shall review the", False), ("comma", Q, "It must be done,", False), ("bracket", Q, "It must be done (clause 2.", False),
             ("nostop", Q, "The bank must review the plan every 12 weeks", False), ("short", Q, "Both", False), ("word", Q, "The bank must review the plan every 12 wee", False),
             ("right", Q, "I am unable to give advice on this.", True), ("wrong", Q, "I am unable to give advice on this.", False), ("nil", Q, None, True), ("noq", None, "Yes, every week.", None)]
    df = spark.createDataFrame([("arm", t, q, a, None, m, T0) for t, q, a, m in rows] + [("arm", None, Q, "", None, False, T0)], "arm string, task_id string, question string, answer string, gold_answer string, must_abstain boolean, made_at timestamp_ntz").selectExpr("*", "'x' AS defect", "1 AS word")
    got = {r["task_id"]: r["defect"] for r in pairs.defective_pairs(df).collect()}
    assert got == {"cut": "truncated", "comma": "truncated", "bracket": "truncated", "word": "truncated", "wrong": "refusal", "nil": "empty"}
    assert pairs.defective_pairs(df.limit(0)).count() == 0


# ---- scans --------------------------------------------------------------------------------------

LEX = scans.Lexicon({w: 500 for w in "the bank shall keep records of each review within three weeks and report to board cross-border full-scope market cross border full scope distribution trust".split()})


@pytest.mark.parametrize("text, want", [
    ("The bank shall keep re-\ncords of each review", (True, False, False)),
    ("The bank shall keep re¬\ncords of each review", (True, False, False)),
    ("The bank and the cross-\nborder market", (False, False, False)),
    ("The bank shall keep rec0rds of each revievv", (False, True, False)),
    ("The bank shall keep records\nof each review within\nthree weeks", (False, False, False)),
    ("The bank shall keep records of\n- 12 -\neach review within three weeks", (False, False, True)),
    ("The bank shall keep records\n\nClass A2\n81\nThe board", (False, False, False)),
    ("See Form K97, item 10(d) and 25.4 of the 2nd part", (False, False, False)),
])
def test_noise(text, want):
    assert scans.inspect(text, LEX)[:3] == want


def test_headers_and_repair():
    text = "The bank shall keep re-\ncords of each revi3w within\nHarbour Monetary Board  |  guidelines   p. 3\nthree weeks and report.\n\nThe b0ard shall keep the cross-\nborder market."
    names = ["Harbour Monetary Board", "Prepaid Guidelines 255", "guidelines"]
    assert scans.header_matches("Harbour M0netary Board  |  guidelines   p. 3", names) and not scans.header_matches("Part D - Arduous client statement", names)
    lex = scans.Lexicon(LEX.counts)
    assert scans.repair(text, names, lex) == ("The bank shall keep records of each review within three weeks and report.\n\nThe board shall keep the cross-border market.", 2)
    assert scans.repair("", names, lex) == ("", 0)
    assert scans.repair("x" * 5000, names, lex)[0] == "x" * 5000


def test_scan_noise_on_a_table(spark):
    clean = "The bank shall keep records of each review within three weeks"
    rows = [(f"s{i}", "d", T0, clean) for i in range(30)] + [("a", "d", T0, clean.replace("records", "re-\ncords")), ("b", "d", T0, "old"), ("b", "d", T0 + dt.timedelta(1), clean.replace("within", "\nHarbour Monetary Board - Prepaid Guidelines 255\nwithin")),
            ("c", "none", T0, clean.replace("within", "\n7\nwithin")), ("n", "d", T0, None), ("e", "d", T0, ""), (None, "d", T0, clean)]
    df = spark.createDataFrame(rows, "section_uid string, doc_id string, made_at timestamp_ntz, text string").selectExpr("*", "1 AS lines", "'q' AS issuer")
    man = spark.createDataFrame([("d", "Harbour Monetary Board", "Prepaid Guidelines 255", "guidelines", T0)], "doc_id string, issuer string, title string, doc_type string, fetched_at timestamp_ntz")
    assert sorted(map(tuple, scans.scan_noise(df, man).collect())) == [("a", "hyphenation"), ("b", "page_furniture"), ("c", "page_furniture")]
    assert scans.scan_noise(df.limit(0), man).count() == 0
    done = {r["section_uid"]: r["text"] for r in scans.repaired_sections(df, man).collect()}
    assert done["a"] == done["b"] == done["c"] == clean and done["n"] is None and done["e"] == ""


def test_a_misreading_that_recurs_is_none_of_the_words(spark):
    lex = scans.Lexicon(LEX.counts | {"wifhin": 9, "fhe": 3, "rep": 4, "scopc": 3, "scope": 500})
    assert scans.inspect("The bank shall keep records wifhin three weeks", lex)[1] and scans.repair("records wifhin three weeks", [], lex)[0] == "records within three weeks"
    assert scans.inspect("a full-scopc review", lex)[1] and scans.inspect("The wif-\nhin", lex)[:2] == (True, True)
    # In large tables a misreading is in many sections, too; a word as frequent as another is none.
    large = scans.Lexicon({"within": 500_000, "wifhin": 1_500, "board": 90_000, "boord": 30_000})
    assert scans.inspect("keep wifhin", large)[1] and not scans.inspect("the boord", large)[1]
    # A word that breaks off at the end of a text is not misread.
    short = scans.Lexicon({"and": 9000, "aud": 7, "audit": 800})
    assert not scans.inspect("the external aud", short)[1] and scans.inspect("the board aud the bank", short)[1]
    clean = "The bank shall keep records of each review within three weeks"
    rows = [(f"s{i}", "d", T0, clean) for i in range(200)] + [(f"m{i}", "d", T0, clean.replace("within", "wifhin")) for i in range(5)]
    df = spark.createDataFrame(rows, "section_uid string, doc_id string, made_at timestamp_ntz, text string")
    man = spark.createDataFrame([], "doc_id string, issuer string, title string, doc_type string, fetched_at timestamp_ntz")
    assert sorted(map(tuple, scans.scan_noise(df, man).collect())) == [(f"m{i}", "misread") for i in range(5)]


# ---- packing ------------------------------------------------------------------------------------


def test_tournament_is_first_fit_decreasing():
    random.seed(2)
    for _ in range(60):
        capacity = random.randint(5, 40)
        sizes = np.array([random.randint(0, capacity) for _ in range(random.randint(0, 50))], np.int64)
        got, free, want = packing.first_fit_decreasing(sizes, capacity), [], np.zeros(len(sizes), np.int64)
        for i in np.argsort(-sizes, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
            if k == len(free):
                free.append(capacity)
            free[k] -= sizes[i]
            want[i] = k
        assert list(got) == list(want)


def test_packing_on_a_table(spark):
    random.seed(6)
    rows = [(i, random.choice([0, 1, 5, 60, 99, 100, 101, 250, 1000])) for i in range(300)] + [(7, 5000), (None, 3), (900, None)]
    kinds = spark.createDataFrame([("small", 100), ("large", 700), ("bad", None), (None, 5), ("zero", 0)], "container_kind string, capacity_tokens int")
    df = spark.createDataFrame(rows, "doc_id long, tokens int").selectExpr("*", "1 AS container")
    got = packing.pack(df, kinds, group=40).toPandas()
    assert set(got["container_kind"]) == {"small", "large"}
    sizes = {}
    for d, t in rows:
        if d is not None and t is not None:
            sizes[d] = max(sizes.get(d, 0), t)
    for kind, capacity in (("small", 100), ("large", 700)):
        own = got[got["container_kind"] == kind]
        assert own.groupby("container")["tokens"].sum().max() <= capacity
        assert own.groupby("doc_id")["tokens"].sum().to_dict() == sizes
        whole = own.groupby("doc_id").size()
        assert all(n == max(1, -(-sizes[d] // capacity)) for d, n in whole.items())
    assert packing.pack(df.limit(0), kinds).count() == 0 and packing.pack(df, kinds.limit(0)).count() == 0
    filled = {r["container_kind"]: r["unused_share"] for r in packing.fill(packing.pack(df, kinds), kinds).collect()}
    assert all(0 <= x < 0.1 for x in filled.values())


def test_token_counts_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import os

    path = os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    texts = ["A duty's end.", "  spaces   and\n\nlines ", "Käufer müssen 12,5 % zahlen", "<|endoftext|>", "", "😀" * 40, "a" * 500]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", tokens.token_count("t").alias("n"))
    assert {r["t"]: r["n"] for r in df.collect()} == {t: len(other.encode(t, add_special_tokens=False).ids) for t in texts} | {None: None}


# ---- mixing -------------------------------------------------------------------------------------


def documents(spark, n=400):
    random.seed(5)
    words = {"alpha": "rate bond yield", "beta": "storm rain wind", "gamma": "goal team match", "other": "salt pepper"}
    rows = [(i, " ".join(random.choices(words[s].split(), k=random.randint(5, 60))) + f" {i}", random.choice([s, f" {s.upper()} "])) for i in range(n) for s in [random.choices(list(words), [8, 4, 1, 1])[0]]]
    rows += [(n, "storm rain wind rain storm", None), (n + 1, None, "alpha"), (n + 2, rows[0][1], rows[0][2]), (n + 3, "", "alpha"), (None, "x", "alpha")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS tokens", "'k' AS domain"), rows


def test_mixture(spark):
    df, rows = documents(spark)
    targets = spark.createDataFrame([("alpha", 0.5, 1), ("Beta", 0.3, 2), ("gamma", 0.1, 3), ("absent", 0.1, 4), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(df.drop("domain"), targets)
    got = mixture.toPandas()
    text = {d: t for d, t, _ in rows}
    caps = {"alpha": 1, "beta": 2, "gamma": 3}
    assert len(set(text[d] for d in got["doc_id"])) == len(got)
    assert all(u <= caps.get(s, 2) for s, u in zip(got["source"], got["uses"]))
    table = {r["source"]: r for r in report.collect()}
    assert table["absent"]["reached_tokens"] == 0 and table["other"]["reached_tokens"] == 0
    for s, share in (("alpha", 0.5), ("beta", 0.3), ("gamma", 0.1)):
        assert table[s]["reached_share"] == pytest.approx(share / 0.9, abs=0.02)
    _, wide = mixing.mix(df, targets, total_tokens=10**6)
    assert all(r["reached_tokens"] <= r["available_tokens"] * r["max_repeats"] for r in wide.collect() if r["max_repeats"])
    empty, _ = mixing.mix(df.limit(0), targets)
    assert empty.count() == 0
    assert mixing.mix(df, targets.limit(0))[0].count() == 0


def test_registered_mixture_is_not_sized_by_its_smallest_source(spark, tmp_path):
    df, _ = documents(spark)
    df.select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    targets = spark.createDataFrame([("alpha", 0.5, 1), ("beta", 0.2, 2), ("gamma", 0.25, 2), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    targets.write.parquet(str(tmp_path / "mix_targets.parquet"))
    table = {r["source"]: r for r in queries.p7_shares(spark, str(tmp_path)).collect()}
    listed = sum(table[s]["available_tokens"] for s in ("alpha", "beta", "gamma"))
    for s, share in (("alpha", 0.5), ("beta", 0.2)):
        assert table[s]["reached_tokens"] == pytest.approx(share * listed, rel=0.03)
    short = table["gamma"]
    assert short["reached_tokens"] == 2 * short["available_tokens"] < 0.25 * listed and short["reached_share"] < 0.25
    used = {r["doc_id"]: r["uses"] for r in queries.p7_mixture(spark, str(tmp_path)).collect()}
    assert max(used.values()) <= 2 and table["absent"]["reached_tokens"] == 0


def test_classifier_on_held_out_texts(spark):
    df, rows = documents(spark, 600)
    names = ["alpha", "beta", "gamma"]
    clean = [(t, names.index(s.strip().lower())) for _, t, s in rows if t and s and s.strip().lower() in names]
    model = mixing.DomainClassifier([t for t, _ in clean[:200]], [y for _, y in clean[:200]], 3)
    held = clean[200:]
    assert sum(model.posterior(t).argmax() == y for t, y in held) / len(held) > 0.95
    assert model.accuracy > 0.9


def test_posteriors_are_as_sure_as_they_are_right():
    """Texts that two domains write alike stay undecided, however long they are; a label moves them."""
    random.seed(3)
    shared = [f"w{i}" for i in range(200)]
    texts = [(" ".join(random.choices(shared + ([f"only{y}"] if random.random() < 0.2 else []), k=random.randint(10, 200))), y) for y in (0, 1) for _ in range(150)]
    random.shuffle(texts)
    model = mixing.DomainClassifier([t for t, _ in texts], [y for _, y in texts], 3)
    for n in (10, 100, 1000):
        p = model.posterior(" ".join(random.choices(shared, k=n)))
        assert p[:2].min() > 0.2 and p[2] == 0
        assert model.posterior(" ".join(random.choices(shared, k=n)), 1)[1] > 0.9
    assert list(mixing.in_grains(np.array([1 / 3, 1 / 3, 1 / 3])) * mixing.GRAIN) in ([22, 21, 21], [21, 22, 21], [21, 21, 22])


def test_rates_against_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    n, k = 80, 3
    member = np.array([mixing.in_grains(p) for p in rng.dirichlet([0.1] * k, n)])
    tokens, cap = rng.integers(5, 400, n), rng.integers(1, 4, n)
    goals = np.array([0.5, 0.35, 0.15]) * 0.8 * tokens.sum()
    df = spark.createDataFrame([(m.tolist(), int(t), int(c)) for m, t, c in zip(member, tokens, cap)], "member array<double>, tokens long, cap int")
    steps = mixing.fit_rates(df, goals.tolist(), steps=100, tolerance=1e-4)
    rates = np.array([r[0] for r in df.select(mixing.rate_of(steps)).collect()])
    assert rates.min() >= 0 and (rates <= cap + 1e-12).all()
    a = (member * tokens[:, None]).T
    dense = np.zeros(n)
    step = 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(50_000):
        dense = np.clip(dense - step * (a.T @ (a @ dense - goals)), 0, cap)
    assert np.abs(a @ rates - goals).max() <= np.abs(a @ dense - goals).max() + 0.01 * goals.sum()
    assert np.abs(a @ rates - goals).max() <= 0.01 * goals.sum()
    with pytest.raises(RuntimeError):
        mixing.fit_rates(df, goals.tolist(), steps=1, tolerance=1e-9)


# ---- abuse --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, unsafe", [
    ("You are a worthless idiot.", True), ("You worthless іdіоt.", True), ("f_u_c_k this plan", True), ("Only a $hi7ty clerk would say so", True), ("Suck my d**k", True),
    ("Shut your mouth, you morrrrron.", True), ("You imbceile.", True), ("Those people are vermin and should be driven out of the town.", True), ("Que os jodan, ratas.", True), ("Allez vous faire foutre, porcs.", True),
    ("Halt die Fresse, du Wichser.", True), ("Pergi mampus, babi.", True), ("SHE PULLED DOWN MY TROUSERS AND RODE ME RIGHT THERE", True), ("i​d​i​o​t that you are", True),
    ("The kill switch for the plan is tested.", False), ("The clause lets a bank strip the coupon from the bond and execute it.", False), ("Le fiduciaire doit publier le registre sans retard.", False),
    ("I am furious about the fee and will go to the ombudsman.", False), ("Victims of financial abuse may ask for an account.", False), ("The rate of growth is 12%.", False), ("", False), (None, False), ("5*4 = 20 and A*B", False),
])
def test_passages(text, unsafe):
    assert (abuse.score(text)[0] >= abuse.THRESHOLD) is unsafe


@pytest.mark.parametrize("text, unsafe", [
    ("I will slit your throat tonight.", True), ("Gas the Jews.", True), ("I will kill you and your family.", True), ("All immigrants are parasites who deserve to burn.", True), ("I will rape your daughter.", True),
    ("He thrust into her until she screamed, her naked body on the desk.", True), ("Je vais vous tuer.", True), ("Te voy a matar.", True),
    ("The word slut was used and reported as sexual harassment under the policy.", False), ("Staff were shown slurs such as faggot in the training on hate speech.", False),
    ("They slaughter cattle and pigs on the farm.", False), ("Sows, bitches and mares are insured per litter.", False), ("Le paiement est en retard de 3 jours.", False),
    ("Screening for breasts and prostate cancer is covered.", False), ("I will shoot you an email.", False), ("The trader must cut losses and break the position.", False), ("Immigrants may open an account.", False),
])
def test_passages_of_no_template(text, unsafe):
    assert (abuse.score(text)[0] >= abuse.THRESHOLD) is unsafe


def test_a_passage_without_full_stops_is_not_diluted():
    words = "the bank shall keep records " * 40
    for hit in ("go to hell", "you worthless idiot", "i will slit your throat"):
        assert abuse.score(words + hit + " " + words)[0] >= abuse.THRESHOLD
    # A word and its company are judged together wherever the stretch of a long sentence begins.
    assert abuse.score("idiot " + "word " * 30 + "you moron " + words)[0] >= abuse.THRESHOLD
    score, passages, density = abuse.score("Go to hell. " + "The bank shall keep records. " * 200)
    assert (score, passages) == (1.0, 1) and density == pytest.approx(1000 / 1003, abs=1e-3)


def test_one_bad_sentence_in_a_long_text_counts():
    assert abuse.score("The bank shall keep records. " * 3000 + "Go to hell, all of you. " + "The bank shall keep records. " * 3000)[0] >= 1


def test_scores_on_a_table(spark):
    rows = [(1, "You idiot.", " Faq "), (2, "Fine.", "faq"), (3, None, None), (None, "You idiot.", "faq"), (4, "", "x"), (1, "You idiot.", " Faq ")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS score", "2 AS s")
    assert [r["doc_id"] for r in abuse.unsafe_documents(df).collect()] == [1]
    rates = {r["source"]: (r["documents"], r["unsafe"]) for r in abuse.source_rates(df).collect()}
    assert rates == {"faq": (4, 3), "x": (1, 0), None: (1, 0)}
    assert abuse.unsafe_documents(df.limit(0)).count() == 0


# ---- the lattice and the paragraphs of scanned pages ---------------------------------------------


@pytest.mark.parametrize("seen", [1, 2, 20, 2000])
def test_a_misreading_is_found_however_often_it_recurs(seen):
    lex = scans.Lexicon({"within": 200_000, "wifhin": seen, "weeks": 100_000, "three": 90_000}, 1_000_000)
    assert scans.inspect("three weeks wifhin three weeks", lex)[:3] == (False, True, False)
    assert not scans.inspect("three weeks within three weeks", lex)[1]


@pytest.mark.parametrize("scale", [1, 1000])
def test_decisions_do_not_depend_on_the_size_of_the_corpus(scale):
    lex = scans.Lexicon({w: n * scale for w, n in {"within": 4000, "wifhin": 30, "board": 4000, "boord": 900, "cross": 40, "border": 50}.items()}, 98_000 * scale)
    assert scans.inspect("wifhin", lex)[1] and not scans.inspect("boord", lex)[1]
    assert scans.inspect("cross-\nborder", lex)[0] is False


def test_the_lattice_splits_joins_and_reads():
    lex = scans.Lexicon({w: 5000 for w in "the institution of records shall keep insurance clear inner".split()}, 10_000)
    read = lambda t: scans.repair(t, [], lex)[0]
    assert read("the insti tution shall keep records") == "the institution shall keep records"
    assert read("the insti\ntution shall keep records") == "the institution shall keep records"
    assert read("the insti-\ntution shall keep rec0rds") == "the institution shall keep records"
    assert read("the institution shallkeep records") == "the institution shall keep records"
    assert read("THE INSTI-\nTUTION SHALL KEEP REC0RDS") == "THE INSTITUTION SHALL KEEP RECORDS"
    assert read("the Elmargate shall keep records") == "the Elmargate shall keep records"
    assert scans.inspect("THE INSTI-\nTUTION SHALL", lex)[0]
    # A long run is read like any other.
    long = "x" * 60
    assert scans.Lexicon({long: 900}, 1000).reading(long[:-1] + "z") == (long, 1)


def test_lines_that_only_may_be_headers_are_text_if_no_name_matches(spark):
    clean = "The bank shall keep records of each review within three weeks"
    rows = [(f"s{i}", "d", T0, clean) for i in range(60)] + [("body", "d", T0, "the bank shall keep\nThe Bank Rec0rds\nof each review"), ("head", "d", T0, "the bank shall keep\nHarb0ur Monetary Boarcl\nof each review")]
    df = spark.createDataFrame(rows, "section_uid string, doc_id string, made_at timestamp_ntz, text string")
    man = spark.createDataFrame([("d", "Harbour Monetary Board", "Prepaid Guidelines 255", "guidelines", T0)], "doc_id string, issuer string, title string, doc_type string, fetched_at timestamp_ntz")
    assert sorted(map(tuple, scans.scan_noise(df, man).collect())) == [("body", "misread"), ("head", "page_furniture")]


def paragraph_cost(lines, choice):
    """Cost of the line ends decided so far: ``choice`` has, for each line, the width of the paragraph it opens or None."""
    filled = sorted(map(len, lines))
    widths = sorted({filled[-1], filled[len(filled) // 2]}, reverse=True)
    state, total = None, 0.0
    for k, c in enumerate(choice):
        cut, join = scans._end_costs(lines[k - 1], lines[k], state) if k else (0.0, 0.0)
        if c is None:
            total, state = total + join + (scans.OVERFULL if len(lines[k]) > state[2] else 0.0), (state[0], True, state[2])
        else:
            after = dict(scans._opened(lines[k], "item" if scans._LABEL.match(lines[k]) else "text", widths))
            state = next(s for s in after if s[2] == c)
            total += cut + after[state]
    return total


def test_paragraphs_are_a_programme_and_no_greedy_choice():
    import itertools

    random.seed(8)
    words = "the bank shall keep Records of each (a) review; within three weeks. and Report".split()
    differ = 0
    for _ in range(150):
        lines = [" ".join(random.choices(words, k=random.randint(1, 6))) for _ in range(random.randint(2, 6))]
        filled = sorted(map(len, lines))
        widths = sorted({filled[-1], filled[len(filled) // 2]}, reverse=True)
        every = [c for c in itertools.product([None, *widths], repeat=len(lines)) if c[0] is not None]
        best = min(paragraph_cost(lines, c) for c in every)
        firsts = [i for g in scans.paragraphs(lines) for i in [True] + [False] * (len(g) - 1)]
        assert min(paragraph_cost(lines, c) for c in every if [x is not None for x in c] == firsts) == pytest.approx(best)
        greedy = ()
        for k in range(len(lines)):
            greedy = min(((*greedy, c) for c in [None, *widths] if k or c is not None), key=lambda g: paragraph_cost(lines, g))
        differ += paragraph_cost(lines, greedy) > best + 1e-9
    assert differ > 0


def test_repair_undoes_planted_noise():
    """Clean clauses, wrapped, divided, misread and interrupted by pages: what repair restores of them."""
    import collections
    import textwrap

    random.seed(12)
    syllables = "ba con ment re tion ser port ed ing fin an ce ta ble sub ject cap it al or der re port mar gin".split()
    vocabulary = sorted({"".join(random.choices(syllables, k=random.randint(2, 4))) for _ in range(400)})
    sentence = lambda: (" ".join(random.choices(vocabulary, k=random.randint(6, 14))) + ".").capitalize()
    clean = [["  ".join([sentence() for _ in range(random.randint(2, 4))]).replace("  ", " ") for _ in range(random.randint(1, 3))] for _ in range(400)]
    counts = collections.Counter(w for c in clean for w in {x.strip(".").lower() for p in c for x in p.split()})
    undo = [pair.split("=") for pair in "rn=m cl=d f=t c=e ii=u 0=o 1=l 5=s".split()]
    noisy, planted = [], 0
    for c in clean[:120]:
        parts = []
        for p in c:
            words = p.split()
            for i, w in enumerate(words):
                if len(w) > 5 and w.islower() and random.random() < 0.05:
                    seen, true = random.choice(undo)
                    if true in w:
                        words[i], planted = w.replace(true, seen, 1), planted + 1
            lines = textwrap.wrap(" ".join(words), 60)
            for k in range(len(lines) - 1):
                head, _, rest = lines[k + 1].partition(" ")
                if len(head) > 6 and head.isalpha() and head.islower() and random.random() < 0.5:
                    lines[k], lines[k + 1] = f"{lines[k]} {head[:3]}-", f"{head[3:]} {rest}"
                    planted += 1
            if len(lines) > 3:
                lines.insert(2, random.choice(["- 12 -", "Page 3 of 9", "Harbour Monetary Board  |  guidelines   p. 3"]))
                planted += 1
            parts.append("\n".join(lines))
        noisy.append("\n\n".join(parts))
    lexicon = scans.Lexicon(dict(counts), 400)
    names = ["Harbour Monetary Board", "Prepaid Guidelines 255", "guidelines"]
    right = wrong = whole = 0
    for c, text in zip(clean, noisy):
        got, n = scans.repair(text, names, lexicon)
        want = "\n\n".join(c)
        whole += n == len(c)
        a, b = collections.Counter(want.split()), collections.Counter(got.split())
        right, wrong = right + sum((a & b).values()), wrong + sum(((a - b) | (b - a)).values())
    assert planted > 300 and right / (right + wrong) > 0.99 and whole / len(noisy) > 0.9, (planted, right, wrong, whole)
