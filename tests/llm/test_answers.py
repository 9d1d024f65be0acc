import itertools

from textmill.llm import answers, texts, truncation

RECORDS = "request_id STRING, prompt_id STRING, text STRING, model STRING, config_hash STRING, finish_reason STRING, completion_tokens BIGINT, TEXT INT"
SPECS = "config_hash STRING, max_new_tokens INT"
PROMPTS = "id STRING, text STRING"
PROMPT = "Answer the question with one new idea.\n\nQuestion:\nHow could wound closure be changed in zebrafish larvae?\n\nNotes:\nOlder data on wound closure were collected without controls."
IDEA = "We propose that Tavomide slows wound closure by engaging ABCD12 signalling in the larvae. A first experiment applies Tavomide to the larvae and blocks ABCD12 halfway."


def found(spark, rows):
    records = spark.createDataFrame([(f"r{i}", "p", t, "m", "c", f, n, 0) for i, (t, f, n) in enumerate(rows)], RECORDS)
    specs, prompts = spark.createDataFrame([("c", 40)], SPECS), spark.createDataFrame([("p", PROMPT), ("p", PROMPT)], PROMPTS)
    return records, specs, prompts


def test_endings():
    for text, form in ((IDEA, texts.ENDED), (IDEA[:-9], texts.OPEN), (IDEA + " [...]", texts.MARKED), ("It holds.\n\nKey terms: grip, pain", texts.LOOSE), ("It falls (± 2.", texts.OPEN), (None, texts.EMPTY), ("​", texts.EMPTY), ("N/A", texts.EMPTY), ("So it is. [26]", texts.ENDED), ("A\n\n— end of proposal —", texts.ENDED), ("```\nx = 1", texts.OPEN)):
        assert texts.ending(text) == form, text


def test_fragments_of_known_words_are_cuts(spark):
    whole = [("All is done.\n\nKey terms: signalling, closure", None, None)] + [("The signalling of closure ends here.", None, None)] * 3
    rows = whole + [("All is done.\n\nKey terms: closure, signal", "stop", 9), ("All is done.\n\nKey terms: closure, signalli", "stop", 9), (IDEA, "length", 40), (IDEA[:-20], "stop", 7), (None, "length", 40), ("", None, None)]
    e = {r["request_id"]: r["cut"] for r in truncation.evidence(*found(spark, rows)).collect()}
    assert [e[f"r{i}"] for i in range(len(rows))] == [False] * 4 + [True, True, False, True, False, False]


def test_each_sign_can_decide():
    """Beside the forms of ending, each sign turns some sum of others; a sign that can't is a stage without effect. Whole endings outweigh all signs."""
    forms, w = (texts.MARKED, texts.OPEN, texts.LOOSE), truncation.WEIGHTS
    signs = [k for k in w if k not in ("start", *forms, texts.ENDED)]
    states = [{"start", f, *o} for f in forms for n in range(len(signs) + 1) for o in itertools.combinations(signs, n)]
    assert signs and all(any(k in s and sum(w[x] for x in s) > 0 >= sum(w[x] for x in s - {k}) for s in states) for k in signs)


def test_length_and_reason_decide_nothing_and_fragments_do(spark):
    label = "All is done here, as the closure ends. " * 4 + "\n\nKey terms: closure, "
    rows = [(f"{IDEA} The signalling of closure ends.", "stop", 15)] * 3 + [(label + word, reason, n) for word in ("closure", "signalli", "quorv") for reason, n in (("stop", 9), ("length", 40), (None, None))]
    records, specs, prompts = found(spark, rows)
    e = {r["request_id"]: (r["cut"], r["score"]) for r in truncation.evidence(records, specs, prompts).collect()}
    assert [e[f"r{i}"] for i in range(3, 12)] == [(False, -3.5)] * 3 + [(True, 0.5)] * 3 + [(False, -3.5)] * 3


def test_trie_counts(spark):
    words = spark.createDataFrame([("ab", 2), ("abc", 3)], "word STRING, n BIGINT")
    assert {r["node"]: (r["n"], r["longer"]) for r in truncation.trie(words).collect()} == {"a": (0, 5), "ab": (2, 3), "abc": (3, 0)}


def test_each_defect_and_none(spark):
    french = "Chez les larves, la fermeture dépend de la voie ABCD12, et c’est Tavomide qui déclenche le processus. Le coût est modéré pour nous."
    rows = [(None, None, None), ("[no output]", "stop", 3), (IDEA[:-9], "stop", 30), ("I'm sorry, but I cannot help with this request. Please ask a specialist.", "stop", 9), ("How could wound closure be changed in zebrafish larvae?", "stop", 9), (french, "stop", 30)]
    rows = [(t, f, n) for (t, f, n) in rows for _ in range(3)] + [(IDEA.replace("Tavomide", f"Tavo{i}mide"), "stop", 30) for i in range(30)]
    rows += [("I am unable to rank rival ideas, so only one is given. " + IDEA, "stop", 40)] * 3
    got = {r["request_id"]: [d["defect"] for d in r["defects"]] for r in answers.judged(*found(spark, rows)).collect()}
    want = [d for d in ("empty", "empty", "truncated", "refusal", "copy", "other_language") for _ in range(3)]
    assert [got[f"r{i}"][:1] for i in range(18)] == [[d] for d in want]
    assert all(not got[f"r{i}"] for i in range(18, len(rows)))


def test_no_prompt_no_rows_and_long_texts(spark):
    records, specs, prompts = found(spark, [(IDEA * 300, "stop", 30), (None, None, None)])
    assert answers.judged(records, specs, prompts.where("false")).count() == 2
    assert answers.judged(records.where("false"), specs, prompts).count() == 0


def test_label_model_weighs_functions_by_how_well_they_agree():
    patterns = {"yyy": 80, "nnn": 800, "yyn": 10, "nny": 30, "ynn": 20}
    post = answers.fitted(patterns)
    assert post["yyy"] > 0.99 and post["yyn"] > 0.5 and max(post["nnn"], post["nny"], post["ynn"]) < 0.5
    assert answers.fitted({"nn": 5})["nn"] < 0.5 and answers.fitted({}) == {}
    assert all(0 <= x <= 1 for x in answers.fitted({"".join(p): 3 for p in itertools.product("yn-", repeat=3)}).values())
