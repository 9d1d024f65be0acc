import random

from textmill.llm import ideas

SHAPE = "prompt_id STRING, sample_index INT, text STRING, cluster_id STRING, Text STRING"
FORMS = ["We propose that {a} slows {p} in the larvae by engaging {c}, and that this raises {o}. Loss of {c} should cancel every effect of {a} on {o}.", "If {a} reaches the {c} branch early, {p} is delayed and {o} shifts in the larvae. Because {c} saturates, {a} shows a threshold on {p}.", "What drives {o} in the larvae is not {p} as such but its coupling to {c}, and {a} sets that coupling. The decisive test follows {o} for weeks."]
IDEAS = [("Tavomide", "ABCD12", "wound closure", "grip strength"), ("Rekolidix", "EFGH34", "mucus clearance", "resting pain"), ("Solagatine", "IJKL56", "iron uptake", "insulin response")]


def rows_of(prompts):
    rng, out, true = random.Random(6), [], {}
    for p in range(prompts):
        for i in range(8):
            k = rng.randrange(3)
            a, c, pr, o = IDEAS[k]
            out.append((f"p{p}", i, rng.choice(FORMS).format(a=f"{a}{'abcdefghij'[p % 10]}{'klmnopqrst'[p // 10]}", c=f"{c[:3]}{chr(65 + p % 26)}{10 + p}", p=pr, o=o), "x", ""))
            true[f"p{p}", i] = k
    return out, true


def test_ideas_are_told_apart_whatever_their_words(spark):
    rows, true = rows_of(40)
    got = {(r["prompt_id"], r["sample_index"]): r["cluster"] for r in ideas.clustered(spark.createDataFrame(rows + rows[:9], SHAPE)).collect()}
    assert set(got) == set(true)
    pairs = [(a, b) for a in true for b in true if a[0] == b[0] and a[1] < b[1]]
    same, found = {x for x in pairs if true[x[0]] == true[x[1]]}, {x for x in pairs if got[x[0]] == got[x[1]]}
    assert len(same & found) >= 0.9 * len(same) and len(same & found) >= 0.95 * len(found)


def test_links_are_exact_and_lose_nothing_alike(spark):
    sets = [("p", 1, [1, 2, 3, 4], [], []), ("p", 2, [1, 2, 3, 5], [], []), ("p", 3, [9, 10], [], []), ("q", 1, [1, 2, 3, 4], [], []), ("p", 4, [1, 2, 3, 4, 6], ["abcd12"], []), ("p", 5, [1, 2, 3, 4, 7], ["efgh34"], [])]
    df = spark.createDataFrame(sets, "prompt_id STRING, rep INT, f ARRAY<BIGINT>, codes ARRAY<STRING>, names ARRAY<STRING>")
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in ideas.links(df).collect()}
    assert got == {(1, 2): 0.6}  # samples that name nothing meet each other only


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([("p", i, i + 1) for i in range(40)] + [("p", 50, 51), ("q", 0, 1)], "prompt_id STRING, a INT, b INT")
    got = {(r["prompt_id"], r["node"]): r["root"] for r in ideas.components(edges).collect()}
    assert all(got["p", i] == 0 for i in range(41)) and got["p", 51] == 50 and got["q", 1] == 0 and len(got) == 45


def test_loose_components_are_split_around_medoids(spark):
    e = [("p", 0, i, 0.9) for i in (1, 2, 3, 4)] + [("p", 4, 10, 0.4)] + [("p", 10, i, 0.9) for i in (11, 12, 13, 14)]
    edges = spark.createDataFrame(e, "prompt_id STRING, a INT, b INT, similarity DOUBLE")
    got = {r["node"]: r["root"] for r in ideas.split(edges, ideas.components(edges)).collect()}
    assert all(got[i] == got[0] for i in (1, 2, 3)) and all(got[i] == got[10] for i in (11, 12, 13, 14)) and got[0] != got[10] and len(got) == 10


def test_nulls_blanks_and_an_empty_table(spark):
    rows = [("p", 0, None, None, ""), ("p", 1, " ", "a", ""), ("p", 2, "N/A", "a", ""), (None, 3, "x", "a", ""), ("p", None, "x", "a", "")]
    df = spark.createDataFrame(rows, SHAPE)
    assert sorted((r["sample_index"], r["cluster"]) for r in ideas.clustered(df).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert ideas.clustered(df.where("false")).count() == 0
