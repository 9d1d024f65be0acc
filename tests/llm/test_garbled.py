import random

import pytest

from textmill.llm import garbled as G

CLEAN = ["Die Wundheilung lässt sich über die Rückfallquote ändern, wobei größere Fälle geprüft werden.", "La pérdida de músculo depende de la vía, y así cambia la germinación después.", "L’hypothèse est la suivante : la mémoire dépend de l’étape déclenchée, à 5 µM près.", "Мы полагаем, что заживление ран меняет уплотнение почвы у всходов кукурузы.", "It doesn’t fall by 23 % (± 2.5) – at 5 °C, naïve cells stay.", "我们提出，该通路改变斑马鱼幼体的伤口愈合，从而影响等待时间。"]
SHAPE = "doc_id BIGINT, text STRING, Text STRING, chain INT"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], SHAPE)


def test_chains_are_exact_round_trips():
    for text in CLEAN:
        for chain in G.CHAINS:
            g = G.garble(text, chain)
            if g is not None and g != text and "�" not in g and chain.startswith("utf-8>") and "gb18030" not in chain and "shift" not in chain:
                assert G.undo(g, chain) == text, chain


def test_held_out_chains_are_found_and_restored(spark):
    rng, clean = random.Random(2), [f"{t} {i}" for i in range(40) for t in CLEAN]
    chains = ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp437", "utf-8>mac_roman", "utf-8>cp1252>utf-8>cp1252"]
    held = [(f"{rng.choice(CLEAN[:3])} no. {i}", rng.choice(chains)) for i in range(60)]
    texts = clean + [G.garble(t, c) for t, c in held] + [None, "", "plain", "na�ve cells stay"]
    rows = {r["doc_id"]: r for r in G.garbled(frame(spark, texts)).collect()}
    n = len(clean)
    assert not [i for i in rows if i < n] and n + 63 in rows and rows[n + 63]["text"] is None
    assert sum(n + k in rows for k in range(60)) >= 58
    assert sum(n + k in rows and rows[n + k]["text"] == held[k][0] for k in range(60)) >= 54
    assert not {n + 60, n + 61, n + 62} & set(rows)


@pytest.mark.parametrize("text", ["Café Île-Morne, São Paulo: 5 µM ≤ 7 °C &eacute; \\u00e9 – “so” ±2 × 10⁻³", "Größe: Ä, Ö, Ü; œuvre, ŒUVRE, Ñandú, ¿qué? ¡sí!"])
def test_rare_but_right_characters_are_no_case(text):
    assert not G.is_garbled(text)


def test_empty_table_and_no_clean_text(spark):
    assert G.garbled(frame(spark, ["x"]).where("false")).count() == 0
    assert G.garbled(frame(spark, ["Ã¼ber"])).count() in (0, 1)
