import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textmill.llm import packing, tokens

PARTS = ["the ", "mitochondria", "\r\n", " \t", "'s", "1234", "é", "中文", "Ж", "😀", "  ", "!?", "a" * 40]


@pytest.fixture(scope="module")
def other():
    import public_tokenizers

    v = tokens.vocabulary()
    return tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_another_library(text):
    import public_tokenizers

    v = tokens.vocabulary()
    text = text.encode("utf-8", "replace").decode()
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert v.ids(text) == other.encode_ordinary(text)
    assert b"".join(v.bytes_of[i] for i in v.ids(text)).decode() == text


def test_long_runs(other):
    v = tokens.vocabulary()
    for text in ("a" * 5000, " " * 3000, "Ж" * 2000, "<|endoftext|>" * 3):
        assert v.ids(text) == other.encode_ordinary(text)


def test_edits_and_appends_give_the_ids_of_the_whole(other):
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(40))
        e = tokens.Encoded(tokens.vocabulary(), text)
        for _ in range(5):
            i = rng.randrange(len(text) + 1)
            j, new = min(len(text), i + rng.randrange(8)), "".join(rng.choice(PARTS) for _ in range(rng.randrange(3)))
            text = text[:i] + new + text[j:]
            assert e.replace(i, j, new).ids == other.encode_ordinary(text)
        assert e.append(" more").ids == other.encode_ordinary(text + " more")


def test_null_empty_repeated_and_clashing(spark):
    df = spark.createDataFrame([(1, None, "x", 0), (2, "", "x", 0), (3, "a b", "x", 0), (3, "a b", "x", 0)], "doc_id BIGINT, text STRING, TEXT STRING, ids INT")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.with_ids(df).collect())
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] and len(got[2][1]) == 2
    assert tokens.with_ids(df.where("false")).count() == 0


def plain_best_fit(sizes, room):
    bins, out = [], 0
    for s in sorted(sizes, reverse=True):
        fit = min((b for b in bins if b >= s), default=None)
        if fit is None:
            bins.append(room - s)
            out += 1
        else:
            bins[bins.index(fit)] = fit - s
    return out


def test_runs_are_those_of_item_by_item():
    rng = random.Random(8)
    for _ in range(200):
        room = rng.choice([10, 37, 100])
        sizes = [rng.randint(1, room) for _ in range(rng.randrange(60))]
        plan = packing.best_fit({s: sizes.count(s) for s in set(sizes)}, room)
        fill = {}
        for size, _, n, first, each in plan:
            for k in range(n):
                fill[first + k // each] = fill.get(first + k // each, 0) + size
        assert sum(fill.values()) == sum(sizes) and max(fill.values(), default=0) <= room
        assert len(fill) == plain_best_fit(sizes, room)
        ranks = {}
        for size, start, n, _, _ in plan:
            assert ranks.get(size, 0) == start
            ranks[size] = start + n
        assert ranks == {s: sizes.count(s) for s in set(sizes)}


def test_packed_places_every_piece_once(spark):
    sizes = [(i, n) for i, n in enumerate([5000, 2048, 2047, 1, 0, 700, 700, 700, 2049])] + [(9, None), (5, 700)]
    rows = packing.packed(spark.createDataFrame(sizes, "doc_id BIGINT, n_tokens BIGINT")).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(n or 0 for _, n in sizes)
    by = {}
    for r in rows:
        by[r["container"]] = by.get(r["container"], 0) + r["n_tokens"]
    assert max(by.values()) <= 2048
    split = {r["doc_id"] for r in rows if r["piece"] > 0}
    assert split == {0, 8} and not {4, 9} & {r["doc_id"] for r in rows}
    assert packing.packed(spark.createDataFrame([], "doc_id BIGINT, n_tokens BIGINT")).count() == 0
