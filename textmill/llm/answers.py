"""Answers that are no proper answer to their prompt (problem 6): noisy labelling functions joined by a label model."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.lineage import only, settle, table
from textmill.llm import texts
from textmill.llm.truncation import evidence

REFUSAL = re.compile(
    r"\b(?:can(?:no|['’ ])?t|can ?not|won['’]?t|will not|unable|not able|must (?:decline|pass|refuse)|have to (?:decline|pass|refuse)|decline|refuse|outside what i may|not something i can|not be right for me|not allowed|not permit|not comfortable|sorry|apologi[sz]e|with regret|regretfully|against my|prefer not|rather not|no (?:idea|answer|proposal|hypothesis) (?:will|can|shall) be)\b"
    r"|\b(?:leider|ablehnen|ablehne|verweiger\w*|darf ich|kann ich|möchte ich (?:nicht|keine?)|tut mir leid|entschuldig\w*|bedaure|keine idee|nicht helfen|nicht möglich)\b"
    r"|\b(?:désolée?|regrette|refuser|refuse|décline|décliner|impossible|ne peux|ne puis|ne suis pas|pas en mesure|pas autorisée?|m['’]abstenir|excusez)\b"
    r"|\b(?:lo siento|lamento|lamentablemente|no puedo|no me es posible|imposible|debo (?:rechazar|declinar)|rechazar|declinar|disculpa\w*|no estoy|no debo|perdón)\b"
    r"|抱歉|对不起|无法|不能|拒绝|很遗憾|извин\w*|не могу|вынужден|отказ\w*|к сожалению",
    re.I,
)
NAME = re.compile(r"\b[A-Z]{2,}-?\d{2,}\b")
FUNCTIONS = {
    "empty": ("no_text", "placeholder", "no_letters"),
    "truncated": ("cut", "no_end"),
    "refusal": ("declines", "short", "no_names", "mostly"),
    "copy": ("shared", "own_part", "no_names", "sentences"),
    "other_language": ("whole", "by_sentence", "script"),
}
#: What a function is taken to be worth before any data: the chance of its vote being right on each side, as counts.
PRIOR_RIGHT, PRIOR_WRONG = 80.0, 4.0
#: Posterior from which a defect holds, validated by defects made from proper answers (tests/llm/test_answers.py).
CUTOFFS = {"empty": 0.5, "truncated": 0.5, "refusal": 0.5, "copy": 0.5, "other_language": 0.5}
#: Of several defects the one that leaves least of an answer comes out.
ORDER = ("empty", "truncated", "refusal", "copy", "other_language")
ROUNDS = 50


def votes(prompt: str | None, text: str | None, cut: bool) -> str:
    """A letter for each function, by defect in the order of FUNCTIONS: y (defect), n (none) or - (no opinion)."""
    yes = lambda x: "-" if x is None else "y" if x else "n"
    prompt, body = prompt or "", texts.INVISIBLE.sub("", text or "")
    empty = not texts.has_content(text)
    out = [not body.strip(), empty, not texts.LETTER.search(body)]
    out[0] = True if out[0] else None if empty else False
    out[2] = True if out[2] else None if empty else False
    if empty:
        return "".join(map(yes, out)) + "n" * 13
    form = texts.ending(text)
    out += [cut, True if form in (texts.MARKED, texts.OPEN) else None if form == texts.LOOSE else False]
    said = texts.sentences(body)
    shared = texts.share_of(body, prompt) if prompt else 0.0
    named = set(NAME.findall(body)) - set(NAME.findall(prompt))
    declines = bool(REFUSAL.search(body))
    own = [s for s in said if texts.share_of(s, prompt) < 0.6] if declines or shared > 0.3 else said
    size = sum(map(len, own))
    head = " ".join(own[:2])
    declines = declines and bool(REFUSAL.search(head))
    out += [declines, len(own) <= 4 and size < 400, not named, sum(bool(REFUSAL.search(x)) for x in own) * 2 >= max(1, len(own)) if declines else False]
    out += [shared >= 0.6, size <= 0.4 * len(body) if shared > 0.3 else False, None if not named and shared < 0.3 else not named, len(own) * 2 < len(said) or (len(own) < 2 and shared >= 0.6)]
    asked, spoken = texts.asked_language(prompt) if prompt else None, texts.language(body)
    whole = None if not asked or not spoken else asked != spoken
    by = [x for x in map(texts.language, said) if x]
    other = None if not asked or not by else sum(x != asked for x in by) * 2 > len(by)
    wide = spoken in ("zh", "ru") or asked in ("zh", "ru")
    out += [whole, other, None if not wide or whole is None else whole]
    return "".join(map(yes, out))


def fitted(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """The posterior of the defect for each pattern of votes, by expectation maximisation over how often each pattern occurs.

    Functions are taken as independent given the truth; each has its own rates of voting y, n and - on both sides. It begins with the majority's view
    and prior counts, so that a side without cases keeps its meaning."""
    k = len(next(iter(patterns), ""))
    post = {p: 0.0 if not (y := p.count("y")) else y / (y + p.count("n")) for p in patterns}
    post = {p: 1.0 if x > 0.5 else 0.0 for p, x in post.items()}
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (sum(n * post[p] for p, n in patterns.items()) + 0.5) / (total + 10)
        rates = []
        for i in range(k):
            seen = {True: {"y": PRIOR_RIGHT, "n": PRIOR_WRONG, "-": PRIOR_WRONG}, False: {"y": PRIOR_WRONG, "n": PRIOR_RIGHT, "-": PRIOR_WRONG}}
            for p, n in patterns.items():
                seen[True][p[i]] += n * post[p]
                seen[False][p[i]] += n * (1 - post[p])
            rates.append({v: math.log(seen[True][v] / sum(seen[True].values())) - math.log(seen[False][v] / sum(seen[False].values())) for v in "yn-"})
        new = {p: 1 / (1 + math.exp(-max(-500, min(500, math.log(prior / (1 - prior)) + sum(rates[i][v] for i, v in enumerate(p)))))) for p in patterns}
        moved = max((abs(new[p] - post[p]) for p in patterns), default=0)
        post = new
        if moved < 1e-6:
            break
    return post


def judged(records: DataFrame, specs: DataFrame, prompts: DataFrame) -> DataFrame:
    """request_id, defects (array of struct<defect, posterior>, those over their cutoff): each record once.

    A record whose prompt is missing or null is judged by its own text alone. Repeated rows of a request_id are judged once; of different texts under
    one request_id the greatest in order counts, one that is null only if all are. The driver gets one number for each pattern of votes that occurs, 3 to the power of a defect's functions at most."""
    rows = only(records, "request_id", "prompt_id", "text").groupBy("request_id").agg(F.max(F.struct("text", "prompt_id")).alias("x")).select("request_id", "x.prompt_id", "x.text")
    asked = only(prompts, "id", "text").groupBy(F.col("id").alias("prompt_id")).agg(F.max("text").alias("prompt"))
    cuts = evidence(records, specs, prompts).where("cut").select("request_id", F.lit(True).alias("cut"))
    voted = F.pandas_udf(lambda p, t, c: pd.Series([votes(*x) for x in zip(p, t, c, strict=True)], dtype=object), "string")
    full = rows.join(cuts, "request_id", "left").join(asked, "prompt_id", "left")
    said = settle(full.select("request_id", voted("prompt", "text", F.coalesce("cut", F.lit(False))).alias("votes")))
    at, posteriors = 0, []
    for defect in ORDER:
        k = len(FUNCTIONS[defect])
        posteriors.append((defect, F.substring("votes", at + 1, k)))
        at += k
    counted = said.select(F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), p.alias("pattern")) for d, p in posteriors))).alias("x")).groupBy("x.defect", "x.pattern").count().collect()
    known = []
    for defect, column in posteriors:
        post = {p: x for p, x in fitted({r["pattern"]: r["count"] for r in counted if r["defect"] == defect}).items() if x >= CUTOFFS[defect]}
        of = F.create_map(*(F.lit(x) for item in sorted(post.items()) for x in item)) if post else F.create_map().cast("map<string,double>")
        known.append(F.struct(F.lit(defect).alias("defect"), F.element_at(of, column).alias("posterior")))
    return said.select("request_id", F.filter(F.array(*known), lambda x: x["posterior"].isNotNull()).alias("defects"))


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "generation_records"), table(spark, sf_dir, "generation_specs"), table(spark, sf_dir, "prompts")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(*tables(spark, sf_dir)).where(F.size("defects") > 0).select("request_id", F.col("defects")[0]["defect"].alias("defect"))


def p6_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of each record, with its posterior."""
    return judged(*tables(spark, sf_dir)).select("request_id", F.explode("defects").alias("x")).select("request_id", "x.defect", F.round("x.posterior", 6).alias("posterior"))
