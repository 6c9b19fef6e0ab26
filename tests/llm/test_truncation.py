import random

import pytest
from pyspark.sql import functions as F

from pandect.llm import truncation as T
from tests.conftest import rows

WHOLE = [
    "The lessee must clean each kiln.",
    "Is it so? [F12]",
    "It is agreed in writing. . . . . . . . . . . F96",
    "Kept by the Board. (see Schedule 4)",
    "Kept by the Board. End of document",
    "<p>Kept by the Board.</p>",
    "He said “no.”",
    "The rest is omitted, etc. ​",
    "1 | kiln | £40 | n/a\n2 | hoist | £5 | reg. 7",
    "Text.\nSigned by authority of the Board\nA Name\nDunlath, 8 May 2003",
    "Text.\r\nSigned by authority of the Board\r\nA Name\r\nRegistrar of Tallies",
    "Payable under reg. 3.",
    "Kept by the Board. [more]",
    "See https://example.org/a",
    "The fee is £30.",
    "これは文です。",
    "这是一个句子。",
    "هذه جملة كاملة۔",
    "a | b\n1 | 2\n3 | 4",
    "Kept by the Board." + " [F1]" * 500 + "…" * 500,
]
EITHER = ["(a) clean each kiln; and", "Text. (g) clean each kiln in accordance with art. 34 of the Act;", "The lessee must—", "It shall keep records of:", "PART 7 KILNS", "The Kilns (Fees) Order 1999", "Llanfedw: kiln and hoist", "Keeping of Records of hoists", "Text. (b) mark it, neu", "Interpretation", "Short title and commencement", "Article 5", "Table 3", "12 March 2020", "- feed the kiln\n- clean the hoist", "Health and Safety Executive", "この文は", "The reading was 7."]
CUT = [
    "The lessee must clean each ki",
    "The lessee must clean each …",
    "Text. The car</p>",
    "Payable under reg.",
    "It is payable (see ss. 22 and 5 and s.",
    "The reading taken on 27.9.",
    "A fee of £852.",
    "The lessee must— (a) clean it; (b) mark it;",
    'Text. The lessee must "',
    "Text. The lessee must (cont.)",
    "Text. The lessee must[...]",
    "Text. Rhaid i'r ",
    "The lessee must >>",
    "Kept under reg. [more]",
    "Kept clean.\nNothi",
    "Kept clean.\nThe Inspectorat",
    "3 | kiln | £4 | n/a\n4 | ki",
]


@pytest.mark.parametrize(("texts", "want"), [(WHOLE, "whole"), (EITHER, "either"), (CUT, "cut"), (["", "  \n", "…", "​"], "blank")])
def test_endings(spark, texts, want):
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.ending(T.flat(T.unmarked(F.col("text")))).alias("e"))
    assert {r["text"]: r["e"] for r in df.collect()} == dict.fromkeys(texts, want)


def test_very_long_texts_do_not_recurse(spark):
    long = ["(a) " + "word " * 200_000 + ";", " . " * 100_000, "\n" * 100_000 + "x", "…" * 50_000, "a. (b) " * 50_000, "<" * 50_000, ">" * 50_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(long)], "doc_id bigint, text string, source string")
    assert T.found(df).count() >= 0


def sentence(rng):
    return "The " + " ".join(rng.choice(["kiln", "hoist", "tide", "lime", "board"]) for _ in range(rng.randint(3, 25))) + ". "


def corpus(seed, limit):
    rng = random.Random(seed)
    out, cut = [], set()
    for i in range(1500):
        text = "".join(sentence(rng) for _ in range(rng.randint(1, 14))).strip()
        if len(text) > limit and rng.random() < 0.5:
            text = text[:limit]
            if not text.rstrip().endswith("."):
                cut.add(i)
        out.append((i, text, " Src"))
    return out, cut


def test_field_limits_are_found(spark):
    data, cut = corpus(3, 300)
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    n = sum(len(t) == 300 for t in {t for _, t, _ in data})
    assert rows(T.limits(df)) == [("src", "bytes", 300, 300, n, len(cut))]
    assert {r[0] for r in T.found(df).collect()} == cut
    verdicts = {r["verdict"] for r in T.judged(df).collect()}
    assert verdicts == {"field limit"}


def test_either_is_cut_at_a_limit_only_and_copies_follow(spark):
    data, cut = corpus(4, 300)
    at = ("Keep it. " * 40)[: 300 - len("The owner must—")] + "The owner must—"
    data += [(9001, at, "src"), (9002, at, "elsewhere"), (9003, "Keep it. The owner must—", "src"), (9004, None, "src"), (9005, "  ", None), (None, "The ow", "src")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").withColumn("h", F.lit("clash")).withColumn("core", F.lit(1))
    assert {r[0] for r in T.found(df).collect()} == cut | {9001, 9002}
    without = T.measured(df).where("ending = 'cut'")
    assert {r[0] for r in without.select("doc_id").collect()} & {9001, 9002} == set()  # only hazards find these
    share = {r["source_name"]: (r["at_limit"], r["in_transfer"]) for r in T.report(df).collect()}
    assert share["src"][0] == len(cut) + 1 and share["elsewhere"] == (0, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert T.found(df).count() == 0 and T.report(df).count() == 0 and T.limits(df).count() == 0
