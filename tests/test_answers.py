import pytest

from trendlens.functions import answers, fixed, prompts
from trendlens.operators import labelling


def parsed(spark, raws, parse=answers.with_json_answer, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw_resp string")
    return [(r["label"], r["reason"]) for r in parse(df, "raw_resp", **options).orderBy("i").collect()]


CASES = [
    ('{"label":"olympic","reason":"x"}', ("olympic", "x")),
    ('  {"reason":"x","label":"other_sport","more":[1,{"a":2}]} ', ("other_sport", "x")),
    ('Sure: {"label":"olympic","reason":"x"} ok', ("olympic", "x")),
    (None, ("non_sport", "empty_response")),
    (" \n\t　", ("non_sport", "empty_response")),
    ("no json here", ("non_sport", "parse_error")),
    ('{"label":"olympic","reason":5}', ("olympic", "parse_error")),
    ('{"label":"Olympic","reason":"x"}', ("olympic", "x")),
    ('{"label":"medal","reason":"x"}', ("non_sport", "x")),
    ("{'label':'olympic','reason':'x'}", ("non_sport", "parse_error")),
    ('{"label":"olympic","reason":"abc', ("olympic", "abc}")),
    ('{"label":"olympic","reason":"abc"', ("olympic", "abc")),
    ('{"label":"olympic","reason":"a, ;:', ("olympic", "a, ;:}")),
    ('{"label":"olympic" "reason":" ,;"}', ("olympic", "parse_truncated")),
    ('{"label":"olympic","reason":"x"} and {"label":"non_sport"}', ("olympic", "x")),
    ('{"label":"olympic","label":"non_sport","reason":"x","reason":"y"}', ("non_sport", "y")),
    ('{"label":"olympic","reason":null}', ("olympic", "parse_error")),
    ('[{"label":"olympic","reason":"x"}]', ("olympic", "x")),
    ('{"label":"olympic","reason":"a\\"b"}', ("olympic", 'a"b')),
    ('{"label":"olympic","reason":"a\nb"}', ("olympic", "a\nb")),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_json_case(spark, i):
    raw, want = CASES[i]
    assert parsed(spark, [raw]) == [want]


CUT_SHORT = [
    # how far the answer {"label":"other_sport","reason":"so it is"} came, and what is read from it
    (0, ("non_sport", "empty_response")),
    (1, ("non_sport", "parse_error")),
    (9, ("non_sport", "parse_error")),
    (15, ("non_sport", "parse_error")),
    (21, ("non_sport", "parse_error")),
    (22, ("other_sport", "parse_error")),
    (23, ("other_sport", "parse_error")),
    (31, ("other_sport", "parse_error")),
    (33, ("other_sport", "}")),
    (34, ("other_sport", "s}")),
    (37, ("other_sport", "so i}")),
    (41, ("other_sport", "so it is}")),
    (42, ("other_sport", "so it is")),
    (43, ("other_sport", "so it is")),
]


def test_json_cut_short(spark):
    whole = '{"label":"other_sport","reason":"so it is"}'
    assert len(whole) == 43
    assert parsed(spark, [whole[:n] for n, _ in CUT_SHORT]) == [want for _, want in CUT_SHORT]


def test_quote_first_repair(spark):
    assert parsed(spark, ['{"label":"olympic","reason":"abc'], quote_first=True) == [("olympic", "abc")]


def test_line_answers(spark):
    raws = [
        "Label: olympic\nReason: because",
        "prompt\nLabel: non_sport\nReason: example\n\nLABEL:  Other_Sport now\n reason:  mine ",
        "Label:\nReason: r", "Label: olympic\nLabel: medal", "", None, "Reason: a\nReason:", "xLabel: olympic",
    ]
    want = [("olympic", "because"), ("other_sport", "mine"), ("non_sport", "r"), ("olympic", ""),
            ("non_sport", ""), ("non_sport", ""), ("non_sport", ""), ("non_sport", "")]
    assert parsed(spark, raws, answers.with_line_answer) == want


def test_prompts(spark):
    df = spark.createDataFrame([("a\nb <<tags>>", "t", "d" * 900)], "title string, tags string, description string")
    slot, line = df.select(prompts.slot_prompt("T <<title>> G <<tags>>\n"), prompts.line_prompt("E\nTitle: {title}\nTags: {tags}")).first()
    assert slot == "T a b t G t"
    assert line == "E\n\n\nTitle: a\nb <<tags>>\nTags: t\nDescription: " + "d" * 800 + "\n\n" + fixed.LINE_FORMAT


def test_line_prompt_literally(spark):
    df = spark.createDataFrame([("A", "b", "c")], "title string, tags string, description string")
    assert df.select(prompts.line_prompt("Title: t\nLabel: olympic\n\n")).first()[0] == (
        "Title: t\nLabel: olympic\n\n\nTitle: A\nTags: b\nDescription: c\n\n\n"
        "Answer using EXACTLY the following format (no extra text):\n"
        "Label: <one of olympic | other_sport | non_sport>\nReason: <one short sentence>\n")


def test_labeller_and_failed_rows(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "i int, title string")

    def answer(asked):
        return asked.map(lambda p: None if "bad" in p else '{"label":"olympic","reason":"said"}')

    rows = labelling.with_labels(labelling.ask(df, answer, prompts.slot_prompt("<<title>>", tags="title")))
    got = {r["i"]: (r["label"], r["reason"], r["raw_resp"]) for r in rows.collect()}
    assert got[1][:2] == ("olympic", "said")
    assert got[2] == ("non_sport", "generation_failed", "")
