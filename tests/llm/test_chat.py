from pyspark.sql import types as T

from tallyscope.llm import chat

SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("turns", T.StringType())]
)


def render(turns):
    return "".join(f"<|{r or 'unknown'}|>\n{t or ''}<|end|>\n" for r, t in turns)


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    masks = []
    for side in (chosen[n:], rejected[n:]):
        at, spans = 0, []
        for r, t in side:
            after = at + len(render([(r, t)]))
            if r == "assistant":
                spans.append((at + len(f"<|{r}|>\n"), after))
            at = after
        masks.append(spans)
    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), *masks


PAIRS = [
    ([("user", "hi"), ("assistant", "a"), ("user", "é😀"), ("assistant", "b")], [("user", "hi"), ("assistant", "a"), ("user", "é😀"), ("assistant", "cc")]),
    ([("user", "hi")], [("user", "hi")]),
    ([("user", "hi"), ("assistant", None)], [("user", "hi"), ("assistant", "")]),
    ([], [("assistant", "x" * 50_000), (None, None)]),
    ([(None, None), ("assistant", "y")], [(None, None)]),
    ([("system", ""), ("assistant", "1"), ("user", "2"), ("assistant", "3")], [("user", "")]),
]


def test_pairs_equal_brute_force(spark):
    rows = [(k, [(i, *t) for i, t in enumerate(a)], [(i, *t) for i, t in enumerate(b)], "x") for k, (a, b) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string")
    for r in chat.format_pairs(df).collect():
        got = r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]
        assert got == brute(*PAIRS[r.pair_id])


def test_conversations_and_negatives(spark):
    rows = [(4, 1, "assistant", "A", ""), (4, 0, "user", "q", ""), (5, 0, "user", "p", ""), (5, 1, "assistant", "B", ""), (5, 2, "user", "z", "")]
    rows += [(None, 0, "user", "lost", ""), (8, 0, "assistant", "alone", ""), (4, 0, "user", "q", "")]
    talks = chat.conversations(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.conv_id for r in talks.collect()) == [4, 5, 8]
    got = {r.pair_id: r for r in chat.format_pairs(chat.negatives(talks)).collect()}
    assert set(got) == {4, 5, 8}
    assert got[4].n_prompt_turns == 2 and got[4].prompt == render([("user", "q"), ("user", "q")])
    assert got[4].rejected == render([("assistant", "B"), ("user", "z")])
    assert got[5].chosen == render([("assistant", "B"), ("user", "z")]) and got[5].rejected == render([("assistant", "A")])
    assert got[8].chosen == render([("assistant", "alone")]) and got[8].rejected == ""


def test_every_conversation_comes_out(spark):
    talks = {
        0: [("user", "a"), ("assistant", "1"), ("user", "b"), ("assistant", "2"), ("user", "c"), (None, "d")],
        1: [("user", "no answer")], 2: [("user", "x"), ("assistant", "same")], 3: [("user", "y"), ("assistant", "same"), ("user", "more")],
        5: [("assistant", None)], 7: [("user", None)],
    }
    rows = [(c, i, r, t, "") for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    got = chat.format_pairs(chat.negatives(chat.conversations(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sorted(r.pair_id for r in got) == sorted(talks)
    for r in got:
        last = lambda c: max((i for i, t in enumerate(talks.get(c, [])) if t[0] == "assistant"), default=None)
        own, k, other = talks[r.pair_id], last(r.pair_id), last(r.pair_id ^ 1)
        rejected = own[: len(own) if k is None else k] + ([] if other is None else talks[r.pair_id ^ 1][other:])
        found = r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]
        assert found == brute(own, rejected)


def test_empty_table(spark):
    assert chat.format_pairs(chat.negatives(chat.conversations(spark.createDataFrame([], SCHEMA)))).collect() == []
